-- Fixture views as in FIXTURES.md; a name's line begins each. _spark and _duck mark the two forms of one view.
-- view fx_scenes
SELECT o_orderkey AS scene_key,
 concat(CASE o_custkey % 5 WHEN 0 THEN 'GF100' WHEN 1 THEN 'GF600' WHEN 2 THEN 'JKF01' WHEN 3 THEN 'ZY02C' ELSE 'JL1KF02B04' END,
  CASE WHEN o_custkey % 5 = 4 THEN '_PMS06_' ELSE '_0200_' END,
  CASE WHEN o_custkey % 5 = 4 THEN '' ELSE concat(lpad(CAST(o_orderkey AS STRING), 8, '0'), '_') END,
  CAST(year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) AS STRING), '120602_00PMS1_003_F') AS scene_id,
 concat(CAST(year(o_orderdate) AS STRING), 'Q', CAST(quarter(o_orderdate) AS STRING)) AS quarter,
 CAST(o_orderdate AS DATE) AS date,
 CAST(30 + o_custkey % 420 AS DOUBLE) / CAST(100 AS DOUBLE) AS gsd_m,
 o_totalprice AS file_size_mb,
 CASE WHEN o_orderkey % 9 = 0 THEN concat('D:/', '低精度', '/', CAST(o_orderkey AS STRING), '.tif') ELSE concat('D:/img/', CAST(o_orderkey AS STRING), '.tif') END AS tif_path,
 CAST(11856640 + (o_custkey % 30) * 1280 AS DOUBLE) AS minx,
 CAST(4828160 + ((o_orderkey * 7) % 30) * 1280 AS DOUBLE) AS miny,
 CAST(11856640 + (o_custkey % 30) * 1280 + (1 + o_orderkey % 4) * 1280 AS DOUBLE) AS maxx,
 CAST(4828160 + ((o_orderkey * 7) % 30) * 1280 + (1 + o_orderkey % 3) * 1280 AS DOUBLE) AS maxy
FROM orders
-- view fx_patches
SELECT p.l_orderkey AS scene_key, concat('p/', CAST(p.l_orderkey AS STRING), '/p_', lpad(CAST(p.l_linenumber*128 AS STRING),5,'0'), '_00000') AS patch_path,
 s.scene_id, s.quarter, s.date, p.l_linenumber*128 AS row, 0 AS col, 128 AS patch_size,
 CAST(11856640 + (p.pk % 40)*1280 + (CASE p.pk % 7 WHEN 0 THEN 128 WHEN 1 THEN 640 ELSE 0 END) AS DOUBLE) AS minx,
 CAST(4828160 + (p.sk % 25)*1280 AS DOUBLE) AS miny,
 CAST(11856640 + (p.pk % 40)*1280 + (CASE p.pk % 7 WHEN 0 THEN 128 WHEN 1 THEN 640 ELSE 0 END) + 1280 AS DOUBLE) AS maxx,
 CAST(4828160 + (p.sk % 25)*1280 + 1280 AS DOUBLE) AS maxy
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber) p
JOIN fx_scenes s ON s.scene_key = p.l_orderkey
-- view fx_pixels_spark
SELECT vec_id AS patch_id, label AS class_id, CAST(pos % 16 AS INT) AS px, CAST(floor(pos / 16) AS INT) AS band,
 CAST(floor((CAST(e AS DOUBLE) + CAST(0.6 AS DOUBLE)) * 200) AS INT) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, e
-- view fx_pixels_duck
SELECT vec_id AS patch_id, label AS class_id, CAST(pos % 16 AS INT) AS px, CAST(floor(pos / 16) AS INT) AS band,
 CAST(floor((CAST(e AS DOUBLE) + CAST(0.6 AS DOUBLE)) * 200) AS INT) AS v FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding,1)-1 AS pos FROM embeddings)
-- view fx_preds
SELECT l_orderkey AS row_id, CAST(l_partkey % 10 AS INT) AS y_true, CAST(CASE WHEN l_suppkey % 4 = 0 THEN (l_partkey+1) % 10 ELSE l_partkey % 10 END AS INT) AS y_pred,
 CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS y_bin, l_quantity / CAST(50 AS DOUBLE) AS score FROM lineitem
-- view fx_runs
SELECT o_orderpriority AS method, o_orderstatus AS modality, o_custkey % 3 AS seed, avg(o_totalprice)/CAST(1000000 AS DOUBLE) AS overall_accuracy, min(o_orderkey)+7690 AS trainable_params
FROM orders GROUP BY o_orderpriority, o_orderstatus, o_custkey % 3
-- view fx_ways
SELECT p_partkey AS way_id, k AS seq, CAST(106500000 + (p_partkey*37) % 2000000 + (CASE WHEN k IN (1,2) THEN p_size*3 ELSE 0 END) AS DOUBLE)/CAST(1000000 AS DOUBLE) AS lon,
 CAST(39740000 + (p_partkey*91) % 1900000 + (CASE WHEN k IN (2,3) THEN p_size*2 ELSE 0 END) AS DOUBLE)/CAST(1000000 AS DOUBLE) AS lat
FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks WHERE NOT (p_partkey % 11 = 0 AND k = 4)
-- view fx_logs
SELECT event_id, concat('  [', event_type, '|m', CAST(user_id % 3 AS STRING), '|seed=', CAST(user_id % 5 AS STRING), '] Epoch ', CAST(1 + event_id % 50 AS STRING), '/50 loss=', CAST(CAST(floor(value) AS INT) AS STRING), '.25') AS line, ts FROM events
-- view fx_areas
SELECT r_name AS province, n_name AS city, c_mktsegment AS county, c_name AS township, CAST(105 + c_custkey % 10 AS DOUBLE) AS minx, CAST(28 + c_custkey % 7 AS DOUBLE) AS miny, CAST(105 + c_custkey % 10 AS DOUBLE)+CAST(0.4 AS DOUBLE) AS maxx, CAST(28 + c_custkey % 7 AS DOUBLE)+CAST(0.3 AS DOUBLE) AS maxy
FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
-- view fx_patch_vec
SELECT patch_path, (scene_key * 7 + row) % (SELECT count(*) FROM embeddings) AS vec_id FROM fx_patches
