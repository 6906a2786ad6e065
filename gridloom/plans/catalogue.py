"""Queries: sources, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import catalogue as C
from ..sources import layout as Y
from ..sources.geojson import write_collections
from ..sources.scratch import scratch
from .registry import query, r6

_SAT = "CASE WHEN regexp_matches(scene_id,'^[A-Z0-9]+_[0-9]+_') THEN regexp_extract(scene_id,'^([A-Z0-9]+)_[0-9]+_',1) ELSE split_part(scene_id,'_',1) END"
_SENSOR = "nullif(regexp_extract(scene_id,'_([A-Z]{3}[0-9]*|NAD|PMS[0-9]*|0PMS[0-9]+)_',1),'')"
_STRICT = "CAST(try_strptime(nullif(regexp_extract(scene_id,'_([0-9]{8})[0-9]{6}_',1),''),'%Y%m%d') AS DATE)"
_LOOSE = "regexp_extract(scene_id,'_([0-9]{8})(?:[0-9]{6})?_',1)"
_REPARSE = f"CASE WHEN TRY_CAST({_LOOSE} AS INTEGER) BETWEEN 19000000 AND 21000000 THEN CAST(try_strptime({_LOOSE},'%Y%m%d') AS DATE) END"
_BUCKET = "CASE WHEN gsd_m<0.5 THEN 'sub_meter' WHEN gsd_m<1.5 THEN 'sub_1p5m' WHEN gsd_m<2.5 THEN 'around_2m' ELSE 'coarse' END"
_LOW = "regexp_matches(tif_path,'低精度|低精|预处理|中间')"


@query(
    "a1_scene_catalog",
    f"""SELECT scene_key, scene_id, {_SAT} AS satellite, coalesce({_SENSOR}, CASE WHEN scene_key%2=0 THEN 'MUX' END) AS sensor,
    coalesce({_STRICT}, CASE WHEN scene_key%3=0 THEN date END) AS date, CASE WHEN scene_key%3=0 THEN quarter END AS quarter,
    CASE WHEN scene_key%4=0 THEN 'sidecar' ELSE 'raster' END AS geom_source, CASE WHEN scene_key%4=0 THEN minx+10 ELSE minx END AS minx, maxy FROM
    (SELECT *, CASE WHEN scene_key%3=0 THEN 1 END AS m FROM fx_scenes) WHERE true""".replace("CASE WHEN scene_key%2=0 THEN 'MUX' END", "CASE WHEN scene_key%3=0 AND scene_key%2=0 THEN 'MUX' END"),
)
def _(t):
    s = t["fx_scenes"]
    headers = s.select(F.concat("scene_id", F.lit("#"), "scene_key").alias("scene_id"), "scene_key", "minx", "miny", "maxx", "maxy")
    meta = s.where("scene_key % 3 = 0").select(
        F.concat("scene_id", F.lit("#"), "scene_key").alias("folder_name"), F.when(F.col("scene_key") % 2 == 0, "MUX").otherwise("").alias("sensor"), "date", F.lit(0.0).alias("cloud_cover"), "quarter"
    )
    side = s.where("scene_key % 4 = 0").select(F.concat("scene_id", F.lit("#"), "scene_key").alias("scene_id"), (F.col("minx") + 10).alias("minx"), "miny", "maxx", "maxy")
    out = C.build_scene_catalog(headers, meta, side)
    return out.select("scene_key", F.substring_index("scene_id", "#", 1).alias("scene_id"), "satellite", "sensor", "date", "quarter", "geom_source", "minx", "maxy")


@query("a2_canonical_columns", "SELECT o_orderkey AS folder_name, CAST(o_totalprice AS DOUBLE) AS cloud_cover, o_orderstatus AS sensor, o_orderdate AS date, o_orderpriority AS quarter FROM orders")
def _(t):
    o = t["orders"].select(F.col("o_orderkey").alias("编号"), F.col("o_totalprice").alias("含云量"), F.col("o_orderstatus").alias("传感器"), F.col("o_orderdate").alias("拍摄时间"), F.col("o_orderpriority").alias("季度"))
    return C.canonicalize_columns(o)


@query("a4_geojson_points", """SELECT patch_path, minx, '{"type":"Feature","geometry":{"type":"Point","coordinates":['||CAST(minx AS VARCHAR)||','||CAST(miny AS VARCHAR)||']},"properties":{"quarter":"'||quarter||'","row":'||row||'}}' AS feature FROM (SELECT patch_path, quarter, row, minx-11856640.5 AS minx, miny-4828160.5 AS miny FROM fx_patches)""")
def _(t):
    p = t["fx_patches"].select("patch_path", "quarter", "row", (F.col("minx") - 11856640.5).alias("minx"), (F.col("miny") - 4828160.5).alias("miny"))
    return p.select("patch_path", "minx", C.point_feature("minx", "miny", {"quarter": F.col("quarter"), "row": F.col("row")}).alias("feature"))


@query("a3_read_geojson", "SELECT patch_path, quarter, 'Polygon' AS geometry_type, 5 AS points, minx, maxy FROM fx_patches")
def _(t):
    """Footprints written as compressed GeoJSON collections of 100,000 features at most, and read back by many tasks."""
    path = scratch(t.spark, "collections")
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny")))
    write_collections(C.geojson_features(t["fx_patches"], "Polygon", ring, ["patch_path", "quarter"]), path, "value", 100_000)
    r = F.col("coordinates")[0]
    return C.read_geojson(t.spark, path).select("patch_path", "quarter", "geometry_type", F.size(r).alias("points"), F.array_min(F.transform(r, lambda p: p[0])).alias("minx"), F.array_max(F.transform(r, lambda p: p[1])).alias("maxy"))


@query("a5_patch_index_round_trip", "SELECT quarter, count(*) AS n, count(DISTINCT patch_path) AS n_paths, CAST(sum(row) AS BIGINT) AS rows FROM fx_patches WHERE quarter LIKE '1998%' GROUP BY 1")
def _(t):
    """The index written by quarter and read back; the filter reads four folders."""
    path = scratch(t.spark, "patch_index")
    C.write_patch_index(t["fx_patches"], path)
    some = C.read_patch_index(t.spark, path).where(F.col("quarter").startswith("1998"))
    return some.groupBy("quarter").agg(F.count("*").alias("n"), F.countDistinct("patch_path").alias("n_paths"), F.sum("row").cast("long").alias("rows"))


_BOX = (11876640, 4832160, 11884320, 4840480)


@query(
    "a5_spatial_index_box",
    f"""SELECT quarter, count(*) AS n, count(DISTINCT patch_path) AS n_paths, min(minx) AS minx, max(maxy) AS maxy FROM fx_patches
    WHERE minx<={_BOX[2]} AND maxx>={_BOX[0]} AND miny<={_BOX[3]} AND maxy>={_BOX[1]} GROUP BY 1""",
)
def _(t):
    """The whole index laid out along a Hilbert curve; a box is read back by the bounds of row groups and pages."""
    path = scratch(t.spark, "spatial_index")
    Y.write_spatial_index(t["fx_patches"], path)
    return Y.read_box(t.spark, path, _BOX).groupBy("quarter").agg(F.count("*").alias("n"), F.countDistinct("patch_path").alias("n_paths"), F.min("minx").alias("minx"), F.max("maxy").alias("maxy"))


@query("a9_list_written_datasets", "SELECT quarter AS dataset, count(*) AS n_files FROM (SELECT DISTINCT quarter FROM fx_patches) GROUP BY 1")
def _(t):
    """Datasets by the files that lie in their folders, as they were written: one for each quarter."""
    path = scratch(t.spark, "datasets")
    t["fx_patches"].repartition("quarter").write.partitionBy("quarter").parquet(path)
    found = C.files(t.spark, path, "*.parquet").select(F.regexp_extract("path", "quarter=([^/]*)/", 1).alias("dataset"), F.to_date("modificationTime").alias("modified"))
    return C.list_datasets(found).select("dataset", F.col("n_patches").alias("n_files"))


@query("a10_files_on_disk", "SELECT count(*) AS n_files, true AS has_size FROM (SELECT DISTINCT quarter FROM fx_patches)")
def _(t):
    path = scratch(t.spark, "files")
    t["fx_patches"].repartition("quarter").write.partitionBy("quarter").parquet(path)
    out = C.file_inventory(C.files(t.spark, path, "*.parquet").select((F.col("length") / 1048576).alias("size_mb")))
    return out.select("n_files", (F.col("total_gb") > 0).alias("has_size"))


@query("a5_manifest", "SELECT count(*) AS n_patches, count(DISTINCT scene_id) AS n_scenes, (SELECT string_agg(q, ',' ORDER BY q) FROM (SELECT DISTINCT quarter AS q FROM fx_patches)) AS quarters, max(patch_size) AS patch_size FROM fx_patches")
def _(t):
    return C.manifest(t["fx_patches"])


@query(
    "a6_label_index",
    """SELECT 'osm' AS kind, patch_path, 'm/'||row AS label_path, CAST(NULL AS INTEGER) AS year FROM fx_patches WHERE row%256=0
    UNION ALL SELECT 'lulc', patch_path, 'l/'||row, CAST(year(date) AS INTEGER) FROM fx_patches WHERE row%256<>0""",
)
def _(t):
    p = t["fx_patches"]
    osm = p.where("row % 256 = 0").select(F.translate("patch_path", "/", "\\").alias("patch_path"), F.concat(F.lit("m\\"), "row").alias("osm_path"))
    lulc = p.where("row % 256 <> 0").select("patch_path", F.concat(F.lit("l/"), "row").alias("lulc_path"), F.year("date").alias("year"))
    return C.read_label_index(osm, "osm").unionByName(C.read_label_index(lulc, "lulc"))


@query("a8_labels", "SELECT doc_id, quality, toxic FROM labels")
def _(t):
    empty = C.load_labels(t.spark, None).select(F.col("dataset_id").cast("long").alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return t["labels"].select("doc_id", "quality", "toxic").unionByName(empty)


@query("a9_list_datasets", "SELECT CAST(o_custkey AS VARCHAR) AS dataset, count(*) AS n_patches, CAST(max(o_orderdate) AS DATE) AS modified FROM orders GROUP BY 1 UNION ALL SELECT 'mem', 7, DATE '1990-01-01'")
def _(t):
    memory = t.spark.range(1).select(F.lit("mem").alias("dataset"), F.lit(7).cast("long").alias("n_patches"), F.lit("1990-01-01").cast("date").alias("modified"))
    return C.list_datasets(t["orders"].select(F.col("o_custkey").cast("string").alias("dataset"), F.col("o_orderdate").cast("date").alias("modified")), memory)


@query("a10_file_inventory", "SELECT count(*) AS n_files, round(sum(round(file_size_mb*0.5,0)),6)+0.0 AS total_mb, round(sum(file_size_mb*0.5)/1024,4)+0.0 AS total_gb FROM (SELECT floor(file_size_mb)*2 AS file_size_mb FROM fx_scenes)")
def _(t):
    out = C.file_inventory(t["fx_scenes"].select(F.floor("file_size_mb").cast("double").alias("size_mb")))
    return out.select("n_files", r6("total_mb").alias("total_mb"), (F.round("total_gb", 4) + 0.0).alias("total_gb"))


@query("a11_checksums", "SELECT doc_id, sha256(coalesce(text,'')) AS sha256 FROM documents")
def _(t):
    return C.checksums(t["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text").select("doc_id", "sha256")


@query("a12_worldfile", "SELECT scene_key, CASE WHEN scene_key%2=0 THEN gsd_m ELSE 1.0 END AS px, CASE WHEN scene_key%2=0 THEN -gsd_m ELSE -1.0 END AS py, CASE WHEN scene_key%2=0 THEN minx ELSE 0.0 END AS ulx FROM fx_scenes")
def _(t):
    text = F.concat_ws("\n", F.col("gsd_m").cast("string"), F.lit("0"), F.lit("0"), (-F.col("gsd_m")).cast("string"), F.col("minx").cast("string"), F.col("maxy").cast("string"))
    s = t["fx_scenes"].select("scene_key", F.lit(1.0).alias("px"), F.lit(-1.0).alias("py"), F.lit(0.0).alias("ulx"), F.lit(0.0).alias("uly"), (F.col("scene_key") % 2 == 0).alias("geographic"), text.alias("worldfile"))
    return C.corrected_transform(s).select("scene_key", "px", "py", "ulx")


@query(
    "a13_training_logs",
    r"""SELECT regexp_extract(line,'\[([^|]+)\|',1) AS method, regexp_extract(line,'\[[^|]+\|([^|]+)\|',1) AS modality, CAST(regexp_extract(line,'seed=(\d+)',1) AS INTEGER) AS seed,
    CAST(regexp_extract(line,'Epoch\s+(\d+)/',1) AS INTEGER) AS epoch, CAST(regexp_extract(line,'loss=([\d.]+)',1) AS DOUBLE) AS loss FROM fx_logs WHERE regexp_matches(line,'loss=[\d.]+')""",
)
def _(t):
    return C.parse_training_logs(t["fx_logs"])


@query("a14_report_tables", "SELECT quarter, count(*) AS n FROM fx_patches GROUP BY quarter")
def _(t):
    return t["fx_patches"].groupBy("quarter").agg(F.count("*").alias("n"))


for _name, _column, _sql in (
    ("b1_parse_satellite", lambda: S.parse_satellite("scene_id"), _SAT),
    ("b2_parse_sensor", lambda: S.parse_sensor("scene_id"), _SENSOR),
    ("b3_parse_date_strict", lambda: S.parse_date_strict("scene_id"), _STRICT),
    ("b4_reparse_date", lambda: S.reparse_date("scene_id", "date"), f"coalesce({_REPARSE}, date)"),
    ("b5_gsd_bucket", lambda: S.gsd_bucket("gsd_m"), _BUCKET),
    ("b6_low_precision_flag", lambda: S.low_precision_flag("tif_path"), _LOW),
    ("b8_normalize_path", lambda: S.normalize_path(F.translate("tif_path", "/", "\\")), "tif_path"),
    ):
    query(_name, f"SELECT scene_key, {_sql} AS v FROM fx_scenes")(lambda t, c=_column: t["fx_scenes"].select("scene_key", c().alias("v")))


@query("b7_approx_gsd", "SELECT province, city, county, township, minx, miny, round(0.0001*111320.0*cos(radians(miny)),6)+0.0 AS gsd_m FROM fx_areas")
def _(t):
    return t["fx_areas"].select("province", "city", "county", "township", "minx", "miny", r6(S.approx_gsd_m(F.lit(0.0001), "miny")).alias("gsd_m"))


@query("b9_catalog_filter", f"SELECT scene_key, quarter FROM (SELECT *, {_SAT} AS satellite FROM fx_scenes) WHERE satellite IN ('GF100','ZY02C') AND quarter IN ('1998Q1','1998Q2') ORDER BY scene_key LIMIT 50")
def _(t):
    s = t["fx_scenes"].withColumn("satellite", S.parse_satellite("scene_id"))
    return C.filter_catalog(s, ["GF100", "ZY02C"], ["1998Q1", "1998Q2"], 50, "scene_key").select("scene_key", "quarter")


def scene_qc(t):
    """A QC table of the scenes: dark ratios from the keys, some null."""
    k = F.col("scene_key")
    return t["fx_scenes"].select("scene_key", S.gsd_bucket("gsd_m").alias("gsd_bucket"), S.low_precision_flag("tif_path").alias("low_precision_flag"), (k % 17 != 0).alias("read_ok"), F.when(k % 5 != 0, (k % 40) / 100.0).alias("center_dark_ratio"))


@query("b10_qc_gate", f"SELECT {_BUCKET} AS gsd_bucket, count(*) AS n, count(*) FILTER (WHERE NOT {_LOW} AND scene_key%17<>0 AND scene_key%5<>0 AND (scene_key%40)/100.0<=0.1) AS n_kept FROM fx_scenes GROUP BY 1")
def _(t):
    return C.qc_gate_counts(scene_qc(t))


@query(
    "b11_suitability",
    """WITH s AS (SELECT o_custkey, max((o_orderpriority='1-URGENT')::INT) AS a, max((o_orderpriority='2-HIGH')::INT) AS b, max((o_orderpriority='3-MEDIUM')::INT) AS m FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN a=1 THEN 90 ELSE 20 END AS spectral_score, CASE WHEN a=1 THEN 100 WHEN m=1 THEN 10 ELSE 50 END AS resolution_score, CASE WHEN a=1 OR b=1 THEN 85 ELSE 60 END AS temporal_score,
    50+20*a+30*b AS modality_score, 95 AS readiness_score,
    CAST(floor((CASE WHEN a=1 THEN 90 ELSE 20 END + CASE WHEN a=1 THEN 100 WHEN m=1 THEN 10 ELSE 50 END + CASE WHEN a=1 OR b=1 THEN 85 ELSE 60 END + 50+20*a+30*b + 95)/5.0) AS INTEGER) AS overall_score,
    coalesce(nullif(concat_ws(',', CASE WHEN a=0 THEN 'add_optical' END, CASE WHEN b=0 THEN 'add_radar' END, CASE WHEN m=1 THEN 'drop_modis' END),''),'keep') AS recommendations FROM s""",
)
def _(t):
    name = F.expr("map('1-URGENT', 'Sentinel-2', '2-HIGH', 'Sentinel 1', '3-MEDIUM', 'MODIS')")
    lists = t["orders"].groupBy("o_custkey").agg(F.collect_set(F.coalesce(name[F.col("o_orderpriority")], F.lit("other"))).alias("sources"))
    s = S.suitability("sources")
    return lists.select("o_custkey", *(c.alias(k) for k, c in s.items() if k != "recommendations"), F.array_join(s["recommendations"], ",").alias("recommendations"))


@query("b12_search_areas", "SELECT concat_ws('-',province,city,county,township) AS full_name, minx, miny FROM fx_areas WHERE township LIKE '%BUILD%' OR county LIKE '%BUILD%' OR city LIKE '%BUILD%' ORDER BY 1,2,3 LIMIT 20")
def _(t):
    return C.search_areas(t["fx_areas"], "BUILD").select("full_name", "minx", "miny")


@query("b13_available_satellites", "SELECT s_suppkey AS norad_number, s_name FROM supplier WHERE s_suppkey%3<>0")
def _(t):
    return C.available_satellites(t["supplier"].select(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).alias("norad_number"), "s_name"))


_SEARCH = f"""SELECT satellite, date, scene_id, scene_key FROM (SELECT *, {_SAT} AS satellite, scene_key%100 AS cloud_cover FROM fx_scenes)
WHERE minx<=11866880 AND maxx>=11856640 AND miny<=4838400 AND maxy>=4828160 AND date>=DATE '1997-01-01' AND date<DATE '1999-01-01' AND cloud_cover<20
QUALIFY row_number() OVER (PARTITION BY satellite ORDER BY date, scene_id, scene_key)=1"""


def _clouded(t):
    return t["fx_scenes"].select(S.parse_satellite("scene_id").alias("satellite"), "date", "scene_id", "scene_key", (F.col("scene_key") % 100).alias("cloud_cover"), "minx", "miny", "maxx", "maxy")


@query("b14_scene_search", _SEARCH)
def _(t):
    return C.scene_search(_clouded(t), (11856640, 4828160, 11866880, 4838400), "1997-01-01", "1999-01-01", 20).select("satellite", "date", "scene_id", "scene_key")


@query("b14_scene_search_in_layout", _SEARCH)
def _(t):
    """The same search in a catalogue laid out in space, in folders by quarter."""
    path = scratch(t.spark, "scene_layout")
    Y.write_spatial_index(_clouded(t).withColumn("quarter", F.concat(F.year("date"), F.lit("Q"), F.quarter("date"))), path, ["quarter"])
    found = C.scene_search(t.spark.read.parquet(path), (11856640, 4828160, 11866880, 4838400), "1997-01-01", "1999-01-01", 20)
    return found.select("satellite", "date", "scene_id", "scene_key")


@query(
    "b15_mercator",
    """SELECT province, city, county, township, minx, miny, round(radians(minx)*6378137.0,6)+0.0 AS x, round(ln(tan(pi()/4+radians(miny)/2))*6378137.0,4)+0.0 AS y, round(minx,6)+0.0 AS lon, round(miny,6)+0.0 AS lat FROM fx_areas""",
)
def _(t):
    x, y = S.mercator_x("minx"), S.mercator_y("miny")
    return t["fx_areas"].select("province", "city", "county", "township", "minx", "miny", r6(x).alias("x"), (F.round(y, 4) + 0.0).alias("y"), r6(S.inverse_mercator_lon(x)).alias("lon"), r6(S.inverse_mercator_lat(y)).alias("lat"))


@query("b16_utm_epsg", "SELECT province, city, county, township, minx, miny, 'EPSG:326'||lpad(CAST(CAST(floor((minx+180)/6)+1 AS INTEGER) AS VARCHAR),2,'0') AS epsg FROM fx_areas")
def _(t):
    return t["fx_areas"].select("province", "city", "county", "township", "minx", "miny", S.utm_epsg("minx").alias("epsg"))


@query("b17_clamp_roi", "SELECT province, city, county, township, minx, round(greatest(minx,(minx+maxx)/2-0.05),6)+0.0 AS lo, round(least(maxx,(minx+maxx)/2+0.05),6)+0.0 AS hi FROM fx_areas")
def _(t):
    lo, hi = S.clamp_roi("minx", "maxx")
    return t["fx_areas"].select("province", "city", "county", "township", "minx", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query("b18_log1p_scale", "SELECT patch_id, band, px, round(ln(1+least(greatest(CAST((v-100)*100 AS DOUBLE),0),10000))/10,6)+0.0 AS v FROM fx_pixels")
def _(t):
    return t["fx_pixels"].select("patch_id", "band", "px", r6(S.log1p_scale((F.col("v") - 100) * 100)).alias("v"))


@query(
    "b19_logits",
    """WITH e AS (SELECT patch_id, band, avg(v)/50.0 AS x FROM fx_pixels GROUP BY ALL), m AS (SELECT patch_id, max(x) AS mx FROM e GROUP BY 1), l AS (SELECT patch_id, any_value(mx)+ln(sum(exp(x-mx))) AS lse FROM e JOIN m USING(patch_id) GROUP BY 1)
    SELECT patch_id, CAST(arg_min(band, struct_pack(a:=-x, b:=band)) AS INTEGER) AS best, round(max(1/(1+exp(-x))),6)+0.0 AS p, round(max(x-lse),6)+0.0 AS logp FROM e JOIN l USING(patch_id) GROUP BY patch_id""",
)
def _(t):
    e = t["fx_pixels"].groupBy("patch_id", "band").agg((F.avg("v") / 50.0).alias("x"))
    a = e.groupBy("patch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "x"))), lambda s: s["x"]).alias("x"))
    return a.select("patch_id", S.argmax("x").alias("best"), r6(S.sigmoid(F.array_max("x"))).alias("p"), r6(F.array_max(S.log_softmax("x"))).alias("logp"))


@query("b20_valid_patches", "SELECT patch_id, n FROM (SELECT patch_id, count(*) AS n FROM fx_pixels WHERE NOT (patch_id%7=0 AND px=3) GROUP BY 1) WHERE n=64 ORDER BY patch_id LIMIT 100")
def _(t):
    p = t["fx_pixels"].where("NOT (patch_id % 7 = 0 AND px = 3)").groupBy("patch_id").agg(F.count("*").alias("n"))
    return p.where("n = 64").orderBy("patch_id").limit(100)
