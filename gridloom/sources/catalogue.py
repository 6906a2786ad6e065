"""Scene catalogue tables: header and metadata rows, searches, filters, inventories, indexes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .geojson import feature_texts
from .scratch import scratch

# Header words of metadata tables and the columns that they mean, first match first.
HEADERS = [("folder", "folder_name"), ("云", "cloud_cover"), ("传感器", "sensor"), ("sensor", "sensor"), ("时间", "date"), ("date", "date"), ("季度", "quarter")]
LABELS = T.StructType([T.StructField(n, t) for n, t in (("dataset_id", T.StringType()), ("patch_path", T.StringType()), ("label", T.StringType()), ("reviewer", T.StringType()), ("labeled_at", T.TimestampType()))])


def canonicalize_columns(df: DataFrame) -> DataFrame:
    """Headers by their words; without a folder column, the first column is it. A name is given once, to the first that fits."""
    names: dict[str, str] = {}
    for c in df.columns:
        name = next((to for word, to in HEADERS if word in c.lower()), None)
        if name and name not in names.values():
            names[c] = name
    if "folder_name" not in names.values():
        names[df.columns[0]] = "folder_name"
    return df.withColumnsRenamed(names)


def build_scene_catalog(headers: DataFrame, meta: DataFrame, footprints: DataFrame) -> DataFrame:
    """Headers (scene_id, bounds, ...) with metadata by folder name and sidecar footprints; what the name says goes before metadata."""
    m = meta.select(F.col("folder_name").alias("scene_id"), F.col("sensor").alias("_sensor"), F.col("date").cast("date").alias("_date"), "cloud_cover", F.col("quarter").alias("_quarter"))
    box = ["minx", "miny", "maxx", "maxy"]
    f = footprints.select("scene_id", *(F.col(c).alias(f"_{c}") for c in box))
    out = headers.join(m, "scene_id", "left").join(f, "scene_id", "left")
    own = [c for c in headers.columns if c not in ("scene_id", *box)]
    return out.select(
        "scene_id",
        S.parse_satellite("scene_id").alias("satellite"),
        S.parse_sensor("scene_id", "_sensor").alias("sensor"),
        F.coalesce(S.parse_date_strict("scene_id"), "_date").alias("date"),
        F.col("_quarter").alias("quarter"),
        "cloud_cover",
        *own,
        F.when(F.col("_minx").isNotNull(), "sidecar").otherwise("raster").alias("geom_source"),
        *(F.coalesce(f"_{c}", c).alias(c) for c in box),
    )


def filter_catalog(scenes: DataFrame, satellites: list[str] | None = None, quarters: list[str] | None = None, first: int | None = None, order: str = "scene_id") -> DataFrame:
    if satellites:
        scenes = scenes.where(F.col("satellite").isin(satellites))
    if quarters:
        scenes = scenes.where(F.col("quarter").isin(quarters))
    return scenes.orderBy(order).limit(first) if first else scenes


def qc_gate(qc: DataFrame, limit: float = 0.1) -> DataFrame:
    return qc.where(~F.col("low_precision_flag") & F.col("read_ok") & (F.coalesce("center_dark_ratio", F.lit(1.0)) <= limit))


def qc_gate_counts(qc: DataFrame, limit: float = 0.1) -> DataFrame:
    ok = ~F.col("low_precision_flag") & F.col("read_ok") & (F.coalesce("center_dark_ratio", F.lit(1.0)) <= limit)
    return qc.groupBy("gsd_bucket").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_kept"))


def search_areas(areas: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """Areas with the keyword in township, county or city; wildcards in it stay wildcards. Ordered so that the limit is defined."""
    like = f"%{keyword}%"
    full = F.concat_ws("-", "province", "city", "county", "township")
    hit = F.col("township").like(like) | F.col("county").like(like) | F.col("city").like(like)
    return areas.where(hit).withColumn("full_name", full).orderBy("full_name", "minx", "miny").limit(limit)


def available_satellites(satellites: DataFrame, number: str = "norad_number") -> DataFrame:
    return satellites.where(F.col(number).isNotNull())


def scene_search(scenes: DataFrame, bounds: tuple[float, float, float, float], begin: str, end: str, max_cloud: float, source: str = "satellite") -> DataFrame:
    """The first scene of each source that meets the box in [begin, end) with less cloud."""
    x0, y0, x1, y1 = bounds
    hit = (F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0)
    ok = scenes.where(hit & (F.col("date") >= F.lit(begin).cast("date")) & (F.col("date") < F.lit(end).cast("date")) & (F.col("cloud_cover") < max_cloud))
    # The least of a struct is kept by partial aggregation, where a window would bring a whole source to one task.
    return ok.groupBy(source).agg(F.min(F.struct("date", "scene_id", *(c for c in scenes.columns if c not in (source, "date", "scene_id")))).alias("s")).select(source, "s.*")


def read_label_index(df: DataFrame, kind: str) -> DataFrame:
    """A label index of any writer with one name for the label's path; a missing year is null; back-slashes are slashes."""
    names = {"osm_path": "label_path", "lulc_path": "label_path"}
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    if "year" not in df.columns:
        df = df.withColumn("year", F.lit(None).cast("int"))
    return df.select(F.lit(kind).alias("kind"), S.normalize_path("patch_path").alias("patch_path"), S.normalize_path("label_path").alias("label_path"), F.col("year").cast("int").alias("year"))


def write_patch_index(df: DataFrame, path: str) -> None:
    """Partitioned by quarter, so that a filter on it reads only its folders."""
    df.repartition("quarter", F.pmod(F.xxhash64("patch_path"), F.lit(16))).write.partitionBy("quarter").mode("overwrite").parquet(path)


def read_patch_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def manifest(patches: DataFrame) -> DataFrame:
    """One row about an index."""
    return patches.agg(F.count("*").alias("n_patches"), F.countDistinct("scene_id").alias("n_scenes"), F.array_join(F.sort_array(F.collect_set("quarter")), ",").alias("quarters"), F.max("patch_size").alias("patch_size"))


def load_labels(spark: SparkSession, path: str | None) -> DataFrame:
    """Labels, or an empty table of their schema where no path is given or nothing is there."""
    return read_or_empty(spark, path, LABELS) if path else spark.createDataFrame([], LABELS)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of its schema where nothing is at the path. Any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_datasets(patches: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """(dataset, n_patches, modified): patches (dataset, modified) counted, datasets in memory added, newest first."""
    out = patches.groupBy("dataset").agg(F.count("*").alias("n_patches"), F.max("modified").alias("modified"))
    return (out.unionByName(memory) if memory is not None else out).orderBy(F.desc("modified"), "dataset")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A row for each file; contents are read only where a later column needs them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def file_inventory(sizes: DataFrame, size_mb: str = "size_mb") -> DataFrame:
    return sizes.agg(F.count("*").alias("n_files"), F.sum(F.bround(size_mb, 1)).alias("total_mb"), (F.sum(size_mb) / 1024).alias("total_gb"))


def checksums(df: DataFrame, content: Column | str) -> DataFrame:
    return df.withColumn("sha256", F.sha2(S.col(content).cast("binary"), 256))


def worldfile(text: Column | str) -> dict[str, Column]:
    """Pixel sizes and origin of a six-line sidecar text; null unless it has six numbers."""
    lines = F.filter(F.transform(F.split(S.col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    value = lambda k: F.when(F.size(lines) >= 6, F.element_at(lines, k).try_cast("double"))
    return {"px": value(1), "py": value(4), "ulx": value(5), "uly": value(6)}


def corrected_transform(rasters: DataFrame) -> DataFrame:
    """px, py, ulx, uly: from the sidecar where the embedded transform is in pixels (size near 1 in a geographic system)."""
    side = worldfile("worldfile")
    pixels = (F.abs(F.abs("px") - 1) < 1e-6) & F.col("geographic")
    return rasters.withColumns({k: F.when(pixels & v.isNotNull(), v).otherwise(F.col(k)) for k, v in side.items()})


# The two kinds of lines in training logs.
EPOCH_LINE = r"\[([^|]+)\|([^|]+)\|seed=(\d+)\]\s+Epoch\s+(\d+)/\d+\s+loss=([\d.]+)"
RESULT_LINE = r"\[([^|]+)\|([^|]+)\|seed=(\d+)\]\s+OA=([\d.]+)"


def parse_training_logs(lines: DataFrame, line: str = "line") -> DataFrame:
    """method, modality, seed, epoch, loss of epoch lines."""
    part = lambda k: F.regexp_extract(line, EPOCH_LINE, k)
    return lines.where(F.col(line).rlike(EPOCH_LINE)).select(part(1).alias("method"), part(2).alias("modality"), part(3).cast("int").alias("seed"), part(4).cast("int").alias("epoch"), part(5).cast("double").alias("loss"))


def parse_training_results(lines: DataFrame, line: str = "line") -> DataFrame:
    part = lambda k: F.regexp_extract(line, RESULT_LINE, k)
    return lines.where(F.col(line).rlike(RESULT_LINE)).select(part(1).alias("method"), part(2).alias("modality"), part(3).cast("int").alias("seed"), part(4).cast("double").alias("overall_accuracy"))


#: Kinds of JSON numbers.
_NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE")


def read_results(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """JSON result files (an object or an array of objects each) as one table, with the file's stem as batch and each record as a variant, record.

    Records are variants, so files of different columns need no common schema: a field that a record doesn't have, or has as something
    that isn't of the wanted type, is null. fields: names and their types; without it, every name found in any record: numbers as double, booleans as such,
    and anything else, also a name with values of several kinds, as string. Text that is no JSON, and records that are no objects, give no rows.
    """
    files_ = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("batch"), F.try_parse_json("value").alias("v"))
    several = F.expr("try_cast(v AS array<variant>)")
    records = files_.select("batch", F.explode(F.coalesce(several, F.array("v"))).alias("record")).where("try_cast(record AS map<string, variant>) IS NOT NULL")
    if fields is None:
        # A row for each name and kind: names of columns, whose number doesn't grow with the records.
        each = records.select(F.explode(F.expr("try_cast(record AS map<string, variant>)")).alias("name", "value"))
        kinds: dict[str, set[str]] = {}
        for name, kind in each.select("name", F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0).alias("kind")).distinct().collect():
            kinds.setdefault(name, set()).add("DOUBLE" if kind in _NUMBERS else kind)
        kinds = {n: k - {"VOID"} for n, k in kinds.items()}
        fields = {n: "double" if k == {"DOUBLE"} else "boolean" if k == {"BOOLEAN"} else "string" for n, k in sorted(kinds.items())}
    own = F.expr("try_cast(record AS map<string, variant>)")
    return records.select("batch", *(F.try_variant_get(F.try_element_at(own, F.lit(n)), F.lit("$"), t).alias(n) for n, t in fields.items()), "record")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row for each feature of the FeatureCollections at a path: its properties as columns and its geometry's type and rings. One collection is read by many tasks."""
    lines = scratch(spark, "features")
    feature_texts(spark, path).write.text(lines, compression="gzip")
    return read_geojson_lines(spark, lines)


def geojson_features(df: DataFrame, kind: str, coordinates: Column, properties: list[str]) -> DataFrame:
    """(value): the text of each row's feature."""
    geometry = F.named_struct(F.lit("type"), F.lit(kind), F.lit("coordinates"), coordinates)
    feature = F.named_struct(F.lit("type"), F.lit("Feature"), F.lit("geometry"), geometry, F.lit("properties"), F.struct(*properties))
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, kind: str, coordinates: Column, properties: list[str]) -> None:
    """A line for each feature, written by all tasks: the form of GeoJSON that can be split and read by many."""
    geojson_features(df, kind, coordinates, properties).write.text(path)


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """read_geojson() of files with a feature on each line."""
    schema = spark.read.json(path).schema
    if "properties" not in schema.names or "geometry" not in schema.names:
        return spark.createDataFrame([], "geometry_type string, coordinates string")
    return spark.read.schema(schema).json(path).where("type = 'Feature'").select("properties.*", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))


def point_feature(lon: Column | str, lat: Column | str, properties: dict[str, Column]) -> Column:
    """A GeoJSON point: coordinates to 6 digits, numbers among the properties to 4 as given."""
    point = F.named_struct(F.lit("type"), F.lit("Point"), F.lit("coordinates"), F.array(F.round(S.col(lon), 6), F.round(S.col(lat), 6)))
    own = F.named_struct(*(x for k, v in properties.items() for x in (F.lit(k), v)))
    return F.to_json(F.named_struct(F.lit("type"), F.lit("Feature"), F.lit("geometry"), point, F.lit("properties"), own))


def write_geojson_points(df: DataFrame, path: str, lon: str, lat: str, properties: list[str]) -> None:
    """Newline-delimited features, written by all tasks."""
    df.select(point_feature(lon, lat, {p: F.col(p) for p in properties}).alias("value")).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)

