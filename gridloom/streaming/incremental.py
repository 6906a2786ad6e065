"""Incremental work by Structured Streaming: files that arrive are processed once, a stopped run goes on where it was.

Each micro-batch is written to a folder of its number, replacing what an earlier attempt at it left, so a batch that is
run again after a failure doesn't double its rows. The folders of an index are merged by levels, and Bloom filters say which parts of them
may hold a batch's keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalogue import read_or_empty

PARTS = 1024
#: A Bloom filter's block.
_FILTER = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(f"w{k}", T.LongType()) for k in range(8)), T.StructField("n_blocks", T.LongType())])
#: Folders of a level that become one of the next.
FAN = 4
#: For each batch of the last incremental_index() that asked filters: the number of parts named, by span.
LAST_READ: list[dict[str, int]] = []
#: Progress of the batches of the last run_available(), oldest first.
LAST_PROGRESS: list[dict] = []


def read_stream(spark: SparkSession, source: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)


def table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the batches so far have written, or an empty table."""
    return read_or_empty(spark, path, T.StructType([*schema, T.StructField("batch", T.LongType())]))


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there and returns."""
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LAST_PROGRESS[:] = query.recentProgress


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def spans(spark: SparkSession, out: str) -> list[tuple[int, int]]:
    """The spans of batches (first, last) that hold the index: complete folders that no larger complete one replaces, oldest first."""
    there = {kind: [n for n in _names(spark, f"{out}/{kind}") if "_SUCCESS" in _names(spark, f"{out}/{kind}/{n}")] for kind in ("rows", "filters")}
    whole = [tuple(map(int, n.removeprefix("span=").split("-"))) for n in there["rows"] if n in there["filters"]]
    return sorted(s for s in whole if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in whole))


def vacuum(spark: SparkSession, out: str) -> int:
    """Deletes the folders that larger spans replaced and returns their number; for when nothing reads an older state of the index."""
    live = {f"span={a}-{b}" for a, b in spans(spark, out)}
    old = [n for n in _names(spark, f"{out}/rows") if n not in live]
    for n in old:
        for kind in ("rows", "filters"):
            fs, at = _fs(spark, f"{out}/{kind}/{n}")
            fs.delete(at, True)
    return len(old)


def _block(n_blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned("_hash", 8), n_blocks)


def _bits() -> list[Column]:
    """The bit that a key sets in each of the eight words of its block."""
    return [F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_hash, {k}), 64) as int))") for k in range(8)]


def _filter(keyed: DataFrame, n: int) -> DataFrame:
    """A Bloom filter in blocks as a table: (n_blocks, block, w0..w7). A key sets a bit in each word of one block of 512 bits, 16 bits for each key."""
    blocks = F.lit(max(1, -(-n * 16 // 512))).cast("long")
    words = [F.bit_or(b).alias(f"w{k}") for k, b in enumerate(_bits())]
    return keyed.groupBy(_block(blocks).alias("block")).agg(*words).withColumn("n_blocks", blocks)


def _perhaps(keyed: DataFrame, filters: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(span and the keyed columns) of keys that a span's filter doesn't rule out."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("span"), F.lit(n).cast("long").alias("n_blocks")) for s, n in sizes.items()))).alias("_s")
    asked = keyed.select("*", each).select("*", "_s.span", _block(F.col("_s.n_blocks")).alias("block")).drop("_s")
    held = [(F.col(f"w{k}").bitwiseAND(b)) != 0 for k, b in enumerate(_bits())]
    return asked.join(filters.drop("n_blocks"), ["span", "block"]).where(reduce(and_, held)).select("span", *keyed.columns)


def incremental_index(spark: SparkSession, source: str, schema: T.StructType, rows: Callable[[DataFrame], DataFrame], keys: list[str], out: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Appends rows(new files) whose key isn't in the index yet; returns the index. A checkpoint and an index belong together.

    A batch is a folder of its own, sorted by PARTS of its keys' hash, with a Bloom filter as a table beside it. Keys that no filter
    holds are new without a look at the index; of the rest only the parts are read that a filter named. FAN folders of a level are
    written together as one of the next, so that few are live however many batches there were: a folder counts once it is
    complete, and replaces those that it covers. So a stopped compaction loses nothing, and a batch that is run again is known by its number.
    """
    made = rows(spark.createDataFrame([], schema)).schema
    stored = T.StructType([*made, T.StructField("part", T.IntegerType()), T.StructField("_hash", T.LongType())])

    def at(kind: str, span: tuple[int, int]) -> str:
        return f"{out}/{kind}/span={span[0]}-{span[1]}"

    def held(own: SparkSession, kind: str, live: list[tuple[int, int]]) -> DataFrame:
        """Rows or filters of some spans, with their span; one scan."""
        return own.read.option("basePath", f"{out}/{kind}").schema(T.StructType([*(stored if kind == "rows" else _FILTER), T.StructField("span", T.StringType())])).parquet(*(at(kind, s) for s in live))

    def store(df: DataFrame, span: tuple[int, int]) -> None:
        # Few rows come together in one file, many are spread; in each file a part is a stretch that the reader's bounds find.
        df.select(*stored.names).repartition("part").sortWithinPartitions("part").write.mode("overwrite").parquet(at("rows", span))
        keyed = df.sparkSession.read.schema(stored).parquet(at("rows", span)).select("_hash")
        _filter(keyed, keyed.count()).write.mode("overwrite").partitionBy("n_blocks").parquet(at("filters", span))

    def unseen(new: DataFrame, live: list[tuple[int, int]]) -> DataFrame:
        own = new.sparkSession
        # A filter's number of blocks is the name of its folder; an empty span has none.
        sizes = {f"{a}-{b}": int(n.removeprefix("n_blocks=")) for a, b in live for n in _names(own, at("filters", (a, b))) if n.startswith("n_blocks=")}
        if not sizes:
            return new
        perhaps = _perhaps(new.select("part", "_hash", *keys), held(own, "filters", live), sizes)
        named = perhaps.groupBy("span").agg(F.collect_set("part").alias("parts")).collect()  # at most PARTS numbers for each span
        LAST_READ.append({r["span"]: len(r["parts"]) for r in named})
        if not named:
            return new
        of = [(F.col("span") == r["span"]) & (F.lit(True) if len(r["parts"]) == PARTS else F.col("part").isin(r["parts"])) for r in named]
        known = held(own, "rows", [s for s in live if f"{s[0]}-{s[1]}" in {r["span"] for r in named}]).where(reduce(or_, of))
        known = known.select(F.col("_hash").alias("_k_hash"), *(F.col(k).alias(f"_k_{k}") for k in keys))
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_hash") == F.col("_k_hash"))
        return new.join(known, same, "left_anti")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        live = spans(own, out)
        if not any(a <= number <= b for a, b in live):
            key = F.xxhash64(*keys)
            # rows() may make many of one, and a file may be one task: what arrives is dealt out before, so that no task's keys are those of a whole file.
            dealt = batch.repartition(int(own.conf.get("spark.sql.shuffle.partitions")), *batch.columns)
            new = rows(dealt).dropDuplicates(keys).withColumns({"part": F.pmod(key, F.lit(PARTS)).cast("int"), "_hash": key}).persist(StorageLevel.MEMORY_AND_DISK)
            store(unseen(new, live) if live else new, (number, number))
            new.unpersist()
        compact(own, number)

    def compact(own: SparkSession, number: int) -> None:
        width = FAN
        while (number + 1) % width == 0:
            span = (number + 1 - width, number)
            under = [s for s in spans(own, out) if span[0] <= s[0] and s[1] <= span[1]]
            if len(under) > 1:
                store(held(own, "rows", under).drop("span"), span)
            width *= FAN

    LAST_READ.clear()
    run_available(read_stream(spark, source, schema, files_per_batch), write, checkpoint)
    live = spans(spark, out)
    index = held(spark, "rows", live) if live else spark.createDataFrame([], stored)
    return index.select(*made.names)


def metrics_stream(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, time: str = "ts", late: str = "30 days", window: str = "1 day", files_per_batch: int = 1000) -> DataFrame:
    """(job, epoch): mean rec and uni, total = rec + 0.1 uni, number of steps.

    Steps are summed in windows of their event time, which is a part of the state's key, so the watermark ends the state: a window
    is dropped from it once the latest time seen is `late` after the window's end. What a batch changes is stored, and an epoch is put together
    from the last sums of each of its windows, open or ended. A step that comes when its window has been dropped isn't counted; late_steps() says
    how many of each epoch those are. A step without a time isn't counted either.
    """
    stream = read_stream(spark, source, schema, files_per_batch).withWatermark(time, late)
    sums = stream.groupBy("job", "epoch", F.window(time, window).alias("window")).agg(*(F.sum(c).alias(c) for c in ("rec", "uni")), *(F.count(c).alias(f"n_{c}") for c in ("rec", "uni")), F.count("*").alias("steps"))
    sums = sums.select("job", "epoch", F.col("window.start").alias("begin"), "rec", "uni", "n_rec", "n_uni", "steps")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_available(sums, write, checkpoint, "update")
    own = [("begin", T.TimestampType()), ("rec", T.DoubleType()), ("uni", T.DoubleType()), ("n_rec", T.LongType()), ("n_uni", T.LongType()), ("steps", T.LongType())]
    kind = T.StructType([T.StructField("job", schema["job"].dataType), T.StructField("epoch", schema["epoch"].dataType), *(T.StructField(n, t) for n, t in own)])
    last = table(spark, out, kind).groupBy("job", "epoch", "begin").agg(F.max(F.struct("batch", *(n for n, _ in own[1:]))).alias("m")).select("job", "epoch", "m.*")
    made = last.groupBy("job", "epoch").agg(*((F.sum(c) / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(c) for c in ("rec", "uni")), F.sum("steps").alias("steps"))
    return made.select("job", "epoch", "rec", "uni", (F.col("rec") + 0.1 * F.col("uni")).alias("total"), "steps")


def late_steps(spark: SparkSession, source: str, schema: T.StructType, metrics: DataFrame) -> DataFrame:
    """(job, epoch, late): the steps of the source's files that metrics_stream() came to too late, or without a time, to count. Epochs without such have no row."""
    there = spark.read.schema(schema).parquet(source).groupBy("job", "epoch").agg(F.count("*").alias("_there"))
    counted = metrics.select(F.col("job").alias("_job"), F.col("epoch").alias("_epoch"), "steps")
    met = there.join(counted, F.col("job").eqNullSafe(F.col("_job")) & F.col("epoch").eqNullSafe(F.col("_epoch")), "left")
    return met.select("job", "epoch", (F.col("_there") - F.coalesce("steps", F.lit(0))).alias("late")).where("late > 0")


def remaining_time(metrics: DataFrame, epochs: int, seconds_a_step: float) -> DataFrame:
    """Seconds left of each job: epochs to come times the mean number of steps times the time of a step."""
    done = metrics.groupBy("job").agg(F.max("epoch").alias("epoch"), F.avg("steps").alias("_n"))
    return done.select("job", "epoch", (F.greatest(F.lit(epochs) - F.col("epoch"), F.lit(0)) * F.col("_n") * seconds_a_step).alias("seconds_left"))
