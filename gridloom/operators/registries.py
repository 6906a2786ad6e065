"""Registry tables of datasets, training jobs and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_models(models: DataFrame, jobs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Models, newest first, with their dataset's name (or one made from the job's dataset id) and rounded score (0 if none)."""
    j = jobs.select("job_id", "dataset_id")
    d = datasets.select("dataset_id", F.col("dataset_name").alias("_name"))
    out = models.join(j, "job_id", "left").join(d, "dataset_id", "left")
    name = F.coalesce("_name", F.concat(F.lit("Dataset-"), F.substring(F.col("dataset_id").cast("string"), 1, 6)))
    return out.withColumns({"dataset_name": name, "score": F.coalesce(F.bround("score", 2), F.lit(0.0))}).drop("_name").orderBy(F.desc("created_at"), "model_id")


def activate_model(models: DataFrame, model_id) -> DataFrame:
    """Exactly the given model active; an unknown id is an error."""
    if not models.where(F.col("model_id") == model_id).limit(1).count():
        raise KeyError(model_id)
    return models.withColumn("is_active", F.col("model_id") == model_id)


def job_progress(jobs: DataFrame, metrics: str = "metrics") -> DataFrame:
    """status, current epoch, last loss and number of entries from a JSON of arrays, or of a list of entries; one value stands for a list of one.

    Jobs need no common schema: each JSON is a variant, of which a field is taken with the wanted type, and what isn't of it is null. A field
    that is missing, and text that is no JSON, is an empty list.
    """
    m = F.col("_m")
    listed = F.schema_of_variant(m).startswith("ARRAY")

    def field(name: str, kind: str) -> Column:
        own = lambda x, path, t: F.try_variant_get(x, path, t)
        items = F.when(listed, F.transform(own(m, "$", "array<variant>"), lambda x: own(x, f"$.{name}", kind)))
        many = F.transform(own(m, f"$.{name}", "array<variant>"), lambda x: own(x, "$", kind))
        one = own(m, f"$.{name}", kind)
        return F.coalesce(items, many, F.when(one.isNotNull(), F.array(one)), F.array().cast(f"array<{kind}>"))

    last = lambda c: F.when(F.size(c) > 0, F.element_at(c, -1))
    taken = jobs.withColumn("_m", F.try_parse_json(metrics)).withColumns({"_epoch": field("epoch", "int"), "_loss": field("loss", "double")})
    return taken.withColumns({"current_epoch": F.coalesce(last("_epoch"), F.lit(0)), "last_loss": last("_loss"), "n_entries": F.size("_loss")}).drop("_m", "_epoch", "_loss")


def entry_progress(entries: DataFrame, job: str, order: str, epoch: str, loss: str) -> DataFrame:
    """job_progress() of jobs whose entries are rows: the last one's epoch and loss by an order, and their number. Nothing is gathered."""
    last = F.max(F.struct(order, epoch, loss)).alias("_l")
    out = entries.groupBy(job).agg(last, F.count("*").cast("int").alias("n_entries"))
    return out.select(job, F.coalesce(F.col(f"_l.{epoch}"), F.lit(0)).alias("current_epoch"), F.col(f"_l.{loss}").alias("last_loss"), "n_entries")


def register_result(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The next snapshot: of rows with one key, the last written; the new ones come after the old ones."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, order, "_s")]
    return both.groupBy(key).agg(F.max(F.struct("_s", order, *rest)).alias("r")).select(key, F.col(f"r.{order}").alias(order), *(F.col(f"r.{c}").alias(c) for c in rest))
