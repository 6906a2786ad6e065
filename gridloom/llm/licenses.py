"""Licence scans: sparse TF-IDF cosine of licence notices to templates, then inheritance from the nearest directory above.

A file's units are its lines and paragraphs that read like a licence notice and, for a file that its name says is a licence file, the
whole text. Each unit is a sparse vector of term counts times inverse document frequencies over the templates, and takes the template
with the largest cosine, from THRESHOLD on. Two kinds of terms decide by themselves: an SPDX tag names its licence, and a template of
a licence with versions is only held against units that name its version. A file
without a licence of its own inherits that of the nearest directory, its own or above, that has a licence file:
directories are joined to their ancestors by path.

The texts are read once, for their units, which are stored; equal units of all files are scored once, so a notice that a third of
all files carry is one row there, and directories rather than files are resolved.

Defined results: a null text has no units, a null path is in no directory, and both leave the row there without a licence
(origin `none`). Equal cosines go to the licence first in order; in a directory with several licence files, the one with the
larger cosine counts, then the licence first in order. Rows with equal doc_id and path count together and each get a row. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, written
from .license_texts import TEMPLATES

THRESHOLD = 0.6
#: Lines and paragraphs that are looked at, and names of licence files.
NOTICE = "(?i)licen[cs]e|spdx|copyright|public domain|permission is (?:hereby )?granted|all rights reserved|redistribution and use"
LICENCE_NAME = "(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: An SPDX tag's licence, without what it says about later versions.
SPDX = r"(?i)SPDX-License-Identifier:\s*\(?([A-Za-z0-9.-]*?)(?:-only|-or-later|\+)?(?:[^A-Za-z0-9.+-]|$)"
#: A number as versions are written; a zero after the point says nothing.
VERSION = r"(?:^|[^a-z0-9.]|v|v\. ?)([0-9]+(?:\.[0-9]+)?)"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, name, version, text) for k, (name, version, text) in enumerate(TEMPLATES)], "template int, license_id string, version string, text string")


def _terms(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, term, tf."""
    return df.select(*key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term")).groupBy(*key, "term").agg(F.count("*").cast("double").alias("tf"))


def versions(text: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(VERSION), F.lit(1)), lambda v: F.regexp_replace(v, r"\.0$", "")))


def similarities(units: DataFrame, key: str, text: str = "unit") -> DataFrame:
    """key, license_id, score: the SPDX tag's licence with 1, or the best template of each unit, whatever its cosine (rounded to 6 digits); units without a shared term have none.

    A row for each unit is expected, under a key of its own.
    """
    spark = units.sparkSession
    patterns = templates(spark)
    n = len(TEMPLATES)
    t = _terms(patterns, ["template", "license_id", "version"], "text")
    idf = t.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    weighed = t.join(idf, "term").select("template", "license_id", "version", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighed = weighed.join(norms, "template").select("template", "license_id", "version", "term", (F.col("w") / F.col("norm")).alias("w"))
    tag = F.nullif(F.regexp_extract(text, SPDX, 1), F.lit(""))
    tagged = units.select(key, tag.alias("license_id"), F.lit(1.0).alias("score")).where("license_id is not null")
    rest = units.where(tag.isNull())
    # The template tables have a fixed number of rows.
    own = _terms(rest, [key], text).join(F.broadcast(idf), "term", "left")
    own = own.withColumn("u", F.col("tf") * F.coalesce("idf", F.lit(0.0) + F.log(F.lit(1.0 + n)) + 1.0))
    sized = own.groupBy(key).agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("size"))
    dots = own.join(F.broadcast(weighed), "term").groupBy(key, "template", "license_id", "version").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    named = rest.select(key, versions(text).alias("versions"))
    fits = F.col("version").isNull() | F.array_contains("versions", F.col("version"))
    scored = dots.join(named, key).where(fits).join(sized, key).select(key, "license_id", F.round(F.col("dot") / F.col("size"), 6).alias("score"))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("score"), "license_id")).alias("b"))
    return best.select(key, "b.license_id", (-F.col("b.score")).alias("score")).unionByName(tagged)


def as_files(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: source / last digit of doc_id / digit before it / name. A text of at most 60 words with a notice is a licence
    file, and lies in its source's folder, the one below, or the lowest, by doc_id modulo 3."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    digit = lambda n: F.pmod(F.floor(F.col("doc_id") / n), F.lit(10)).cast("string")
    is_file = (words <= 60) & F.col("text").rlike(NOTICE)
    name = F.when(is_file, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    depth = F.when(is_file, F.pmod("doc_id", F.lit(3)).cast("int") + 1).otherwise(F.lit(3))
    folder = F.array_join(F.slice(F.array(F.coalesce("source", F.lit("none")), digit(1), digit(10)), F.lit(1), depth), "/")
    return docs.select("doc_id", F.concat(folder, F.lit("/"), name).alias("path"), "text")


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, path, license_id, score, origin (header, file, inherited, none): a row for each row of files."""
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    rows = files.select(F.col(key).alias("doc_id"), F.col(path).alias("path"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"folder": folder, "is_file": F.coalesce(name.rlike(LICENCE_NAME), F.lit(False))})
    lines = F.filter(F.concat(F.split("text", "\n"), F.split("text", r"\n\s*\n")), lambda x: x.rlike(NOTICE))
    whole = F.array_distinct(F.when(F.col("is_file"), F.concat(lines, F.array("text"))).otherwise(lines))
    seen = F.col("doc_id").isNotNull() & F.col("path").isNotNull() & F.coalesce(F.col("text").rlike(NOTICE), F.lit(False))
    rows = written(rows.select("doc_id", "path", "folder", "is_file", F.when(seen, whole).alias("units")), "units")
    units = rows.select("doc_id", "path", "folder", "is_file", F.explode("units").alias("unit")).withColumn("digest", F.md5("unit"))
    best = checkpointed(similarities(units.groupBy("digest").agg(F.first("unit").alias("unit")), "digest").where(F.col("score") >= threshold))
    # Of a file's units the best one; the licence first in order among equals.
    found = units.drop("unit").join(best, "digest").groupBy("doc_id", "path", "folder", "is_file").agg(F.min(F.struct((-F.col("score")).alias("score"), "license_id")).alias("b"))
    own = checkpointed(found.select("doc_id", "path", "folder", "is_file", "b.license_id", (-F.col("b.score")).alias("score")))
    # A directory's licence, and for every directory with files the nearest one above it that has a licence.
    given = own.where("is_file").groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("score"), "license_id")).alias("b")).select(F.col("folder").alias("up"), "b.license_id", (-F.col("b.score")).alias("score"))
    folders = rows.select("folder").where("folder is not null").distinct()
    above = folders.select("folder", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/"))), lambda n: F.array_join(F.slice(F.split("folder", "/"), 1, n), "/"))).alias("depth", "up"))
    found = above.join(given, "up")
    nearest = checkpointed(found.groupBy("folder").agg(F.max_by(F.struct("license_id", "score"), "depth").alias("up")).select("folder", F.col("up.license_id").alias("up_license"), F.col("up.score").alias("up_score")))
    out = rows.drop("units").join(own.select("doc_id", "path", "license_id", "score"), ["doc_id", "path"], "left").join(nearest, "folder", "left")
    has = F.col("license_id").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license_id", "up_license").alias("license_id"),
        F.coalesce("score", "up_score", F.lit(0.0)).alias("score"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("up_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
    )


_quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_VALUES = ", ".join(f"({k}, {_quoted(name)}, {_quoted(version)}, {_quoted(text)})" for k, (name, version, text) in enumerate(TEMPLATES))
#: DuckDB SQL for the rows of op7.
ORACLE = rf"""
WITH tpl(template, license_id, version, text) AS (VALUES {_VALUES}),
d AS (SELECT doc_id, text, coalesce(source,'none') AS s, ((doc_id%10)+10)%10 AS a, ((CAST(floor(doc_id/10) AS BIGINT)%10)+10)%10 AS b,
  coalesce(len(list_filter(regexp_split_to_array(text,'\s+'), lambda w: w<>''))<=60 AND regexp_matches(text,'{NOTICE}'), false) AS is_file FROM documents),
e AS (SELECT *, CASE WHEN NOT is_file OR ((doc_id%3)+3)%3=2 THEN s||'/'||a||'/'||b WHEN ((doc_id%3)+3)%3=1 THEN s||'/'||a ELSE s END AS folder FROM d),
f AS (SELECT *, folder||'/'||CASE WHEN is_file THEN 'LICENSE.'||doc_id ELSE doc_id||'.txt' END AS path FROM e),
u AS (SELECT DISTINCT doc_id, path, folder, is_file, unit FROM (
  SELECT doc_id, path, folder, is_file, unnest(list_filter(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n\s*\n')), lambda x: regexp_matches(x,'{NOTICE}'))) AS unit FROM f
  UNION ALL SELECT doc_id, path, folder, is_file, text FROM f WHERE is_file)),
k AS (SELECT unit, nullif(regexp_extract(unit,'{SPDX}',1),'') AS tag, list_transform(regexp_extract_all(lower(unit),'{VERSION}',1), lambda v: regexp_replace(v,'\.0$','')) AS vs FROM (SELECT DISTINCT unit FROM u)),
tt AS (SELECT template, license_id, version, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT template, license_id, version, unnest(regexp_extract_all(lower(text),'{TERM}')) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln({len(TEMPLATES) + 1}.0::DOUBLE/(1.0+count(*)))+1.0 AS idf FROM tt GROUP BY term),
tw AS (SELECT template, license_id, version, term, tf*idf AS w FROM tt JOIN idf USING(term)),
tn AS (SELECT template, sqrt(sum(w*w)) AS norm FROM tw GROUP BY 1),
ut AS (SELECT unit, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit),'{TERM}')) AS term FROM k WHERE tag IS NULL) GROUP BY ALL),
uw AS (SELECT unit, ut.term, tf*coalesce(idf, ln({len(TEMPLATES) + 1}.0::DOUBLE)+1.0) AS w FROM ut LEFT JOIN idf ON idf.term=ut.term),
un AS (SELECT unit, sqrt(sum(w*w)) AS size FROM uw GROUP BY ALL),
dt AS (SELECT uw.unit, template, license_id, version, sum(uw.w*tw.w/norm)/any_value(size) AS c FROM uw JOIN tw ON tw.term=uw.term JOIN tn USING(template) JOIN un ON un.unit=uw.unit GROUP BY uw.unit, template, license_id, version),
s AS (SELECT unit, license_id, round(c, 6) AS score FROM dt JOIN k USING(unit) WHERE version IS NULL OR list_contains(vs, version) UNION ALL SELECT unit, tag, 1.0 FROM k WHERE tag IS NOT NULL),
o AS (SELECT doc_id, path, folder, is_file, license_id, score FROM u JOIN s USING(unit) WHERE score>={THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, license_id)=1),
g AS (SELECT folder, license_id, score FROM o WHERE is_file QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, license_id)=1),
n AS (SELECT fd.folder, g.license_id, g.score FROM (SELECT DISTINCT folder FROM f) fd JOIN g ON g.folder=fd.folder OR starts_with(fd.folder, g.folder||'/') QUALIFY row_number() OVER (PARTITION BY fd.folder ORDER BY length(g.folder) DESC)=1)
SELECT f.doc_id, f.path, coalesce(o.license_id, n.license_id) AS license_id, coalesce(o.score, n.score, 0.0) AS score,
 CASE WHEN o.license_id IS NOT NULL AND f.is_file THEN 'file' WHEN o.license_id IS NOT NULL THEN 'header' WHEN n.license_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM f LEFT JOIN o ON o.doc_id=f.doc_id AND o.path=f.path LEFT JOIN n ON n.folder=f.folder
"""
