"""Fixture views: inputs of the operators' shapes, made from the base tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _views() -> dict[str, str]:
    text = Path(__file__).with_suffix(".sql").read_text(encoding="utf-8")
    return dict(re.findall(r"^-- view (fx_\w+)\n(.*?)(?=^-- view |\Z)", text, re.M | re.S))


VIEWS = _views()
SPARK = {k.removesuffix("_spark"): v for k, v in VIEWS.items() if not k.endswith("_duck")}
DUCK = {k.removesuffix("_duck"): v for k, v in VIEWS.items() if not k.endswith("_spark")}
ORDER = ["fx_scenes", "fx_patches", "fx_pixels", "fx_preds", "fx_runs", "fx_ways", "fx_logs", "fx_areas", "fx_patch_vec"]


class Tables:
    """The base tables of a folder and the fixture views on them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                uses = [n for n in (*BASE, *ORDER) if n != name and re.search(rf"\b{n}\b", SPARK[name])]
                for n in uses:
                    self[n].createOrReplaceTempView(n)
                self._made[name] = self.spark.sql(SPARK[name])
        return self._made[name]

    def of_quarters(self, *quarters: str) -> Tables:
        """The tables with fx_patches of the scenes that these quarters have, stored; lineitem's other rows aren't moved to make them.

        A scene_key that has other quarters too keeps their patches. A patch's path names its scene_key, so fx_patch_vec of these paths is whole.
        """
        some = Tables(self.spark, self.sf_dir)
        # Stored, so the planner knows how many they are.
        keys = stored(self["fx_scenes"].where(F.col("quarter").isin(*quarters)).select("scene_key").distinct(), "scenes")
        some._made["lineitem"] = self["lineitem"].join(keys, F.col("l_orderkey") == F.col("scene_key"), "left_semi")
        some._made["fx_patches"] = stored(some["fx_patches"].drop("scene_id"), "patches", compression="zstd")
        return some


def with_fixtures(sql: str) -> str:
    """DuckDB SQL with the views it names put before it as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in ORDER:
            if n not in need and re.search(rf"\b{n}\b", text):
                add(DUCK[n])
                if n not in need:
                    need.append(n)

    add(sql)
    sql = sql.strip()
    ctes = [f"{n} AS ({DUCK[n].strip()})" for n in need]
    if not ctes:
        return sql
    rest = sql[5:] if sql.upper().startswith("WITH ") else ""
    return f"WITH {', '.join(ctes)}" + (f", {rest}" if rest else f" {sql}")
