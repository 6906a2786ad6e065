"""Scalar functions of the catalogue, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of scene names, and words in paths that mark products of low precision.
SATELLITE = r"^([A-Z0-9]+)_(\d+)_"
SENSOR = r"_([A-Z]{3}\d*|NAD|PMS\d*|0PMS\d+)_"
DATE_STRICT = r"_(\d{8})\d{6}_"
DATE_LOOSE = r"_(\d{8})(?:\d{6})?_"
LOW_PRECISION = ["低精度", "低精", "预处理", "中间"]
METRES_PER_DEGREE = 111_320.0
EARTH_RADIUS = 6378137.0
GSD_BUCKETS = [(0.5, "sub_meter"), (1.5, "sub_1p5m"), (2.5, "around_2m")]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_group(c: Column | str, pattern: str) -> Column:
    """The first match's group, null where there is none."""
    return F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit(""))


def parse_satellite(name: Column | str) -> Column:
    return F.coalesce(first_group(name, SATELLITE), F.split(col(name), "_")[0])


def parse_sensor(name: Column | str, fallback: Column | str | None = None) -> Column:
    """The sensor in a name; an empty fallback counts as missing."""
    found = first_group(name, SENSOR)
    return found if fallback is None else F.coalesce(found, F.nullif(col(fallback), F.lit("")))


def parse_date_strict(name: Column | str) -> Column:
    """The date before a six-digit time."""
    return F.try_to_date(first_group(name, DATE_STRICT), "yyyyMMdd")


def reparse_date(name: Column | str, fallback: Column | str | None = None) -> Column:
    """The first eight digits between underscores if they are in 1900..2100, else the fallback."""
    digits = first_group(name, DATE_LOOSE)
    date = F.when(digits.cast("int").between(19000000, 21000000), F.try_to_date(digits, "yyyyMMdd"))
    return date if fallback is None else F.coalesce(date, col(fallback))


def gsd_bucket(gsd: Column | str) -> Column:
    out = None
    for limit, name in GSD_BUCKETS:
        out = (F if out is None else out).when(col(gsd) < limit, name)
    return out.when(col(gsd).isNotNull(), "coarse")


def low_precision_flag(path: Column | str) -> Column:
    return col(path).rlike("|".join(LOW_PRECISION))


def approx_gsd_m(degrees: Column | str, lat: Column | str) -> Column:
    return col(degrees) * METRES_PER_DEGREE * F.cos(F.radians(col(lat)))


def normalize_path(path: Column | str) -> Column:
    return F.translate(col(path), "\\", "/")


def mercator_x(lon: Column | str) -> Column:
    return F.radians(col(lon)) * EARTH_RADIUS


def mercator_y(lat: Column | str) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2)) * EARTH_RADIUS


def inverse_mercator_lon(x: Column | str) -> Column:
    return F.degrees(col(x) / EARTH_RADIUS)


def inverse_mercator_lat(y: Column | str) -> Column:
    return F.degrees(F.atan(F.exp(col(y) / EARTH_RADIUS)) * 2 - F.lit(math.pi / 2))


def utm_epsg(lon: Column | str) -> Column:
    """The northern UTM zone of a longitude."""
    return F.concat(F.lit("EPSG:326"), F.lpad((F.floor((col(lon) + 180) / 6) + 1).cast("string"), 2, "0"))


def clamp_roi(lo: Column | str, hi: Column | str, half: float = 0.05) -> tuple[Column, Column]:
    """An interval shrunk to `half` on either side of its centre where it is wider."""
    centre = (col(lo) + col(hi)) / 2
    return F.greatest(col(lo), centre - half), F.least(col(hi), centre + half)


def log1p_scale(v: Column | str) -> Column:
    """NaN as 0, clipped to 0..10000, then log1p over 10."""
    return F.log1p(F.least(F.greatest(F.nanvl(col(v).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(10000.0))) / 10


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def log_softmax(logits: Column | str) -> Column:
    """Of an array, shifted by its maximum."""
    top = F.array_max(col(logits))
    total = F.aggregate(col(logits), F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(col(logits), lambda x: x - top - F.log(total))


def argmax(values: Column | str) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(col(values), F.array_max(col(values))) - 1).cast("int")


# Parts of source names and the scores that they stand for.
OPTICAL = ["sentinel2", "landsat", "gaofen", "gf", "zy", "hj", ".tif"]
FINE = ["sentinel2", "gaofen", "gf", "jilin", "zy", "hj", ".tif"]
RADAR = ["sentinel1", "gaofen3", "gf3", "alos"]


def suitability(sources: Column | str) -> dict[str, Column]:
    """Rule scores of a list of sources and what to change; names are compared in lower case without spaces and hyphens."""
    plain = F.transform(col(sources), lambda s: F.regexp_replace(F.lower(s), "[ -]", ""))
    any_of = lambda words: F.exists(plain, lambda s: s.rlike("|".join(w.replace(".", r"\.") for w in words)))
    optical, radar, coarse = any_of(OPTICAL), any_of(RADAR), any_of(["modis"])
    scores = {
        "spectral_score": F.when(optical, 90).otherwise(20),
        "resolution_score": F.when(any_of(FINE), 100).when(coarse, 10).otherwise(50),
        "temporal_score": F.when(any_of(["sentinel"]), 85).otherwise(60),
        "modality_score": F.lit(50) + F.when(optical, 20).otherwise(0) + F.when(radar, 30).otherwise(0),
        "readiness_score": F.lit(95),
    }
    total = sum(scores.values(), F.lit(0))
    advice = F.array_compact(F.array(F.when(~optical, "add_optical"), F.when(~radar, "add_radar"), F.when(coarse, "drop_modis")))
    return scores | {"overall_score": F.floor(total / 5).cast("int"), "recommendations": F.when(F.size(advice) == 0, F.array(F.lit("keep"))).otherwise(advice)}
