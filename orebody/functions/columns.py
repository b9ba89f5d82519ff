"""Column expressions: scaling, clipping, buckets, weather features, vectors and sets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least would skip it)."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def right_closed(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label k for edges[k] < x <= edges[k+1]; null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((x > low) & (x <= high), F.lit(label)).otherwise(out)
    return out


def map_values(x: Column, mapping: dict) -> Column:
    """Null for values that the mapping lacks."""
    out = F.lit(None)
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)).otherwise(out)
    return out


def strip(x: Column) -> Column:
    """Removes every kind of white space at both ends (trim removes the space character alone)."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")


def cast_lenient(x: Column, kind: str) -> Column:
    """'datetime' and 'float' give null for what cannot be read; 'int' gives 0 and drops decimals."""
    if kind == "datetime":
        return F.try_to_timestamp(x)
    number = x.cast("string").try_cast("double")
    if kind == "float":
        return number
    if kind == "int":
        return F.coalesce(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)), F.lit(0)).cast("long")
    raise ValueError(f"unknown kind {kind!r}")


def whole_days(now: Column, then: Column) -> Column:
    """Elapsed days, floored."""
    return F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000)).cast("long")


def cyclical(x: Column, period: float) -> tuple[Column, Column]:
    return F.sin(2 * math.pi * x / period), F.cos(2 * math.pi * x / period)


def heat_index(t: Column, rh: Column) -> Column:
    """Rothfusz regression in Celsius where t >= 27 and rh >= 40, else t."""
    # Fixed values of the published regression.
    full = (
        F.lit(-8.78469475556) + 1.61139411 * t + 2.33854883889 * rh - 0.14611605 * t * rh - 0.012308094 * t * t
        - 0.0164248277778 * rh * rh + 0.002211732 * t * t * rh + 0.00072546 * t * rh * rh - 0.000003582 * t * t * rh * rh
    )
    return F.when((t >= 27) & (rh >= 40), full).otherwise(t)


def dew_point(t: Column, rh: Column) -> Column:
    """Magnus formula; humidity is held within [0.01, 100]."""
    a, b = 17.625, 243.04  # fixed values of the formula
    g = F.log(clip(rh, 0.01, 100.0) / 100) + a * t / (b + t)
    return b * g / (a - g)


def kmh(metres_a_second: Column) -> Column:
    return metres_a_second * 3.6


def wind_chill(t: Column, kmh: Column) -> Column:
    # Fixed values of the published formula.
    v = F.pow(kmh, 0.16)
    return F.when((t <= 10) & (kmh >= 4.8), 13.12 + 0.6215 * t - 11.37 * v + 0.3965 * t * v).otherwise(t)


def discomfort(t: Column, dew: Column) -> Column:
    return 0.4 * (t + dew) + 4.8


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return total(_pairs(a, b, lambda x, y: x * y))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(_pairs(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_pairs(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    if math.isinf(p):
        return chebyshev(a, b)
    return F.pow(total(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def hamming(a: Column, b: Column) -> Column:
    """Share of differing characters; unequal lengths are an error."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), differ / F.length(a)).otherwise(
        F.raise_error(F.lit("strings of unequal length")).cast("double")
    )


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    n = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.coalesce(F.try_divide(2 * F.size(F.array_intersect(a, b)), n), F.lit(0.0))


def kl_divergence(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """Natural log; eps is added and both are scaled to sum 1."""
    p, q = (F.transform(v, lambda x: x + eps) for v in (p, q))
    sp, sq = total(p), total(q)
    return total(F.zip_with(p, q, lambda x, y: x / sp * F.log((x / sp) / (y / sq))))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
