"""Splits and folds by rank in a reproducible pseudo-random order of the key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ranked


def _sizes(df: DataFrame, label: str | None) -> DataFrame:
    return df.groupBy(*([F.col(label).alias("label_")] if label else [])).agg(F.count("*").alias("size_"))


def holdout(df: DataFrame, key: str, share: float = 0.7, label: str | None = None, name: str = "split") -> DataFrame:
    """'train' for the first ceil(share * n) rows (of each label, if given), else 'test'."""
    rows = ranked(df, key, [label] if label else None)
    sizes = _sizes(df, label)
    joined = rows.join(sizes, F.col(label).eqNullSafe(F.col("label_"))) if label else rows.crossJoin(F.broadcast(sizes))
    cut = F.ceil(F.round(F.col("size_") * share, 6))
    return joined.withColumn(name, F.when(F.col("rank_") <= cut, "train").otherwise("test")).select(*df.columns, name)


def three_way(df: DataFrame, key: str, train: float = 0.7, validation: float = 0.15, name: str = "split") -> DataFrame:
    rows = ranked(df, key).crossJoin(F.broadcast(_sizes(df, None)))
    first = F.floor(F.round(F.col("size_") * train, 6))
    second = F.floor(F.round(F.col("size_") * (train + validation), 6))
    part = F.when(F.col("rank_") <= first, "train").when(F.col("rank_") <= second, "val").otherwise("test")
    return rows.withColumn(name, part).select(*df.columns, name)


def folds(df: DataFrame, key: str, k: int = 10, label: str | None = None, name: str = "fold") -> DataFrame:
    rows = ranked(df, key, [label] if label else None)
    return rows.withColumn(name, ((F.col("rank_") - 1) % k).cast("int")).select(*df.columns, name)


def train_rows(n: int, share: float) -> int:
    return math.ceil(round(n * share, 6))
