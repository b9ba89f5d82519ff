"""A reproducible pseudo-random order and ranks in it, without a single global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

BUCKETS = 1024
_A, _B, _P = 48_271, 11, 2_147_483_647


def scatter(key: Column) -> Column:
    """A pseudo-random integer in [0, 2^31) of an integer key, from plain arithmetic, so that any SQL engine
    gives the same."""
    return scatter_sql_column(key)


def scatter_sql_column(key: Column) -> Column:
    x = (F.pmod(key.cast("long"), F.lit(_P)) * _A + _B) % _P
    return (x * x + key.cast("long") % 1009) % _P


def scatter_sql(key: str) -> str:
    x = f"((({key} % {_P}) * {_A} + {_B}) % {_P})"
    return f"(({x} * {x} + {key} % 1009) % {_P})"


def ranked(df: DataFrame, key: str, within: list[str] | None = None, name: str = "rank_") -> DataFrame:
    """The rank (from 1) of each row in the scattered order, within groups. The order is uniform, so a slice of its
    range is a bucket: ranks are taken within (group, bucket) and the sizes of the buckets before are added. A group
    of any size is spread over BUCKETS windows; the sizes have BUCKETS rows a group."""
    groups = within or []
    placed = df.withColumn("order_", scatter(F.col(key))).withColumn("slice_", F.floor(F.col("order_") * BUCKETS / _P).cast("int"))
    sizes = placed.groupBy(*groups, "slice_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*groups).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    bases = bases.select(*(F.col(c).alias(f"{c}_b_") for c in groups), F.col("slice_").alias("slice_b_"), "base_")
    inner = Window.partitionBy(*groups, "slice_").orderBy("order_", key)
    on = F.col("slice_") == F.col("slice_b_")
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_b_"))
    out = placed.withColumn("at_", F.row_number().over(inner)).join(bases, on)
    return out.select(*df.columns, (F.col("base_") + F.col("at_")).alias(name))


def running_totals(df: DataFrame, order: list[str], value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """df with the sum of `value` over the rows before each, in an order without ties, within groups. Rows are dealt into
    ranges of the order and cut there; windows run within ranges, and the sums of whole ranges, as many as there are
    shuffle partitions for each group, are added up apart: broadcast without groups, else joined by their keys. No task
    sees a whole group."""
    by = by or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *by, *order).withColumn("range_", F.spark_partition_id()))
    before = lambda *keys, of: Window.partitionBy(*keys).orderBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "range_").agg(F.sum(value).alias("sum_"))
    bases = sums.select(
        *(F.col(c).alias(f"{c}_g_") for c in by), F.col("range_").alias("range_g_"),
        F.coalesce(F.sum("sum_").over(before(*by, of=["range_"])), F.lit(0)).alias("base_"),
    )
    on = F.col("range_") == F.col("range_g_")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_g_"))
    inner = F.coalesce(F.sum(value).over(before(*by, "range_", of=order)), F.lit(0))
    return ranged.withColumn("own_", inner).join(bases if by else F.broadcast(bases), on).select(*df.columns, (F.col("base_") + F.col("own_")).alias(name))


def running_counts(df: DataFrame, order: str, values: list[str], by: list[str]) -> DataFrame:
    """df, with (by, order) once each, and for every value column c the sum bc over the rows before it in its group,
    and next_, the group's next order value. As running_totals: windows run within ranges, and what crosses from one
    range to the next is a row per group and range, joined by its keys."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *by, order).withColumn("range_", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "range_").agg(F.min(order).alias("least_"), *(F.sum(c).alias(f"s{c}") for c in values))
    line = Window.partitionBy(*by).orderBy("range_")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "range_", F.lead("least_").over(line).alias("after_"), *(F.coalesce(F.sum(f"s{c}").over(before), F.lit(0.0)).alias(f"a{c}") for c in values))
    inner = Window.partitionBy(*by, "range_").orderBy(order)
    own = inner.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", F.lead(order).over(inner).alias("near_"), *(F.coalesce(F.sum(c).over(own), F.lit(0.0)).alias(f"o{c}") for c in values))
    return placed.join(bases, [*by, "range_"]).select(*df.columns, F.coalesce("near_", "after_").alias("next_"), *((F.col(f"a{c}") + F.col(f"o{c}")).alias(f"b{c}") for c in values))


def order_statistics(df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by ..., column, q, mode): exact quantiles, interpolated between neighbours, and the most frequent value, the
    smallest of equals. Distinct values are counted first, so a frequent value is one row; a quantile is found by the
    running count, not by holding the values of a group. Columns without a value give none."""
    by = by or []
    long = df.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v_")) for c in columns))))
    counts = long.where("v_ is not null").groupBy(*by, "column", "v_").agg(F.count("*").alias("n_"))
    placed = running_totals(counts, ["v_"], "n_", "before_", [*by, "column"])
    totals = placed.groupBy(*by, "column").agg(F.sum("n_").alias("all_"), F.max_by("v_", F.struct("n_", -F.col("v_"))).alias("mode"))
    totals = totals.withColumnsRenamed({c: f"{c}_t_" for c in [*by, "column"]})
    on = F.lit(True)
    for c in [*by, "column"]:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_t_"))
    rows = placed.join(totals if by else F.broadcast(totals), on)  # a row per group and column
    picks, out = [], []
    for k, share in enumerate(shares):
        at = (F.col("all_") - 1) * F.lit(float(share))
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before_") <= place) & (place < F.col("before_") + F.col("n_"))
            picks.append(F.max(F.when(hit, F.col("v_"))).alias(f"{side}{k}_"))
        out.append(F.col(f"lo{k}_") + (at - F.floor(at)) * (F.col(f"hi{k}_") - F.col(f"lo{k}_")))
    found = rows.groupBy(*by, "column").agg(*picks, F.max("all_").alias("all_"), F.max("mode").alias("mode"))
    return found.select(*by, "column", F.array(*out).alias("q"), "mode")
