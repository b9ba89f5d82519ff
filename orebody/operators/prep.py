"""Preprocessing. `fit_*` gives a one-row table of parameters; `apply_*` joins it to any table. One row of a few
numbers per column is what gets broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..functions.lineage import settle
from ..functions.ordering import order_statistics, running_totals


def _with(df: DataFrame, params: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(params))  # params: one row


def fit_fill(df: DataFrame, columns: dict[str, str], exact: bool = True) -> DataFrame:
    """columns: name -> mean, median or mode (the smallest of equally frequent values). Medians are exact, from counts of
    distinct values, or with exact=False within 1/10,000 of a rank. A mode is that of counted values, too."""
    out = df.agg(*(F.avg(c).alias(f"{c}_fill") for c, k in columns.items() if k == "mean"), F.lit(0).alias("none_"))
    for c, k in columns.items():
        if k == "median" and exact:
            one = order_statistics(df, [c], [0.5]).agg(F.max(F.col("q")[0]).alias(f"{c}_fill"))
        elif k == "median":
            one = df.agg(F.percentile_approx(c, 0.5, 10_000).alias(f"{c}_fill"))
        elif k == "mode":
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v_")).agg(F.count("*").alias("n_"))
            one = counts.agg(F.min(F.struct((-F.col("n_")).alias("n_"), "v_")).alias("b_")).select(F.col("b_.v_").alias(f"{c}_fill"))
        elif k == "mean":
            continue
        else:
            raise ValueError(f"unknown kind {k!r}")
        out = out.crossJoin(one)  # one row each
    return out.drop("none_")


def apply_fill(df: DataFrame, params: DataFrame) -> DataFrame:
    names = [c.removesuffix("_fill") for c in params.columns]
    out = _with(df, params)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_fill")) for c in names}).drop(*params.columns)


def fill_in_time(df: DataFrame, order: str, value: str, bucket: Column, ties: list[str]) -> DataFrame:
    """Forward fill, then backward fill of what precedes the first value. Rows are filled within buckets of time; a
    table with one row per bucket carries values from bucket to bucket, so no window spans the whole series."""
    rows = df.withColumn("bucket_", bucket)
    keys = (order, *ties)
    # A frame up to a row is carried on from row to row; one from a row on is read again for each. So what follows is
    # taken as what precedes in the order turned round.
    until = lambda *o: Window.partitionBy("bucket_").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(until(*keys))
    first = F.last(value, ignorenulls=True).over(until(*map(F.desc, keys)))
    key = F.struct(order, *ties)
    edges = rows.where(F.col(value).isNotNull()).groupBy("bucket_").agg(
        F.max_by(value, key).alias("out_"), F.min_by(value, key).alias("in_")
    )
    all_buckets = rows.select("bucket_").distinct().join(edges, "bucket_", "left")
    beyond = lambda o: Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    carried = all_buckets.select(
        "bucket_",
        F.last("out_", ignorenulls=True).over(beyond(F.asc("bucket_"))).alias("before_"),
        F.last("in_", ignorenulls=True).over(beyond(F.desc("bucket_"))).alias("after_"),
    )
    filled = rows.withColumn("last_", last).withColumn("first_", first).join(carried, "bucket_")
    return filled.withColumn(value, F.coalesce("last_", "before_", "first_", "after_")).select(*df.columns)


def fit_range(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))


def apply_range(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    """Min-max scaling; a constant column gives 0."""
    out = _with(df, params)
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")), F.col(c) * 0.0) for c in columns}
    return out.withColumns(scaled).drop(*params.columns)


def fit_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation; a deviation of 0 counts as 1."""
    return df.agg(
        *(F.avg(c).alias(f"{c}_mean") for c in columns),
        *(F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_std") for c in columns),
    )


def apply_standard(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    out = _with(df, params)
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).drop(*params.columns)


def undo_standard(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    out = _with(df, params)
    return out.withColumns({c: F.col(c) * F.col(f"{c}_std") + F.col(f"{c}_mean") for c in columns}).drop(*params.columns)


def equal_width(df: DataFrame, column: str, bins: int, name: str) -> DataFrame:
    """Ordinals 0 .. bins-1; the last bin holds its upper edge."""
    x, low, high = F.col(column), F.col(f"{column}_lo"), F.col(f"{column}_hi")
    at = F.floor(F.coalesce(F.try_divide((x - low) * bins, high - low), x * 0.0))
    params = fit_range(df, [column])
    return _with(df, params).withColumn(name, F.least(at, F.lit(bins - 1)).cast("int")).drop(*params.columns)


def equal_frequency(df: DataFrame, column: str, bins: int, name: str) -> DataFrame:
    """Ordinals by quantile cuts: the number of inner cuts that the value exceeds."""
    cuts = order_statistics(df, [column], [k / bins for k in range(1, bins)]).agg(F.max("q").alias("cuts_"))
    return _with(df, cuts).withColumn(name, F.size(F.filter("cuts_", lambda c: c < F.col(column)))).drop("cuts_")


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the codes follow the order of the values. One row per distinct value."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("one_", F.lit(1))
    return running_totals(values, ["value"], "one_", "code").drop("one_")


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    codes = fit_labels(df, column).withColumnsRenamed({"value": "value_", "code": name})
    return df.join(codes, F.col(column) == F.col("value_"), "left").drop("value_")


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """A 0/1 column per value, none left out."""
    return df.withColumns({f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def lag_difference(df: DataFrame, value: str, by: list[str], order: list[str], periods: int, name: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.coalesce(F.col(value) - F.lag(value, periods).over(window), F.lit(0.0)))


def clip_to(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), *b) for c, b in bounds.items()})


def fit_iqr(df: DataFrame, columns: list[str], factor: float = 1.5, by: list[str] | None = None) -> DataFrame:
    found = order_statistics(df, columns, [0.25, 0.75], by)
    quarts = found.groupBy(*(by or [])).agg(*(F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"{c}_q") for c in columns))
    parts = []
    for c in columns:
        q1, q3 = F.col(f"{c}_q")[0], F.col(f"{c}_q")[1]
        parts += [(q1 - factor * (q3 - q1)).alias(f"{c}_low"), (q3 + factor * (q3 - q1)).alias(f"{c}_high")]
    return quarts.select(*(by or []), *parts)


def outlier_report(df: DataFrame, columns: list[str], domain: dict[str, tuple[float, float]], factor: float = 1.5) -> DataFrame:
    """(column, low, high, n_iqr, n_domain, n_z): outside the IQR bounds, outside the domain, over 3 deviations."""
    params = settle(fit_iqr(df, columns, factor).crossJoin(fit_standard(df, columns)))
    wide = _with(df, params).agg(
        *(F.first(p).alias(p) for p in params.columns),
        *(F.count_if((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high"))).alias(f"{c}_n_iqr") for c in columns),
        *(F.count_if((F.col(c) < domain[c][0]) | (F.col(c) > domain[c][1])).alias(f"{c}_n_domain") for c in columns),
        *(F.count_if(F.abs((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")) > 3).alias(f"{c}_n_z") for c in columns),
    )
    rows = [
        F.struct(F.lit(c).alias("column"), *(F.col(f"{c}_{k}").alias(k) for k in ("low", "high", "n_iqr", "n_domain", "n_z")))
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def readiness(df: DataFrame, value: str, time: str, kind: str) -> DataFrame:
    """One row: rows, nulls of the value and their percentage, first and last time, kinds."""
    null = F.count_if(F.col(value).isNull())
    return df.agg(
        F.count("*").alias("n_rows"), null.alias("n_null"), F.round(F.try_divide(100.0 * null, F.count("*")), 4).alias("pct_null"),
        F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count_distinct(kind).alias("n_types"),
    )


def inject_nulls(df: DataFrame, column: str, key: str, every: int, rest: int = 0) -> DataFrame:
    """Null where key mod every = rest."""
    return df.withColumn(column, F.when(F.pmod(F.col(key), F.lit(every)) == rest, None).otherwise(F.col(column)))


def principal_components(df: DataFrame, columns: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """z-scores projected on k principal components (pc1 ..), and their shares of the variance. A component's sign
    makes its largest loading positive. Only the d x d covariance is worked on outside Spark."""
    import numpy as np

    z = apply_standard(df, fit_standard(df, columns), columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = z.agg(*(F.avg(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs)).first()
    cov = np.zeros((len(columns),) * 2)
    for (i, j), v in zip(pairs, got):
        cov[i, j] = cov[j, i] = v
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    loads = vectors[:, order]
    loads = loads * np.sign(loads[np.abs(loads).argmax(axis=0), range(loads.shape[1])])
    scores = [sum((F.col(c) * float(w) for c, w in zip(columns, loads[:, n])), F.lit(0.0)).alias(f"pc{n + 1}") for n in range(loads.shape[1])]
    rest = [c for c in df.columns if c not in columns]
    return z.select(*rest, *scores), (values[order] / values.sum()).tolist()
