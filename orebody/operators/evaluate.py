"""Scores of classifiers and clusterings from label columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .blocks import distances, is_own, own_pairs, type_of, vectors


def confusion(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """weight: a column that says how many rows each stands for."""
    n = F.sum(weight) if weight else F.count("*")
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(n.alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(actual) == F.col(predicted)).cast("double")), 6).alias("accuracy"))


def class_report(df: DataFrame, actual: str, predicted: str, count: str | None = None) -> DataFrame:
    """(label, precision, recall, f1, support); 0 for empty denominators. One pass; then a row per class. count: the
    column of rows' numbers, if df has them counted already."""
    cells = confusion(df, actual, predicted)
    if count:
        cells = df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), F.col(count).alias("n"))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen"), F.lit(0).cast("long").alias("hit")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
            )
        )
    )
    s = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "chosen", "hit")))
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("hit", "chosen"), zero), F.coalesce(F.try_divide("hit", "support"), zero)
    s = s.withColumn("p", p).withColumn("r", r).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), zero))
    return s.select("label", *(F.round(a, 6).alias(b) for a, b in (("p", "precision"), ("r", "recall"), ("f", "f1"))), "support")


def averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a class report."""
    n = F.sum("support")
    return report.agg(
        *(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")),
        *(F.round(F.sum(F.col(c) * F.col("support")) / n, 6).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")),
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = lambda n: F.col(n).cast("double") * (F.col(n) - 1) / 2
    cells = df.groupBy(F.col(a).alias("a_"), F.col(b).alias("b_")).agg(F.count("*").alias("n_"))
    rows = cells.groupBy("a_").agg(F.sum("n_").alias("n_")).agg(F.sum(pairs("n_")).alias("sa_"), F.sum("n_").alias("t_"))
    cols = cells.groupBy("b_").agg(F.sum("n_").alias("n_")).agg(F.sum(pairs("n_")).alias("sb_"))
    both = cells.agg(F.sum(pairs("n_")).alias("s_")).crossJoin(rows).crossJoin(cols)
    chance = F.col("sa_") * F.col("sb_") / pairs("t_")
    top, bottom = F.col("s_") - chance, (F.col("sa_") + F.col("sb_")) / 2 - chance
    return both.select(F.round(F.coalesce(F.try_divide(top, bottom), F.lit(1.0)), 6).alias("ari"))


def dominant_clusters(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """(label, cluster, hits): each class's most frequent cluster, the lowest on ties."""
    cells = df.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("hits"))
    best = Window.partitionBy("label").orderBy(F.desc("hits"), "cluster")
    return cells.withColumn("r_", F.row_number().over(best)).where("r_ = 1").drop("r_")


def calinski_harabasz(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Between and within sums of squares from one aggregation by cluster; variances, not sums of squares, so large
    values cancel nothing."""
    sums = df.groupBy(cluster).agg(F.count("*").alias("n_"), *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.var_pop(c).alias(f"v_{c}") for c in columns))
    all_ = sums.agg(F.sum("n_").alias("t_"), *((F.sum(F.col("n_") * F.col(f"m_{c}")) / F.sum("n_")).alias(f"c_{c}") for c in columns))
    within = sum((F.col("n_") * F.col(f"v_{c}") for c in columns), F.lit(0.0))
    between = sum((F.col("n_") * (F.col(f"m_{c}") - F.col(f"c_{c}")) ** 2 for c in columns), F.lit(0.0))
    got = sums.crossJoin(F.broadcast(all_)).agg(F.sum(within).alias("w"), F.sum(between).alias("b"), F.sum("n_").alias("n"), F.count("*").alias("k"))
    score = F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))
    return got.select(F.round(score, 4).alias("calinski_harabasz"))


def silhouettes(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """(key, cluster, silhouette) by Euclidean distance; 0 for a cluster of one. Keys are distinct. A task gives, for the
    rows of its two blocks, the sums of distances to each cluster of the other."""
    rows = df.select(F.col(key).alias("key"), F.col(cluster).alias("own"), F.col(vector).alias("vector"))

    def work(p, q):
        import numpy as np
        import pandas as pd

        def grouped(rows):
            groups, at = np.unique(rows["own"].to_numpy(), return_inverse=True)
            return groups, (at[:, None] == np.arange(len(groups))).astype(float)

        def sums_of(rows, groups, sums, counts):
            i, g = np.nonzero(counts)
            return pd.DataFrame({"key": rows["key"].to_numpy()[i], "own": rows["own"].to_numpy()[i], "other": groups[g], "s": sums[i, g], "n": counts[i, g].astype(int)})

        (left, of_left), (right, of_right) = grouped(p), grouped(q)
        there, back = np.zeros((len(p), len(right))), np.zeros((len(q), len(left)))
        for part, d in distances(vectors(p["vector"]), vectors(q["vector"])):
            there[part] = d @ of_right
            back += d.T @ of_left[part]
        if is_own(p, q):  # a row is at no distance from itself, and not counted
            counts = of_right.sum(axis=0) - (p["own"].to_numpy()[:, None] == right)
            return sums_of(p, right, there, counts)
        to, fro = (np.tile(one.sum(axis=0), (n, 1)) for one, n in ((of_right, len(p)), (of_left, len(q))))
        return pd.concat([sums_of(p, right, there, to), sums_of(q, left, back, fro)])

    k, c = type_of(rows, "key"), type_of(rows, "own")
    near = own_pairs(rows, work, f"key {k}, own {c}, other {c}, s double, n long")
    near = near.groupBy("key", "own", "other").agg((F.sum("s") / F.sum("n")).alias("d_"))
    own, other = F.max(F.when(F.col("own") == F.col("other"), F.col("d_"))), F.min(F.when(F.col("own") != F.col("other"), F.col("d_")))
    s = near.groupBy("key", "own").agg(own.alias("a"), other.alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return s.select(F.col("key").alias(key), F.col("own").alias(cluster), value.alias("silhouette"))


WIDE = 20_000  # rows of a block where a row gives out one row for all clusterings


def silhouette_means(df: DataFrame, key: str, vector: str, clusterings: dict[str, int], size: int = WIDE) -> list[float | None]:
    """The mean silhouette of each of several clusterings (column -> k: its clusters are 0 to k - 1), in one pass over the
    pairs of rows: a distance is worked out once for all of them, and a row gives one row for each block it meets."""
    names, places = list(clusterings), [(c, g) for c, k in clusterings.items() for g in range(k)]
    rows = cut(df.select(F.col(key).alias("key"), F.col(vector).alias("vector"), *names))
    sums = [f"s{n}_" for n in range(len(places))]

    def work(p, q):
        import numpy as np
        import pandas as pd

        def members(rows):
            return np.concatenate([(rows[c].to_numpy()[:, None] == np.arange(k)).astype(float) for c, k in clusterings.items()], axis=1)

        of_left, of_right = members(p), members(q)
        there, back = np.zeros((len(p), len(places))), np.zeros((len(q), len(places)))
        for part, d in distances(vectors(p["vector"]), vectors(q["vector"])):
            there[part] = d @ of_right
            if not is_own(p, q):
                back += d.T @ of_left[part]
        out = [pd.DataFrame(there, columns=sums).assign(key=p["key"].to_numpy())]
        if not is_own(p, q):
            out.append(pd.DataFrame(back, columns=sums).assign(key=q["key"].to_numpy()))
        return pd.concat(out)[["key", *sums]]

    met = own_pairs(rows, work, ", ".join([f"key {type_of(rows, 'key')}", *(f"{s} double" for s in sums)]), size)
    total = met.groupBy("key").agg(*(F.sum(s).alias(s) for s in sums)).join(rows.drop("vector"), "key")
    counted = rows.agg(*(F.count_if(F.col(c) == g).alias(s) for s, (c, g) in zip(sums, places))).first()  # a number per cluster
    means = []
    for c in names:
        own = [F.when(F.col(c) == g, F.col(s) / (counted[s] - 1)) for s, (d, g) in zip(sums, places) if d == c and counted[s] > 1]
        others = [F.when(F.col(c) != g, F.col(s) / counted[s]) for s, (d, g) in zip(sums, places) if d == c and counted[s]]
        a, b = F.coalesce(F.lit(None).cast("double"), *own), F.array_min(F.array_compact(F.array(*others)))
        means.append(F.avg(F.when(a.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))).alias(c))
    return list(total.agg(*means).first())


def silhouette_summary(s: DataFrame, cluster: str) -> DataFrame:
    from .stats import band

    overall = s.agg(F.lit("all").alias("cluster"), F.avg("silhouette").alias("m"), F.count("*").alias("n"))
    each = s.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(F.avg("silhouette").alias("m"), F.count("*").alias("n"))
    return overall.unionByName(each).select(
        "cluster", F.round("m", 6).alias("silhouette"), "n", band(F.col("m"), [(0.7, "strong"), (0.5, "reasonable"), (0.25, "weak")], "none").alias("quality")
    )
