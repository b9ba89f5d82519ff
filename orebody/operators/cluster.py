"""Clustering: k-means, Gaussian mixtures, density clusters. Agglomerative merging is in agglomerate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .blocks import block_pairs, distances, vectors
from .evaluate import silhouette_means


def squared_distance(columns: list[str], centre: list[float]):
    return sum(((F.col(c) - float(m)) ** 2 for c, m in zip(columns, centre)), F.lit(0.0))


def assign(df: DataFrame, columns: list[str], centres: list[list[float]], name: str = "cluster") -> DataFrame:
    """The nearest centre, the lowest index on ties, and the squared distance to it. Centres are literals: no join."""
    best = F.array_min(F.array(*(F.struct(squared_distance(columns, c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres))))
    return df.withColumn("best_", best).withColumn(name, F.col("best_.k")).withColumn("d2", F.col("best_.d")).drop("best_")


def update(assigned: DataFrame, columns: list[str], centres: list[list[float]], name: str = "cluster") -> tuple[list[list[float]], float, list[int]]:
    """New centres (an empty cluster keeps its own), WCSS against the old ones, and sizes: a row per cluster."""
    got = {r[name]: r for r in assigned.groupBy(name).agg(F.sum("d2").alias("w_"), F.count("*").alias("n_"), *(F.avg(c).alias(c) for c in columns)).collect()}
    new = [[got[k][c] for c in columns] if k in got else list(old) for k, old in enumerate(centres)]
    return new, sum(r["w_"] for r in got.values()), [got[k]["n_"] if k in got else 0 for k in range(len(centres))]


def plus_plus(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> list[list[float]]:
    """k-means++ seeding: each next centre is drawn with weight d^2 by the largest of ln(u) / d^2 (a weighted draw
    in one aggregation)."""
    row = df.select(*columns).orderBy(F.rand(seed)).limit(1).first()
    centres = [[float(x) for x in row]]
    for n in range(1, k):
        d = F.array_min(F.array(*(squared_distance(columns, c) for c in centres)))
        got = df.select(*columns, (F.log(F.rand(seed + n)) / F.nullif(d, F.lit(0.0))).alias("w_")).agg(F.max_by(F.struct(*columns), "w_")).first()[0]
        if got is None:
            break
        centres.append([float(got[c]) for c in columns])
    return centres


def seed_in_rounds(df: DataFrame, columns: list[str], k: int, seed: int = 42, rounds: int = 4, factor: int = 2) -> list[list[float]]:
    """Seeds in `rounds` + 2 passes, however large k: each round draws factor * k rows by weight d^2 in one pass, the
    largest of ln(u) / d^2; then every row votes for its nearest candidate, and k-means++ and Lloyd's rounds on the
    weighted candidates, at most factor * k * rounds + 1 of them, give k. Rows with a null take no part."""
    import numpy as np
    import pandas as pd

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    first = rows.orderBy(F.rand(seed)).limit(1).collect()
    if not first:
        return []
    found = np.array(first, dtype=float)

    def nearest(batch, centres):
        """(place, squared distance) of the nearest centre, in strips."""
        x = batch.to_numpy(dtype=float)
        at, d2 = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for part, d in distances(x, centres):
            at[part] = d.argmin(axis=1)
            d2[part] = d.min(axis=1) ** 2
        return at, d2

    for n in range(rounds):

        def apart(batches, known=found):
            for batch in batches:
                yield batch.assign(d2_=nearest(batch, known)[1])

        weight = F.log(1 - F.rand(seed + n + 1)) / F.nullif(F.col("d2_"), F.lit(0.0))
        placed = rows.mapInPandas(apart, ", ".join([*(f"`{c}` double" for c in columns), "d2_ double"]))
        drawn = placed.withColumn("w_", weight).where("w_ is not null").orderBy(F.desc("w_")).limit(factor * k).select(*columns).collect()
        if not drawn:
            break
        found = np.unique(np.concatenate([found, np.array(drawn, dtype=float)]), axis=0)

    def vote(batches):
        total = np.zeros(len(found), dtype=np.int64)
        for batch in batches:
            total += np.bincount(nearest(batch, found)[0], minlength=len(found))
        yield pd.DataFrame({"at": np.arange(len(found)), "n": total})

    votes = {r["at"]: r["n"] for r in rows.mapInPandas(vote, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    weights = np.array([votes[i] for i in range(len(found))], dtype=float)
    return _weighted_means(found, weights, k, seed)


def _weighted_means(x, weights, k: int, seed: int, tries: int = 8) -> list[list[float]]:
    """The best of a few runs of k-means++ and Lloyd's rounds on a few weighted points."""
    import numpy as np

    rng, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(tries):
        centres = x[[rng.choice(len(x), p=weights / weights.sum())]]
        while len(centres) < min(k, len(x)):
            d2 = weights * ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            if not d2.sum():
                break
            centres = np.concatenate([centres, x[[rng.choice(len(x), p=d2 / d2.sum())]]])
        for _ in range(30):
            d2 = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
            at = d2.argmin(axis=1)
            mass = np.bincount(at, weights, len(centres))
            moved = np.stack([np.bincount(at, weights * x[:, j], len(centres)) for j in range(x.shape[1])], axis=1) / np.maximum(mass, 1e-300)[:, None]
            moved[mass == 0] = centres[mass == 0]
            if np.array_equal(moved, centres):
                break
            centres = moved
        cost = float((weights * ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)).sum())
        if cost < best[0]:
            best = cost, centres
    return best[1].tolist()


def kmeans(df: DataFrame, columns: list[str], centres: list[list[float]], max_iter: int = 100) -> tuple[list[list[float]], list[float]]:
    """Lloyd's iterations from given centres until they rest: (centres, WCSS of every iteration)."""
    trace: list[float] = []
    for _ in range(max_iter):
        new, wcss, _ = update(assign(df, columns, centres), columns, centres)
        trace.append(wcss)
        if all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(new, centres) for a, b in zip(x, y)):
            break
        centres = new
    return centres, trace


def wcss_changes(spark, trace: list[float]) -> DataFrame:
    """(iteration, wcss, change, drop_pct) of the WCSS of every round: what it fell by since the round before."""
    rows = spark.createDataFrame([(n, float(w)) for n, w in enumerate(trace, 1)], "iteration int, wcss double")
    before = F.lag("wcss").over(_line("iteration"))  # a row per round
    return rows.select("iteration", "wcss", (before - F.col("wcss")).alias("change"), (100 * F.try_divide(before - F.col("wcss"), before)).alias("drop_pct"))


def kmeans_restarts(df: DataFrame, columns: list[str], k: int, restarts: int = 10):
    """MLlib k-means over several seeds; the model of least cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = cut(VectorAssembler(inputCols=columns, outputCol="features").transform(df))
    models = [KMeans(k=k, seed=s, maxIter=50).fit(rows) for s in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best, best.transform(rows)


def elbow(df: DataFrame, key: str, columns: list[str], ks: range, seed: int = 42) -> DataFrame:
    """(k, wcss, drop_pct, silhouette, iterations, last_change): the drop to the next smaller k, the mean silhouette
    (null for one cluster), and the rounds until rest with the change of the WCSS in the last."""
    rows, last, placed, several = [], None, df.select(key, *columns, F.array(*columns).alias("vector_")), {}
    for k in ks:
        centres, trace = kmeans(df, columns, seed_in_rounds(df, columns, k, seed))
        if k > 1:
            several[f"of_{k}_"] = len(centres)
            placed = assign(placed, columns, centres, f"of_{k}_").drop("d2")
        change = trace[-2] - trace[-1] if len(trace) > 1 else 0.0
        rows.append((k, trace[-1], None if not last else 100 * (last - trace[-1]) / last, None, len(trace), change))
        last = trace[-1]
    means = dict(zip(several, silhouette_means(placed, key, "vector_", several))) if several else {}
    rows = [(k, *r[:2], means.get(f"of_{k}_"), *r[3:]) for k, *r in rows]
    return df.sparkSession.createDataFrame(rows, "k int, wcss double, drop_pct double, silhouette double, iterations int, last_change double")


def centre_table(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster, size, centre coordinates) of an MLlib k-means model and its predictions."""
    centres = [(k, *map(float, c)) for k, c in enumerate(model.clusterCenters())]
    table = rows.sparkSession.createDataFrame(centres, ", ".join(["cluster int", *(f"{c} double" for c in columns)]))
    sizes = rows.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("size"))
    return table.join(sizes, "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).alias("size"), *columns)


def soft_assignments(rows: DataFrame, key: str) -> DataFrame:
    """(key, cluster, one probability per component) of a mixture's predictions."""
    from pyspark.ml.functions import vector_to_array

    k = len(rows.select("probability").first()[0])
    p = vector_to_array("probability")
    return rows.select(key, F.col("prediction").alias("cluster"), *(F.round(p[i], 6).alias(f"p{i}") for i in range(k)))


def without_noise(clusters: DataFrame) -> DataFrame:
    return clusters.where("cluster >= 0")


def density_summary(clusters: DataFrame) -> DataFrame:
    """One row: clusters, noise points, rows."""
    found = F.when(F.col("cluster") >= 0, F.col("cluster"))
    return clusters.agg(F.count_distinct(found).alias("n_clusters"), F.count_if(F.col("cluster") < 0).alias("n_noise"), F.count("*").alias("n_rows"))


def gaussian_mixture(df: DataFrame, columns: list[str], k: int = 3, seed: int = 42):
    """(model, rows with prediction and probability, log-likelihood, BIC, AIC)"""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    model = GaussianMixture(k=k, seed=seed, maxIter=100).fit(rows)
    ll, n, d = model.summary.logLikelihood, rows.count(), len(columns)
    p = (k - 1) + k * d + k * d * (d + 1) / 2
    return model, model.transform(rows), ll, -2 * ll + p * math.log(n), -2 * ll + 2 * p


FINE = 20  # halvings of a cell that a place within it is known to
HALVINGS = 3  # of boxes in one round
FEW_PAIRS = 4_096  # points of one box times those of another: so many pairs are compared


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, min_samples: int) -> DataFrame:
    """(key, cluster): -1 is noise; clusters are numbered by their smallest core key; a border point goes to the
    lowest cluster within reach. Points with a null coordinate are noise.

    The first (at most three) columns are cut into cells whose diagonal is eps. With at most three columns all points of
    a cell of min_samples points are core by that count, and all core points of a cell are of one cluster: neighbours
    are counted for points of thin cells alone, and clusters are components of cells. Two cells link if some of
    their core points are within eps: their bounding boxes decide where the farthest corners are (linked) or the nearest sides
    are not (apart); the rest is cut into smaller boxes, and points are compared where few are left. So a crowded cell costs
    no pairs. With more columns a cell says nothing of the distance, and points are compared with those of cells around."""
    grid = columns[:3]
    whole, d = len(columns) == len(grid), len(grid)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    reach = math.floor(1 + eps / side)
    places = [F.floor(F.col(c) / (side / 2**FINE)).alias(f"f{k}_") for k, c in enumerate(grid)]
    points = df.select(F.col(key).alias("id_"), *(F.col(c).cast("double").alias(c) for c in columns)).where(" and ".join(f"`{c}` is not null" for c in columns))
    points = cut(points.select("*", *places).select("*", *(F.shiftright(f"f{k}_", FINE).alias(f"g{k}_") for k in range(d))))
    cell = [f"g{k}_" for k in range(d)]

    def around(rows: DataFrame) -> DataFrame:
        for c in cell:
            rows = rows.withColumn(c, F.explode(F.array(*(F.col(c) + o for o in range(-reach, reach + 1)))))
        return rows

    def near(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows with those of others in cells around, within eps; others' columns end in j_."""
        others = others.select(*(F.col(c).alias(c if c in cell else f"{c}j_") for c in others.columns))
        dist = F.sqrt(sum(((F.col(c) - F.col(f"{c}j_")) ** 2 for c in columns), F.lit(0.0)))
        return around(rows).join(others, cell).where(dist <= eps)

    sizes = points.groupBy(*cell).agg(F.count("*").alias("in_cell_"))
    sized = points.join(sizes, cell)
    thin = cut(sized.where(F.col("in_cell_") < min_samples if whole else F.lit(True)).drop("in_cell_"))
    full = sized.where(F.col("in_cell_") >= min_samples if whole else F.lit(False)).drop("in_cell_")
    enough = near(thin.select("id_", *columns, *cell), points.select(*columns, *cell)).groupBy("id_").agg(F.count("*").alias("n_")).where(F.col("n_") >= min_samples)
    core = cut(full.unionByName(thin.join(enough.select("id_"), "id_", "left_semi")))
    if whole:
        named = core.groupBy(*cell).agg(F.min("id_").alias("node_"))
        core = cut(core.join(named, cell))
        edges = _linked_cells(core, columns, cell, reach, eps)
    else:
        core = core.withColumn("node_", F.col("id_"))
        edges = near(core.select("node_", *columns, *cell), core.select("node_", *columns, *cell)).where("node_ < node_j_").select(F.col("node_").alias("a"), F.col("node_j_").alias("b"))
    label = _least_reached(core.select("node_").distinct(), cut(edges))
    order = label.select("c_").distinct().select("c_", (F.row_number().over(_line("c_")) - 1).alias("cluster_"))  # a row per cluster
    placed = cut(core.join(label, "node_").join(order, "c_"))
    lone = thin.join(core.select("id_"), "id_", "left_anti")
    border = near(lone.select("id_", *columns, *cell), placed.select(*columns, *cell, "cluster_")).groupBy("id_").agg(F.min("cluster_j_").alias("b_"))
    out = df.select(F.col(key).alias("id_")).join(placed.select("id_", "cluster_"), "id_", "left").join(border, "id_", "left")
    return out.select(F.col("id_").alias(key), F.coalesce("cluster_", "b_", F.lit(-1)).cast("int").alias("cluster"))


def _linked_cells(core: DataFrame, columns: list[str], cell: list[str], reach: int, eps: float) -> DataFrame:
    """(a, b): cells, by their nodes, with core points within eps of each other."""
    d = len(cell)

    def boxes(level: int, side: str) -> DataFrame:
        """(node, box, parent box, least and largest of each column, points); names end in side."""
        own, up = ([F.shiftright(f"f{k}_", FINE - max(0, at)).alias(f"{n}{k}") for k in range(d)] for n, at in (("s", level), ("p", level - HALVINGS)))
        names = [f"s{k}" for k in range(d)] + [f"p{k}" for k in range(d)]
        made = core.select("node_", *own, *up, *columns).groupBy("node_", *names).agg(
            *(F.min(c).alias(f"lo{k}") for k, c in enumerate(columns)), *(F.max(c).alias(f"hi{k}") for k, c in enumerate(columns)), F.count("*").alias("n")
        )
        return made.select(*(F.col(c).alias(f"{c}{side}") for c in made.columns))

    gaps = [F.greatest(F.lit(0.0), F.col(f"lo{k}_b") - F.col(f"hi{k}_a"), F.col(f"lo{k}_a") - F.col(f"hi{k}_b")) for k in range(d)]
    spans = [F.greatest(F.col(f"hi{k}_b") - F.col(f"lo{k}_a"), F.col(f"hi{k}_a") - F.col(f"lo{k}_b")) for k in range(d)]
    length = lambda parts: F.sqrt(sum((p**2 for p in parts), F.lit(0.0)))
    # Where both boxes are points, nearest and farthest are the distance itself.
    single = " and ".join(f"lo{k}_{s} = hi{k}_{s}" for k in range(d) for s in "ab")
    least, most = length(gaps), length(spans)
    verdict = F.when(F.expr(single), least <= eps).when(most <= eps * (1 - 1e-12), True).when(least > eps * (1 + 1e-12), False)

    one, two = boxes(0, "_a"), boxes(0, "_b")
    for k in range(d):
        one = one.withColumn(f"o{k}", F.explode(F.array(*(F.col(f"s{k}_a") + o for o in range(-reach, reach + 1)))))
    pairs = one.join(two, [F.col(f"o{k}") == F.col(f"s{k}_b") for k in range(d)]).where("node__a < node__b")
    linked, level = None, 0
    while True:
        judged = cut(pairs.withColumn("linked", verdict))
        found = judged.where("linked").select(F.col("node__a").alias("a"), F.col("node__b").alias("b"))
        open_ = judged.where("linked is null").join(found, (F.col("node__a") == F.col("a")) & (F.col("node__b") == F.col("b")), "left_anti")
        few = F.lit(True) if level + HALVINGS > FINE else F.col("n_a") * F.col("n_b") <= FEW_PAIRS
        spots = core.select("node_", *columns, *(F.shiftright(f"f{k}_", FINE - level).alias(f"s{k}") for k in range(d)))
        x, y = (spots.select(*(F.col(c).alias(f"{c}{s}") for c in spots.columns)) for s in ("_a", "_b"))
        close = open_.where(few).select("node__a", "node__b", *(f"s{k}_{s}" for k in range(d) for s in "ab"))
        close = close.join(x, ["node__a", *(f"s{k}_a" for k in range(d))]).join(y, ["node__b", *(f"s{k}_b" for k in range(d))])
        close = close.where(length([F.col(f"{c}_a") - F.col(f"{c}_b") for c in columns]) <= eps).select(F.col("node__a").alias("a"), F.col("node__b").alias("b"))
        found = cut(found.unionByName(close).distinct())
        linked = found if linked is None else linked.unionByName(found)
        open_ = cut(open_.where(~few).join(found, (F.col("node__a") == F.col("a")) & (F.col("node__b") == F.col("b")), "left_anti"))
        if open_.isEmpty():
            return linked.distinct()
        level += HALVINGS
        held = open_.select("node__a", "node__b", *(F.col(f"s{k}_{s}").alias(f"p{k}_{s}") for k in range(d) for s in "ab"))
        pairs = held.join(boxes(level, "_a"), ["node__a", *(f"p{k}_a" for k in range(d))]).join(boxes(level, "_b"), ["node__b", *(f"p{k}_b" for k in range(d))])


def _least_reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_, c_): the smallest node that each one reaches. Labels are nodes: jumping to a label's label halves the way."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).union(nodes.select(F.col("node_").alias("a"), F.col("node_").alias("b"))))
    label = cut(nodes.select("node_", F.col("node_").alias("c_")))
    while True:
        seen = both.join(label.select(F.col("node_").alias("b"), "c_"), "b").groupBy(F.col("a").alias("node_")).agg(F.min("c_").alias("c_"))
        jumped = seen.join(seen.select(F.col("node_").alias("c_"), F.col("c_").alias("cc_")), "c_", "left").select("node_", F.least("c_", F.coalesce("cc_", "c_")).alias("c_"))
        new = cut(jumped)
        moved = new.join(label.select("node_", F.col("c_").alias("old_")), "node_").where("c_ <> old_").limit(1).count()
        label = new
        if not moved:
            return label


def _line(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def linkage_distance(df: DataFrame, key: str, vector: str, cluster: str, a: int, b: int) -> DataFrame:
    """Single, complete and average distance of two clusters, from extremes and sums by pairs of blocks."""
    left, right = (df.where(F.col(cluster) == c).select(F.col(vector).alias("vector")) for c in (a, b))

    def work(p, q):
        import pandas as pd

        strips = [(d.min(), d.max(), d.sum(), d.size) for _, d in distances(vectors(p["vector"]), vectors(q["vector"]))]
        return pd.DataFrame(strips, columns=["least", "most", "total", "n"])

    d = block_pairs(left, right, work, "least double, most double, total double, n long")
    return d.agg(F.min("least").alias("single"), F.max("most").alias("complete"), (F.sum("total") / F.sum("n")).alias("average"))
