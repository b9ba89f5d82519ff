"""Clustering and its scores on suppliers and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import agglomerate, cluster, evaluate
from .base import query, table

_Z = "z AS (SELECT s_suppkey AS id, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS x, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS y FROM supplier)"
_START = [[-1.0, -1.0], [0.0, 0.5], [1.0, 1.0]]


def _suppliers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    from ..operators import prep

    return prep.apply_standard(s, prep.fit_standard(s, ["x", "y"]), ["x", "y"])


def _step(n: int, centres: str) -> str:
    return f"""a{n} AS (SELECT id, x, y, k, d FROM (SELECT z.*, c.k, power(z.x - c.cx, 2) + power(z.y - c.cy, 2) AS d FROM z, {centres} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1),
c{n} AS (SELECT k, avg(x) AS cx, avg(y) AS cy FROM a{n} GROUP BY k)"""


_C0 = "c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {c[0]}::DOUBLE, {c[1]}::DOUBLE)" for k, c in enumerate(_START)) + ") t(k, cx, cy))"
_LLOYD = f"WITH {_Z}, {_C0}, {_step(1, 'c0')}, {_step(2, 'c1')}, {_step(3, 'c2')}"


@query(f"{_LLOYD} SELECT id, k AS cluster, round(d, 6) AS d2 FROM a3")
def kmeans_three_rounds(spark, sf_dir):
    s, centres = _suppliers(spark, sf_dir), _START
    for _ in range(2):
        centres, _, _ = cluster.update(cluster.assign(s, ["x", "y"], centres), ["x", "y"], centres)
    return cluster.assign(s, ["x", "y"], centres).select("id", "cluster", F.round("d2", 6).alias("d2"))


def _three_rounds(spark, sf_dir) -> list[float]:
    s, centres, trace = _suppliers(spark, sf_dir), _START, []
    for _ in range(3):
        centres, wcss, _ = cluster.update(cluster.assign(s, ["x", "y"], centres), ["x", "y"], centres)
        trace.append(wcss)
    return trace


@query(f"{_LLOYD} SELECT 1 AS iteration, round(sum(d), 6) AS wcss FROM a1 UNION ALL SELECT 2, round(sum(d), 6) FROM a2 UNION ALL SELECT 3, round(sum(d), 6) FROM a3")
def wcss_trace(spark, sf_dir):
    trace = _three_rounds(spark, sf_dir)
    return spark.createDataFrame([(n, round(float(w), 6)) for n, w in enumerate(trace, 1)], "iteration int, wcss double")


@query(f"""{_LLOYD}, t AS (SELECT 1 AS iteration, sum(d) AS wcss FROM a1 UNION ALL SELECT 2, sum(d) FROM a2 UNION ALL SELECT 3, sum(d) FROM a3)
SELECT iteration, round(wcss, 6) AS wcss, round(lag(wcss) OVER (ORDER BY iteration) - wcss, 6) AS change, round(100 * (lag(wcss) OVER (ORDER BY iteration) - wcss) / lag(wcss) OVER (ORDER BY iteration), 6) AS drop_pct FROM t""")
def wcss_changes(spark, sf_dir):
    """The change of the WCSS in every round."""
    found = cluster.wcss_changes(spark, _three_rounds(spark, sf_dir))
    return found.select("iteration", *(F.round(c, 6).alias(c) for c in ("wcss", "change", "drop_pct")))


_SIDE = f"{_Z}, q AS (SELECT *, CASE WHEN x < -0.5 THEN 0 WHEN x < 0.5 THEN 1 ELSE 2 END AS c FROM z)"


def _sided(spark, sf_dir):
    x = F.col("x")
    return _suppliers(spark, sf_dir).select("id", "x", "y", F.array("x", "y").alias("v"), F.when(x < -0.5, 0).when(x < 0.5, 1).otherwise(2).alias("c"))


@query(f"""WITH {_SIDE}, n AS (SELECT a.id, a.c, b.c AS o, avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM q a JOIN q b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, c, max(CASE WHEN c = o THEN d END) AS a, min(CASE WHEN c <> o THEN d END) AS b FROM n GROUP BY ALL)
SELECT id, c, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""")
def silhouettes(spark, sf_dir):
    return evaluate.silhouettes(_sided(spark, sf_dir), "id", "v", "c").withColumn("silhouette", F.round("silhouette", 6))


@query(f"""WITH {_SIDE}, n AS (SELECT a.id, a.c, b.c AS o, avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM q a JOIN q b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, c, max(CASE WHEN c = o THEN d END) AS a, min(CASE WHEN c <> o THEN d END) AS b FROM n GROUP BY ALL),
v AS (SELECT c, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM s),
g AS (SELECT 'all' AS cluster, avg(s) AS m, count(*) AS n FROM v UNION ALL SELECT c::VARCHAR, avg(s), count(*) FROM v GROUP BY c)
SELECT cluster, round(m, 6) AS silhouette, n, CASE WHEN m > 0.7 THEN 'strong' WHEN m > 0.5 THEN 'reasonable' WHEN m > 0.25 THEN 'weak' ELSE 'none' END AS quality FROM g""")
def silhouette_summary(spark, sf_dir):
    """Means of all rows and of each cluster, with the bands of quality."""
    return evaluate.silhouette_summary(evaluate.silhouettes(_sided(spark, sf_dir), "id", "v", "c"), "c")


@query(f"""WITH {_SIDE}, m AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM q GROUP BY c),
w AS (SELECT sum(power(x - mx, 2) + power(y - my, 2)) AS w FROM q JOIN m USING (c)), b AS (SELECT sum(n * (power(mx - (SELECT avg(x) FROM q), 2) + power(my - (SELECT avg(y) FROM q), 2))) AS b, count(*) AS k, sum(n) AS n FROM m)
SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM w, b""")
def calinski_harabasz(spark, sf_dir):
    return evaluate.calinski_harabasz(_sided(spark, sf_dir), "c", ["x", "y"])


_CELLS = "e AS (SELECT label, (vec_id % 7)::INT AS c FROM embeddings), t AS (SELECT label, c, count(*) AS n FROM e GROUP BY ALL)"


@query(f"""WITH {_CELLS}, p AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM t), a AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM (SELECT sum(n) AS n FROM t GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY c))
SELECT round((p.s - a.s * b.s / (a.n * (a.n - 1) / 2.0)) / ((a.s + b.s) / 2 - a.s * b.s / (a.n * (a.n - 1) / 2.0)), 6) AS ari FROM p, a, b""")
def adjusted_rand(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.pmod("vec_id", F.lit(7)).alias("c"))
    return evaluate.adjusted_rand(e, "label", "c")


@query(f"WITH {_CELLS} SELECT label, c AS cluster, n AS hits FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, c) = 1")
def dominant_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.pmod("vec_id", F.lit(7)).cast("int").alias("c"))
    return evaluate.dominant_clusters(e, "label", "c")


_DENSE = f"""WITH RECURSIVE {_Z}, l AS (SELECT a.id AS i, b.id AS j FROM z a JOIN z b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 0.3),
core AS (SELECT i FROM l GROUP BY i HAVING count(*) >= 5), e AS (SELECT i, j FROM l WHERE i IN (FROM core) AND j IN (FROM core)),
r AS (SELECT i, i AS c FROM core UNION SELECT e.j, r.c FROM r JOIN e ON e.i = r.i), m AS (SELECT i, min(c) AS c FROM r GROUP BY i), k AS (SELECT i, dense_rank() OVER (ORDER BY c) - 1 AS cluster FROM m),
dense AS (SELECT z.id, coalesce(k.cluster, (SELECT min(k2.cluster) FROM l JOIN k k2 ON k2.i = l.j WHERE l.i = z.id), -1)::INT AS cluster FROM z LEFT JOIN k ON k.i = z.id)"""


@query(f"{_DENSE} SELECT id, cluster FROM dense")
def density_clusters(spark, sf_dir):
    return cluster.dbscan(_suppliers(spark, sf_dir), "id", ["x", "y"], 0.3, 5)


@query(f"{_DENSE} SELECT id, cluster FROM dense WHERE cluster >= 0")
def clustered_points(spark, sf_dir):
    """Noise left out."""
    return cluster.without_noise(density_clusters(spark, sf_dir))


@query(f"{_DENSE} SELECT count(DISTINCT cluster) FILTER (cluster >= 0) AS n_clusters, count_if(cluster < 0)::BIGINT AS n_noise, count(*) AS n_rows FROM dense")
def density_summary(spark, sf_dir):
    return cluster.density_summary(density_clusters(spark, sf_dir))


@query(f"""WITH {_SIDE}, d AS (SELECT sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM q a, q b WHERE a.c = 0 AND b.c = 2) SELECT round(min(d), 6) AS single, round(max(d), 6) AS complete, round(avg(d), 6) AS average FROM d""")
def linkage_distances(spark, sf_dir):
    d = cluster.linkage_distance(_sided(spark, sf_dir), "id", "v", "c", 0, 2)
    return d.select(*(F.round(c, 6).alias(c) for c in d.columns))


@query()
def agglomerative_merges(spark, sf_dir):
    return agglomerate.merges(_suppliers(spark, sf_dir), "id", ["x", "y"], "average").withColumn("height", F.round("height", 4)).drop("left_size", "mean")


@query()
def merge_bars(spark, sf_dir):
    """The average linkage's merges as lines of text, a bar for each height."""
    return agglomerate.dendrogram(agglomerate.merges(_suppliers(spark, sf_dir), "id", ["x", "y"], "average"))


_HEIGHTS = [0.1, 0.2, 0.3, 0.5]


@query(f"""WITH RECURSIVE {_Z}, t AS (SELECT unnest({_HEIGHTS})::DOUBLE AS height),
l AS (SELECT height, a.id AS i, b.id AS j FROM z a JOIN z b ON a.id <> b.id, t WHERE round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 4) <= height),
r AS (SELECT height, id AS i, id AS c FROM z, t UNION SELECT r.height, l.j, r.c FROM r JOIN l ON l.height = r.height AND l.i = r.i), m AS (SELECT height, i, min(c) AS c FROM r GROUP BY ALL)
SELECT i AS id, height, (dense_rank() OVER (PARTITION BY height ORDER BY c) - 1)::INT AS cluster FROM m""")
def single_link_clusters(spark, sf_dir):
    """Single linkage's clusters at several heights: what chains of rows no farther apart reach."""
    s = cut(_suppliers(spark, sf_dir))
    return agglomerate.clusters_at(s, "id", agglomerate.merges(s, "id", ["x", "y"], "single", means=False), _HEIGHTS)


@query()
def ward_clusters(spark, sf_dir):
    s = cut(_suppliers(spark, sf_dir))
    return agglomerate.into_clusters(s, "id", agglomerate.merges(s, "id", ["x", "y"], "ward"), 3)


@query()
def linkage_comparison(spark, sf_dir):
    """Cophenetic correlation, clusters at several heights, and the first and last heights, by linkage."""
    return agglomerate.comparison(cut(_suppliers(spark, sf_dir)), "id", ["x", "y"], [0.5, 1.0, 1.5, 2.5])


@query()
def elbow(spark, sf_dir):
    return cluster.elbow(cut(_suppliers(spark, sf_dir)), "id", ["x", "y"], range(1, 11))


@query()
def mixture_scores(spark, sf_dir):
    model, _, ll, bic, aic = cluster.gaussian_mixture(_suppliers(spark, sf_dir), ["x", "y"], 3)
    return spark.createDataFrame([(float(ll), float(bic), float(aic), len(model.weights))], "log_likelihood double, bic double, aic double, components int")


@query()
def soft_assignments(spark, sf_dir):
    """Each supplier's probability of every component, and the likeliest one."""
    _, rows, *_ = cluster.gaussian_mixture(_suppliers(spark, sf_dir), ["x", "y"], 3)
    return cluster.soft_assignments(rows, "id")


@query()
def best_of_restarts(spark, sf_dir):
    """k-means from ten seeds: the cheapest model's clusters with their sizes and centres."""
    model, rows = cluster.kmeans_restarts(_suppliers(spark, sf_dir), ["x", "y"], 3)
    return cluster.centre_table(model, rows, ["x", "y"])
