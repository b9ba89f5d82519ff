"""Statistics, similarity and distance on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lineage import settle
from ..operators import prep, stats
from .base import query, table


def _profile_sql(source: str, x: str, by: str = "", column: str = "") -> str:
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    m = f"(PARTITION BY {by})" if by else "()"
    keyed = f"{by} AS g" if by else "1 AS g"
    return f"""
WITH s AS (SELECT {head}CAST({x} AS DOUBLE) AS x FROM {source}),
c AS (SELECT *, x - avg(x) OVER {m} AS d FROM s),
mode_ AS (SELECT g, x AS mode FROM (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY n DESC, x) AS r FROM (SELECT {keyed}, x, count(*) AS n FROM s WHERE x IS NOT NULL GROUP BY ALL)) WHERE r = 1),
a AS (SELECT {head}{keyed.split(' AS')[0]} AS g, count(x) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, min(x) AS min, max(x) AS max, sum(d * d) / (count(x) - 1) AS variance,
  quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
  (sum(d * d * d) / count(x)) / power(sum(d * d) / count(x), 1.5) AS skewness, (sum(d * d * d * d) / count(x)) / power(sum(d * d) / count(x), 2) - 3 AS kurtosis FROM c {group})
SELECT {head}'{column or x}' AS "column", n, round(mean, 4) AS mean, round(median, 4) AS median, round(mode, 4) AS mode, round(min, 4) AS min, round(max, 4) AS max,
  round(max - min, 4) AS range, round(variance, 4) AS variance, round(sqrt(variance), 4) AS std, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  round(skewness, 4) AS skewness, round(kurtosis, 4) AS kurtosis, round(sqrt(variance) * 100 / mean, 4) AS cv_pct
FROM a JOIN mode_ USING (g)"""


_CLIPPED = """(SELECT l_returnflag, CASE WHEN l_extendedprice < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) WHEN l_extendedprice > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE l_extendedprice END AS v
  FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem))"""


@query(_profile_sql(f"(SELECT l_returnflag, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS price_z FROM {_CLIPPED}) t", "price_z", "l_returnflag"))
def flag_profile(spark, sf_dir):
    """Prices clipped to the IQR bounds, then z-scores, then a profile per return flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price_z"))
    bounds = settle(prep.fit_iqr(rows, ["price_z"]))
    x, low, high = (F.col(c) for c in ("price_z", "price_z_low", "price_z_high"))
    clipped = rows.crossJoin(F.broadcast(bounds)).select("l_returnflag", F.when(x < low, low).when(x > high, high).otherwise(x).alias("price_z"))
    scaled = prep.apply_standard(clipped, settle(prep.fit_standard(clipped, ["price_z"])), ["price_z"])
    return stats.profile(scaled, ["price_z"], ["l_returnflag"])


@query(_profile_sql("lineitem", "l_quantity", "l_returnflag"))
def describe_by_flag(spark, sf_dir):
    return stats.profile(table(spark, sf_dir, "lineitem"), ["l_quantity"], ["l_returnflag"])


_DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4) AS p25,
  round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4)::DOUBLE AS max FROM lineitem"""
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(_DESCRIBE.format(c=c) for c in _NUMBERS))
def describe_table(spark, sf_dir):
    return stats.describe(table(spark, sf_dir, "lineitem"), _NUMBERS)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", round(min({c}), 4)::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4)::DOUBLE AS max FROM lineitem""" for c in _NUMBERS[:2]))
def five_number_summary(spark, sf_dir):
    return stats.five_numbers(table(spark, sf_dir, "lineitem"), _NUMBERS[:2])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def class_distribution(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT s_nationkey, count(*) AS size, round(avg(s_acctbal), 4) AS s_acctbal_mean, min(s_acctbal) AS s_acctbal_min, max(s_acctbal) AS s_acctbal_max, round(stddev_pop(s_acctbal), 4) AS s_acctbal_std FROM supplier GROUP BY s_nationkey")
def group_profile(spark, sf_dir):
    return stats.group_profile(table(spark, sf_dir, "supplier"), "s_nationkey", ["s_acctbal"])


@query("SELECT CASE WHEN c_acctbal > 6000 THEN 'High' WHEN c_acctbal < 3500 THEN 'Low' ELSE 'Moderate' END AS band, count(*) AS n FROM customer GROUP BY 1")
def score_bands(spark, sf_dir):
    x = F.col("c_acctbal")
    tag = F.when(x > 6000, "High").when(x < 3500, "Low").otherwise("Moderate")
    return table(spark, sf_dir, "customer").groupBy(tag.alias("band")).agg(F.count("*").alias("n"))


@query("SELECT min(l_quantity) AS lo_quantity, max(l_quantity) AS hi_quantity, min(l_discount) AS lo_discount, max(l_discount) AS hi_discount FROM lineitem")
def feature_range(spark, sf_dir):
    c = ("quantity", "discount")
    return table(spark, sf_dir, "lineitem").agg(*(f(f"l_{x}").alias(f"{n}_{x}") for x in c for n, f in (("lo", F.min), ("hi", F.max))))


_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(r, 6) AS r, CASE WHEN abs(r) > 0.9 THEN 'very strong' WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM (SELECT corr({a}, {b}) AS r FROM lineitem)" for a, b in _PAIRS))
def correlation_matrix(spark, sf_dir):
    return stats.correlations(table(spark, sf_dir, "lineitem"), _NUMBERS)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM r""")
def spearman_price(spark, sf_dir):
    return stats.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query()
def correlation_p_value(spark, sf_dir):
    got = table(spark, sf_dir, "supplier").agg(F.corr("s_acctbal", "s_nationkey"), F.count("*")).first()
    return spark.createDataFrame([(float(got[0]), int(got[1]), stats.t_test_p(got[0], got[1]))], "r double, n long, p_value double")


@query("""SELECT a.vec_id AS i, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine_distance,
  round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean, round(list_sum(list_transform(range(1, 65), lambda k: abs(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE))), 6) AS manhattan,
  round(power(list_sum(list_transform(range(1, 65), lambda k: power(abs(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE), 3))), 1.0 / 3), 6) AS minkowski3,
  round(list_max(list_transform(range(1, 65), lambda k: abs(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE))), 6) AS chebyshev
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("i"), F.col("embedding").alias("b"))
    x, y = F.col("a"), F.col("b")
    values = {"cosine": C.cosine_similarity(x, y), "cosine_distance": 1 - C.cosine_similarity(x, y), "euclidean": C.euclidean(x, y), "manhattan": C.manhattan(x, y), "minkowski3": C.minkowski(x, y, 3), "chebyshev": C.chebyshev(x, y)}
    return a.join(b, "i").select("i", *(F.round(v, 6).alias(k) for k, v in values.items()))


@query("""WITH b AS (SELECT l_orderkey AS o, list(DISTINCT p_brand) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT x.o AS o, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE, 6) AS jaccard, round(2.0 * len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s)), 6) AS dice, len(list_intersect(x.s, y.s)) = len(x.s) AS subset
FROM b x JOIN b y ON y.o = x.o + 1""")
def basket_similarity(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sets = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set("p_brand").alias("s"))
    after = sets.select((F.col("o") - 1).alias("o"), F.col("s").alias("t"))
    s, t = F.col("s"), F.col("t")
    return sets.join(after, "o").select("o", F.round(C.jaccard(s, t), 6).alias("jaccard"), F.round(C.dice(s, t), 6).alias("dice"), C.is_subset(s, t).alias("subset"))


@query("SELECT a.c_custkey AS k, round(hamming(a.c_name, b.c_name) / length(a.c_name)::DOUBLE, 6) AS hamming FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def name_hamming(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"))
    b = c.select((F.col("c_custkey") - 1).alias("k"), F.col("c_name").alias("b"))
    return a.join(b, "k").select("k", F.round(C.hamming(F.col("a"), F.col("b")), 6).alias("hamming"))


@query("""WITH c AS (SELECT event_type AS t, count_if(user_id % 2 = 0)::DOUBLE AS a, count_if(user_id % 2 = 1)::DOUBLE AS b FROM events GROUP BY 1),
n AS (SELECT (a / sa + 1e-10) AS p, (b / sb + 1e-10) AS q FROM (SELECT *, sum(a) OVER () AS sa, sum(b) OVER () AS sb FROM c)),
m AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM n)
SELECT round(sum(p * ln(p / q)), 8) AS kl_pq, round(sum(q * ln(q / p)), 8) AS kl_qp FROM m""")
def event_divergence(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).cast("double").alias("a"), F.count_if(F.col("user_id") % 2 == 1).cast("double").alias("b"))
    both = counts.agg(F.collect_list(F.struct("a", "b")).alias("v")).select(F.col("v.a").alias("a"), F.col("v.b").alias("b"))
    share = lambda c: F.transform(c, lambda x: x / C.total(F.col(c)))
    both = both.select(share("a").alias("p"), share("b").alias("q"))
    p, q = F.col("p"), F.col("q")
    return both.select(F.round(C.kl_divergence(p, q), 8).alias("kl_pq"), F.round(C.kl_divergence(q, p), 8).alias("kl_qp"))


@query("""WITH s AS (SELECT covar_samp(p_size, p_size) AS a, covar_samp(p_size, p_retailprice) AS b, covar_samp(p_retailprice, p_retailprice) AS c FROM part)
SELECT p_partkey, round(sqrt(((p_size - 25) * (p_size - 25) * c - 2 * (p_size - 25) * (p_retailprice - 1000) * b + (p_retailprice - 1000) * (p_retailprice - 1000) * a) / (a * c - b * b)), 6) AS distance FROM part, s""")
def mahalanobis_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return stats.mahalanobis(p, ["p_size", "p_retailprice"], [25, 1000]).select("p_partkey", F.round("mahalanobis", 6).alias("distance"))


_SUPPLIER_PAIRS = "SELECT a.s_suppkey AS i, b.s_suppkey AS j, sqrt(power(a.s_acctbal - b.s_acctbal, 2) + power(a.s_nationkey - b.s_nationkey, 2)) AS d FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey"


def _supplier_vectors(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("v"))


@query(f"SELECT i, j, round(d, 6) AS d FROM ({_SUPPLIER_PAIRS})")
def distance_matrix(spark, sf_dir):
    return stats.pairwise(_supplier_vectors(spark, sf_dir), "s_suppkey", "v").withColumn("d", F.round("d", 6))


@query(f"""WITH p AS (SELECT i, j, round(d, 6) AS d FROM ({_SUPPLIER_PAIRS}))
(SELECT 'closest' AS kind, i, j, d FROM p ORDER BY d, i, j LIMIT 1) UNION ALL (SELECT 'farthest' AS kind, i, j, d FROM p ORDER BY d DESC, i, j LIMIT 1)""")
def extreme_pairs(spark, sf_dir):
    return stats.extreme_pairs(_supplier_vectors(spark, sf_dir), "s_suppkey", "v")


@query("""WITH e AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - a) * 20 / (b - a)), 19)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT k::INT AS bin, round(a + k * (b - a) / 20, 6) AS lo, round(a + (k + 1) * (b - a) / 20, 6) AS hi, coalesce(n, 0) AS n FROM e, range(20) t(k) LEFT JOIN c ON c.bin = k""")
def price_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)
