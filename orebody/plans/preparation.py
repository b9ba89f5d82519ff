"""Preprocessing, features and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.ordering import scatter_sql
from ..operators import prep, split
from .base import query, table


def _events(spark, sf_dir):
    """event_id, ts, event_type, user_id and value with gaps: null where event_id mod 7 = 3."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return prep.inject_nulls(e, "value", "event_id", 7, 3)


_GAPS = "g AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 <> 3 THEN value END AS value FROM events)"


@query(f"WITH {_GAPS} SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM g)), 6) AS value FROM g")
def impute_mean(spark, sf_dir):
    e = _events(spark, sf_dir)
    return prep.apply_fill(e, prep.fit_fill(e, {"value": "mean"})).select("event_id", F.round("value", 6).alias("value"))


@query(f"WITH {_GAPS} SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM g)), 6) AS value FROM g")
def impute_median(spark, sf_dir):
    e = _events(spark, sf_dir)
    return prep.apply_fill(e, prep.fit_fill(e, {"value": "median"})).select("event_id", F.round("value", 6).alias("value"))


@query("""WITH g AS (SELECT event_id, CASE WHEN event_id % 5 <> 2 THEN event_type END AS event_type FROM events),
m AS (SELECT event_type AS m FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, coalesce(event_type, m) AS event_type FROM g, m""")
def impute_mode(spark, sf_dir):
    e = prep.inject_nulls(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 5, 2)
    return prep.apply_fill(e, prep.fit_fill(e, {"event_type": "mode"}))


@query(f"""WITH {_GAPS}, w AS (SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
SELECT event_id, coalesce(a, b) AS value FROM w""")
def fill_in_time(spark, sf_dir):
    return prep.fill_in_time(_events(spark, sf_dir), "ts", "value", F.to_date("ts"), ["event_id"]).select("event_id", "value")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 6) AS l_quantity FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem)")
def min_max(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return prep.apply_range(li, prep.fit_range(li, ["l_quantity"]), ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - a) / s, 6) AS l_extendedprice FROM lineitem, (SELECT avg(l_extendedprice) AS a, stddev_pop(l_extendedprice) AS s FROM lineitem)")
def z_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return prep.apply_standard(li, prep.fit_standard(li, ["l_extendedprice"]), ["l_extendedprice"]).withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query("SELECT o_orderkey, round((o_totalprice - a) / s, 6) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 10 < 7) WHERE o_orderkey % 10 >= 7")
def scale_by_train(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    params = prep.fit_standard(o.where("o_orderkey % 10 < 7"), ["o_totalprice"])
    return prep.apply_standard(o.where("o_orderkey % 10 >= 7"), params, ["o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def scale_and_back(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    params = prep.fit_standard(o, ["o_totalprice"])
    back = prep.undo_standard(prep.apply_standard(o, params, ["o_totalprice"]), params, ["o_totalprice"])
    return back.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("SELECT p_partkey, least(floor((p_retailprice - a) * 3 / (b - a)), 2)::INT AS bin FROM part, (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)")
def equal_width_bins(spark, sf_dir):
    return prep.equal_width(table(spark, sf_dir, "part"), "p_retailprice", 3, "bin").select("p_partkey", "bin")


@query("SELECT p_partkey, ((p_retailprice > a)::INT + (p_retailprice > b)::INT + (p_retailprice > c)::INT) AS bin FROM part, (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)")
def equal_frequency_bins(spark, sf_dir):
    return prep.equal_frequency(table(spark, sf_dir, "part"), "p_retailprice", 4, "bin").select("p_partkey", "bin")


@query("SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::BIGINT AS code FROM events")
def label_codes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return prep.label_encode(e, "event_type", "code").select("event_id", F.col("code").cast("long").alias("code"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS priority FROM orders")
def ordinal_priority(spark, sf_dir):
    order = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
    return table(spark, sf_dir, "orders").select("o_orderkey", C.map_values(F.col("o_orderpriority"), order).alias("priority"))


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS flag_A, (l_returnflag = 'N')::INT AS flag_N, (l_returnflag = 'R')::INT AS flag_R FROM lineitem")
def one_hot_flags(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return prep.one_hot(li, "l_returnflag", ["A", "N", "R"], "flag").drop("l_returnflag")


@query("SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos FROM events")
def cyclical_time(spark, sf_dir):
    hs, hc = C.cyclical(F.hour("ts"), 24)
    ms, mc = C.cyclical(F.month("ts"), 12)
    return table(spark, sf_dir, "events").select("event_id", *(F.round(v, 6).alias(k) for k, v in (("hour_sin", hs), ("hour_cos", hc), ("month_sin", ms), ("month_cos", mc))))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity - 8.0 AS t, 100 * (1 - 5 * l_discount) AS rh, l_tax * 300 AS v FROM lineitem),
d AS (SELECT *, ln(greatest(least(rh, 100), 0.01) / 100) + 17.625 * t / (243.04 + t) AS g FROM w)
SELECT l_orderkey, l_linenumber, round(CASE WHEN t >= 27 AND rh >= 40 THEN -8.78469475556 + 1.61139411 * t + 2.33854883889 * rh - 0.14611605 * t * rh - 0.012308094 * t * t - 0.0164248277778 * rh * rh
  + 0.002211732 * t * t * rh + 0.00072546 * t * rh * rh - 0.000003582 * t * t * rh * rh ELSE t END, 5) AS heat_index, round(243.04 * g / (17.625 - g), 5) AS dew_point,
  round(CASE WHEN t <= 10 AND v >= 4.8 THEN 13.12 + 0.6215 * t - 11.37 * power(v, 0.16) + 0.3965 * t * power(v, 0.16) ELSE t END, 5) AS wind_chill,
  round(0.4 * (t + 243.04 * g / (17.625 - g)) + 4.8, 5) AS discomfort FROM d""")
def weather_features(spark, sf_dir):
    """Quantity, discount and tax stand in for temperature, humidity and wind."""
    t, rh, v = F.col("t"), F.col("rh"), F.col("v")
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 8.0).alias("t"), (100 * (1 - 5 * F.col("l_discount"))).alias("rh"), (F.col("l_tax") * 300).alias("v"))
    dew = C.dew_point(t, rh)
    values = {"heat_index": C.heat_index(t, rh), "dew_point": dew, "wind_chill": C.wind_chill(t, v), "discomfort": C.discomfort(t, dew)}
    return w.select("l_orderkey", "l_linenumber", *(F.round(x, 5).alias(k) for k, x in values.items()))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity - 8.0 AS t, l_tax * 100 * 3.6 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN t <= 10 AND v >= 4.8 THEN 13.12 + 0.6215 * t - 11.37 * power(v, 0.16) + 0.3965 * t * power(v, 0.16) ELSE t END, 5) AS wind_chill FROM w""")
def wind_chill_of_metres(spark, sf_dir):
    """Wind in m/s, turned to km/h first."""
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 8.0).alias("t"), C.kmh(F.col("l_tax") * 100).alias("v"))
    return w.select("l_orderkey", "l_linenumber", F.round(C.wind_chill(F.col("t"), F.col("v")), 5).alias("wind_chill"))


@query("SELECT event_id, round(coalesce(value - lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS diff3 FROM events")
def lag_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return prep.lag_difference(e, "value", ["user_id"], ["ts", "event_id"], 3, "diff3").select("event_id", F.round("diff3", 6).alias("diff3"))


@query(f"WITH {_GAPS} SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE greatest(least(value, 80.0), 20.0) END AS value FROM g")
def clip_values(spark, sf_dir):
    return prep.clip_to(_events(spark, sf_dir), {"value": (20.0, 80.0)}).select("event_id", "value")


_OUT = """SELECT '{c}' AS "column", round(a, 6) AS low, round(b, 6) AS high, count_if({c} < a OR {c} > b)::BIGINT AS n_iqr, count_if({c} < {lo} OR {c} > {hi})::BIGINT AS n_domain, count_if(abs(({c} - m) / s) > 3)::BIGINT AS n_z
FROM {t}, (SELECT q1 - 1.5 * (q3 - q1) AS a, q3 + 1.5 * (q3 - q1) AS b, m, s FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_pop({c}) AS s FROM {t})) GROUP BY a, b"""


@query(_OUT.format(c="value", t="events", lo=0, hi=90) + " UNION ALL " + _OUT.format(c="user_id", t="events", lo=5, hi=1000000))
def outlier_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", F.col("user_id").cast("double").alias("user_id"))
    r = prep.outlier_report(e, ["value", "user_id"], {"value": (0, 90), "user_id": (5, 1_000_000)})
    return r.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(f"""WITH {_GAPS} SELECT count(*) AS n_rows, count_if(value IS NULL)::BIGINT AS n_null, round(100.0 * count_if(value IS NULL) / count(*), 4) AS pct_null, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event_type) AS n_types FROM g""")
def readiness_report(spark, sf_dir):
    return prep.readiness(_events(spark, sf_dir), "value", "ts", "event_type")


def _rank(key: str, by: str = "") -> str:
    return f"row_number() OVER ({by} ORDER BY {scatter_sql(key)}, {key})"


@query(f"""WITH r AS (SELECT event_id, event_type, {_rank('event_id', 'PARTITION BY event_type')} AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, CASE WHEN r <= ceil(round(n * 0.7, 6)) THEN 'train' ELSE 'test' END AS split FROM r""")
def stratified_holdout(spark, sf_dir):
    return split.holdout(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 0.7, "event_type")


@query(f"""WITH r AS (SELECT o_orderkey, {_rank('o_orderkey')} AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r <= floor(round(n * 0.7, 6)) THEN 'train' WHEN r <= floor(round(n * 0.85, 6)) THEN 'val' ELSE 'test' END AS split FROM r""")
def three_way_split(spark, sf_dir):
    return split.three_way(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(f"SELECT event_id, (({_rank('event_id', 'PARTITION BY event_type')} - 1) % 10)::INT AS fold FROM events")
def stratified_folds(spark, sf_dir):
    return split.folds(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 10, "event_type").select("event_id", "fold")


@query(f"""WITH r AS (SELECT c_custkey, {_rank('c_custkey')} AS r, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN r <= ceil(round(n * 0.8, 6)) THEN 'train' ELSE 'test' END AS split FROM r""")
def shuffled_cut(spark, sf_dir):
    return split.holdout(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.8)


@query()
def principal_components(spark, sf_dir):
    c = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows, _ = prep.principal_components(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *c), c)
    return rows.select("l_orderkey", "l_linenumber", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))
