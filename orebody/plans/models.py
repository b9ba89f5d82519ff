"""Trees, classifiers and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ordering import scatter_sql
from ..operators import classify, evaluate, split, trees
from .base import query, table

_FLAGS = ["l_linestatus", "l_linenumber"]


def _entropy(counts: str) -> str:
    return f"(SELECT -sum(p * log2(p)) FROM (SELECT n / sum(n) OVER () AS p FROM ({counts})))"


@query("SELECT round(entropy(l_returnflag), 6) AS entropy FROM lineitem")
def class_entropy(spark, sf_dir):
    return trees.class_entropy(table(spark, sf_dir, "lineitem"), "l_returnflag")


_GAIN = """SELECT '{a}' AS attribute, round(h - r, 6) AS gain, round(s, 6) AS split_info, round((h - r) / CASE WHEN s = 0 THEN 1e-9 ELSE s END, 6) AS gain_ratio
FROM (SELECT entropy(l_returnflag) AS h, entropy({a}) AS s FROM lineitem), (SELECT sum(n * e) / sum(n) AS r FROM (SELECT count(*) AS n, entropy(l_returnflag) AS e FROM lineitem GROUP BY {a}))"""


@query(" UNION ALL ".join(_GAIN.format(a=a) for a in _FLAGS))
def gain_ratios(spark, sf_dir):
    return trees.attribute_gains(table(spark, sf_dir, "lineitem"), _FLAGS, "l_returnflag")


@query("""WITH v AS (SELECT l_quantity AS v, count_if(l_returnflag = 'A')::DOUBLE AS a, count_if(l_returnflag = 'N')::DOUBLE AS n, count_if(l_returnflag = 'R')::DOUBLE AS r FROM lineitem GROUP BY 1),
w AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(a) OVER (ORDER BY v) AS la, sum(n) OVER (ORDER BY v) AS ln_, sum(r) OVER (ORDER BY v) AS lr, sum(a) OVER () AS ta, sum(n) OVER () AS tn, sum(r) OVER () AS tr FROM v),
x AS (SELECT (v + nx) / 2 AS threshold, la + ln_ + lr AS l, ta + tn + tr AS t, [la, ln_, lr] AS lc, [ta - la, tn - ln_, tr - lr] AS rc, [ta, tn, tr] AS tc FROM w WHERE nx IS NOT NULL),
y AS (SELECT threshold, l, t, list_sum(list_transform(lc, lambda c: CASE WHEN c > 0 THEN -c / l * log2(c / l) ELSE 0 END)) AS hl, list_sum(list_transform(rc, lambda c: CASE WHEN c > 0 THEN -c / (t - l) * log2(c / (t - l)) ELSE 0 END)) AS hr,
  list_sum(list_transform(tc, lambda c: CASE WHEN c > 0 THEN -c / t * log2(c / t) ELSE 0 END)) AS h FROM x),
z AS (SELECT threshold, round((h - (l * hl + (t - l) * hr) / t) / (-(l / t) * log2(l / t) - (1 - l / t) * log2(1 - l / t)), 6) AS gain_ratio FROM y)
SELECT 'l_quantity' AS attribute, threshold, gain_ratio FROM z ORDER BY gain_ratio DESC, threshold LIMIT 1""")
def best_threshold(spark, sf_dir):
    return trees.best_thresholds(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_returnflag")


def _binned(spark, sf_dir):
    """Distinct rows of bands, and how many rows of lineitem each stands for."""
    li = table(spark, sf_dir, "lineitem")
    bands = li.select(
        "l_returnflag", "l_linestatus", F.year("l_shipdate").cast("string").alias("ship_year"), F.floor(F.col("l_quantity") / 10).cast("string").alias("quantity_band"),
        F.floor(F.col("l_discount") * 100).alias("discount"), F.floor(F.col("l_tax") * 100).alias("tax"),
    )
    return cut(bands.groupBy(*bands.columns).agg(F.count("*").alias("n")))


@query()
def id3_rules(spark, sf_dir):
    rows = _binned(spark, sf_dir)
    return trees.rules_frame(spark, trees.build_tree(rows, ["l_linestatus", "ship_year", "quantity_band"], "l_returnflag", ratio=False, weight="n"))


def _grown(spark, sf_dir):
    """Grown on four fifths, pruned on the rest."""
    rows = _binned(spark, sf_dir).withColumn("k_", F.pmod(F.xxhash64("ship_year", "quantity_band", "discount", "tax"), F.lit(5)))
    tree = trees.build_tree(rows.where("k_ <> 0"), ["ship_year", "quantity_band", "discount", "tax"], "l_returnflag", numeric=["discount", "tax"], weight="n")
    return rows, tree, trees.prune(tree, rows.where("k_ = 0"), "l_returnflag", weight="n")


@query()
def j48_confusion(spark, sf_dir):
    """The pruned tree's predictions on all rows."""
    rows, _, tree = _grown(spark, sf_dir)
    return evaluate.confusion(rows.withColumn("p_", trees.predict(tree)), "l_returnflag", "p_", "n")


@query()
def pruning_comparison(spark, sf_dir):
    rows, tree, pruned = _grown(spark, sf_dir)
    return trees.compare_trees({"unpruned": tree, "pruned": pruned}, {"all": rows, "validation": rows.where("k_ = 0")}, "l_returnflag", "n")


_SCORED = "s AS (SELECT l_returnflag AS y, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS p FROM lineitem)"


def _scored(spark, sf_dir):
    rule = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), rule.alias("p"))


@query(f"WITH {_SCORED} SELECT y AS actual, p AS predicted, count(*) AS n FROM s GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_scored(spark, sf_dir), "y", "p")


@query(f"WITH {_SCORED} SELECT round(avg((y = p)::INT), 6) AS accuracy FROM s")
def accuracy(spark, sf_dir):
    return evaluate.accuracy(_scored(spark, sf_dir), "y", "p")


_REPORT = """r AS (SELECT label, round(coalesce(hit / nullif(chosen, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(hit / nullif(support, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2.0 * hit / nullif(chosen + support, 0), 0), 6) AS f1, support FROM (SELECT label, (SELECT count(*) FROM s WHERE y = label) AS support, (SELECT count(*) FROM s WHERE p = label) AS chosen, (SELECT count(*) FROM s WHERE y = label AND p = label) AS hit
  FROM (SELECT y AS label FROM s UNION SELECT p FROM s)))"""


@query(f"WITH {_SCORED}, {_REPORT} SELECT * FROM r")
def class_report(spark, sf_dir):
    return evaluate.class_report(_scored(spark, sf_dir), "y", "p")


@query(f"""WITH {_SCORED}, {_REPORT} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM r""")
def report_averages(spark, sf_dir):
    return evaluate.averages(evaluate.class_report(_scored(spark, sf_dir), "y", "p"))


@query("SELECT event_type AS prediction FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def zero_r(spark, sf_dir):
    return classify.zero_r(table(spark, sf_dir, "events"), "event_type")


_DIMS = 64


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", "embedding", *(F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(_DIMS)))


_GNB_LOG = " ".join(f"- 0.5 * ln(2 * pi() * v{k}) - power(x{k} - m{k}, 2) / (2 * v{k})" for k in range(_DIMS))


@query(f"""WITH d AS (SELECT vec_id, label, {', '.join(f'embedding[{k + 1}]::DOUBLE AS x{k}' for k in range(_DIMS))} FROM embeddings),
t AS (SELECT * FROM d WHERE vec_id % 3 <> 0), g AS (SELECT 1e-9 * greatest({', '.join(f'var_pop(x{k})' for k in range(_DIMS))}) AS e FROM t),
m AS (SELECT label AS c, count(*) / (SELECT count(*) FROM t)::DOUBLE AS prior, {', '.join(f'avg(x{k}) AS m{k}, var_pop(x{k}) + any_value(e) AS v{k}' for k in range(_DIMS))} FROM t, g GROUP BY 1)
SELECT vec_id, label, arg_max(c, ln(prior) {_GNB_LOG}) AS prediction FROM d, m WHERE vec_id % 3 = 0 GROUP BY 1, 2""")
def gaussian_bayes(spark, sf_dir):
    p, cols = _points(spark, sf_dir), [f"x{k}" for k in range(_DIMS)]
    model = classify.fit_gaussian(p.where("vec_id % 3 <> 0"), "label", cols)
    return classify.predict_gaussian(p.where("vec_id % 3 = 0"), model, cols).select("vec_id", "label", "prediction")


@query("""WITH n AS (SELECT a.vec_id AS t, b.vec_id AS k, b.label AS y, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
r AS (SELECT t, y FROM n QUALIFY row_number() OVER (PARTITION BY t ORDER BY d, k) <= 3), v AS (SELECT t, y, count(*) AS c FROM r GROUP BY ALL)
SELECT t AS vec_id, y AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY t ORDER BY c DESC, y) = 1""")
def three_neighbours(spark, sf_dir):
    p = _points(spark, sf_dir)
    return classify.nearest_neighbours(p.where("vec_id % 5 = 0"), p.where("vec_id % 5 <> 0"), "vec_id", "embedding", "label")


_COLUMNS = [f"x{k}" for k in range(_DIMS)]


def _labelled(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("label", F.col("label").cast("double"))


def _halves(spark, sf_dir):
    p = cut(split.holdout(_labelled(spark, sf_dir), "vec_id", 0.7, "label"))
    return p.where("split = 'train'"), p.where("split = 'test'")


MODELS = ["zero_r", "naive_bayes", "knn", "decision_tree", "logistic_regression", "svm_rbf", "random_forest"]


@query()
def model_comparison(spark, sf_dir):
    """Ten-fold cross-validation of all seven models on all dimensions, and which is best."""
    p = cut(split.folds(_labelled(spark, sf_dir), "vec_id", 10, "label"))
    return classify.compare(classify.cross_validate(p, "fold", MODELS, _COLUMNS, "label", "vec_id"), MODELS)


_FOLDED = f"""d AS (SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {scatter_sql('vec_id')}, vec_id) - 1) % 10)::INT AS fold,
  {', '.join(f'embedding[{k + 1}]::DOUBLE AS x{k}' for k in range(_DIMS))} FROM embeddings), k AS (SELECT DISTINCT fold AS kf FROM d),
e AS (SELECT kf, 1e-9 * greatest({', '.join(f'var_pop(x{k})' for k in range(_DIMS))}) AS e, count(*) AS n FROM k JOIN d ON fold <> kf GROUP BY 1),
m AS (SELECT kf, label AS c, count(*) AS cn, count(*) / any_value(n)::DOUBLE AS prior, {', '.join(f'avg(x{k}) AS m{k}, var_pop(x{k}) + any_value(e) AS v{k}' for k in range(_DIMS))}
  FROM e JOIN d ON fold <> kf GROUP BY 1, 2),
s AS (SELECT 'naive_bayes' AS model, fold, vec_id, label AS y, arg_max(c, ln(prior) {_GNB_LOG}) AS p FROM d JOIN m ON fold = kf GROUP BY ALL
  UNION ALL SELECT 'zero_r', fold, vec_id, label, b FROM d JOIN (SELECT kf, arg_min(c, (-cn, c)) AS b FROM m GROUP BY 1) ON fold = kf),
r AS (SELECT model, fold, c, sum(a) AS support, sum(b) AS chosen, sum(h) AS hit FROM (SELECT model, fold, y AS c, 1 AS a, 0 AS b, 0 AS h FROM s UNION ALL SELECT model, fold, p, 0, 1, (y = p)::INT FROM s) GROUP BY ALL)"""


@query(f"""WITH {_FOLDED} SELECT model, fold, sum(hit) / sum(support)::DOUBLE AS accuracy,
  round(sum(round(2 * hit / (support + chosen)::DOUBLE, 6) * support) / sum(support), 6) AS weighted_f1 FROM r GROUP BY ALL""")
def fold_scores(spark, sf_dir):
    """The scores of each fold, of the two models that are sums."""
    p = cut(split.folds(_labelled(spark, sf_dir), "vec_id", 10, "label"))
    return classify.cross_validate(p, "fold", ["zero_r", "naive_bayes"], _COLUMNS, "label")


@query()
def svm_report(spark, sf_dir):
    """A support vector machine with RBF kernel, by class, on held-out rows."""
    return _test_report(spark, sf_dir, "svm_rbf")


@query()
def forest_report(spark, sf_dir):
    return _test_report(spark, sf_dir, "random_forest")


def _test_report(spark, sf_dir, name):
    train, test = _halves(spark, sf_dir)
    _, scored = classify.fit_predict(name, train, test, _COLUMNS, "label")
    return evaluate.class_report(scored, "label", "prediction")


@query()
def logistic_report(spark, sf_dir):
    return _test_report(spark, sf_dir, "logistic_regression")


@query()
def forest_importances(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    model, _ = classify.fit_predict("random_forest", train, test, _COLUMNS, "label")
    return classify.importances(model, _COLUMNS, spark)


@query()
def tree_rule_text(spark, sf_dir):
    """The rules of an MLlib decision tree."""
    train, test = _halves(spark, sf_dir)
    model, _ = classify.fit_predict("decision_tree", train, test, _COLUMNS, "label")
    return classify.tree_rules(model, _COLUMNS, spark)


@query(" UNION ALL ".join(_GAIN.format(a=a) for a in _FLAGS) + " ORDER BY gain DESC, attribute")
def gains_in_order(spark, sf_dir):
    return trees.attribute_gains(table(spark, sf_dir, "lineitem"), _FLAGS, "l_returnflag").orderBy(F.desc("gain"), "attribute")
