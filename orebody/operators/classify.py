"""Classifiers: a majority rule, Gaussian naive Bayes, nearest neighbours, and MLlib's models with cross-validation."""

from __future__ import annotations

import math
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .blocks import BLOCK, chosen_pairs, closest, near_blocks, pivots_of, type_of, vectors, widened, work_on
from .evaluate import averages, class_report
from .linear import fit_folds, fourier_features, softmax, squared_hinge


def zero_r(train: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent class, the smallest on ties."""
    return train.agg(F.mode(label, True).alias("prediction"))


def fit_gaussian(train: DataFrame, label: str, columns: list[str], smoothing: float = 1e-9) -> DataFrame:
    """Prior, means and variances, a row per class. smoothing times the largest variance is added to each."""
    most = train.agg(F.greatest(*(F.var_pop(c) for c in columns)) if len(columns) > 1 else F.var_pop(columns[0])).first()[0] or 0.0
    n = train.count()
    return train.groupBy(F.col(label).alias("class_")).agg(
        (F.count("*") / n).alias("prior_"),
        *(F.avg(c).alias(f"mu_{c}") for c in columns),
        *((F.var_pop(c) + smoothing * most).alias(f"var_{c}") for c in columns),
    )


def _densest(columns: list[str]) -> Column:
    """(s, y): of the classes in model_ the one of largest log-density, the larger label on ties."""
    x = F.array(*(F.col(c).cast("double") for c in columns))

    def density(k: Column) -> Column:
        parts = F.zip_with(F.zip_with(x, k["m"], lambda p, q: (p - q) * (p - q)), k["v"], lambda p, q: p / q)
        return F.struct((k["b"] - F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)).alias("s"), k["y"].alias("y"))

    return F.array_max(F.transform("model_", density))


def predict_gaussian(df: DataFrame, model: DataFrame, columns: list[str]) -> DataFrame:
    """df with prediction: the class of largest log-density, the larger label on ties, null where a feature is. The
    model, a row per class, becomes one array that every row is scored against; rows are not joined back, so neither
    repeated nor null keys matter."""
    score = F.log("prior_")
    for c in columns:
        score = score - 0.5 * F.log(2 * math.pi * F.col(f"var_{c}"))
    one = model.agg(
        F.collect_list(
            F.struct(
                F.col("class_").alias("y"), score.alias("b"), F.array(*(F.col(f"mu_{c}") for c in columns)).alias("m"),
                F.array(*(2 * F.col(f"var_{c}") for c in columns)).alias("v"),
            )
        ).alias("model_")
    )
    best = _densest(columns)
    scored = df.crossJoin(F.broadcast(one)).withColumn("best_", best)  # one row
    return scored.withColumn("prediction", F.when(F.col("best_.s").isNotNull(), F.col("best_.y"))).drop("model_", "best_")


def nearest_neighbours(
    test: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 3, apart: str | None = None, size: int = BLOCK, tally: dict | None = None
) -> DataFrame:
    """(key, prediction) by vote of the k nearest (ties: smaller training key; votes: smaller label). Test keys are
    distinct; rows without a vector take no part. Rows alike in `apart`, if given, are no neighbours: with folds, one pass
    is a cross-validation.

    Exact, without most pairs of blocks: first a block of test rows meets the nearest blocks that hold k training rows,
    which bounds the k-th distance of each row; then those whose least distance is within its rows' bounds. A row gives
    out only what is within its bound. tally, if given, gets the number of pairs of blocks and of those computed."""
    spark = test.sparkSession
    group = (F.col(apart) if apart else F.lit(0)).alias("apart")
    a = test.select(F.col(key).alias("key"), F.col(vector).alias("vector"), group).where("vector is not null")
    b = train.select(F.col(key).alias("near"), F.col(vector).alias("vector"), F.col(label).alias("y"), group).where("vector is not null")
    a, b = cut(a), cut(b)
    kinds = f"key {type_of(a, 'key')}, near {type_of(b, 'near')}, y {type_of(b, 'y')}, d double"
    pivots = pivots_of(b, "vector", size)
    if not len(pivots):
        return spark.createDataFrame([], f"`{key}` {type_of(a, 'key')}, prediction {type_of(b, 'y')}")
    (x, here), (y, there) = near_blocks(a, "vector", pivots, size), near_blocks(b, "vector", pivots, size)

    def work(p, q):
        import numpy as np
        import pandas as pd

        q = q.sort_values("near", kind="stable")
        v, w = vectors(p["vector"]), vectors(q["vector"])
        if "bound" in p:
            gap = np.maximum(0, np.maximum(w.min(axis=0) - v, v - w.max(axis=0)))
            reached = ~(np.sqrt((gap * gap).sum(axis=1)) > widened(p["bound"].to_numpy()))
            p, v = p[reached], v[reached]
        keys, near, y = p["key"].to_numpy(), q["near"].to_numpy(), q["y"].to_numpy()
        bound = p["bound"].to_numpy() if "bound" in p else np.full(len(p), np.inf)
        ours, theirs = p["apart"].to_numpy(), q["apart"].to_numpy()
        same = (lambda part: ours[part][:, None] == theirs) if apart else None
        out = [pd.DataFrame({"key": keys[i], "near": near[j], "y": y[j], "d": d}) for i, j, d in closest(v, w, k, bound, same)]
        return pd.concat(out) if out else pd.DataFrame({"key": [], "near": [], "y": [], "d": []})

    def nearest_blocks(at):
        least, _ = here.bounds(at, there)
        order = np.argsort(np.where(there.counts > 0, least, np.inf), kind="stable")
        return order[: np.searchsorted(np.cumsum(there.counts[order]), k) + 1]

    first = chosen_pairs(spark, here, nearest_blocks)
    begun = cut(work_on(x, y, first, work, kinds))
    by_distance = Window.partitionBy("key").orderBy("d", "near")
    kth = begun.withColumn("r_", F.row_number().over(by_distance)).where(F.col("r_") == k).select(F.col("key"), F.col("d").alias("bound"))
    bounded = cut(x.join(kth, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    reach = {r["block_"]: r["w"] for r in bounded.groupBy("block_").agg(F.max("bound").alias("w")).collect()}  # a row per block

    def reached_blocks(at):
        least, _ = here.bounds(at, there)
        rest = (there.counts > 0) & ~(least > widened(reach[at]))
        rest[nearest_blocks(at)] = False
        return np.flatnonzero(rest)

    second = chosen_pairs(spark, here, reached_blocks)
    if tally is not None:
        tally["pairs"] = int((here.counts > 0).sum() * (there.counts > 0).sum())
        tally["computed"] = first.count() + second.count()
    rows = begun.unionByName(work_on(bounded, y, second, work, kinds))
    votes = rows.withColumn("r_", F.row_number().over(by_distance)).where(F.col("r_") <= k).groupBy("key", "y").agg(F.count("*").alias("v_"))
    best = votes.groupBy("key").agg(F.min(F.struct((-F.col("v_")).alias("v"), "y")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("b.y").alias("prediction"))


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def estimators(rows: int = 150, seed: int = 42) -> dict:
    """MLlib's counterparts of the model list. The RBF support vector machine is one of this library's (rbf_machine)."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier

    return {
        "naive_bayes": NaiveBayes(modelType="gaussian"),
        "decision_tree": DecisionTreeClassifier(impurity="entropy", maxDepth=4, seed=seed),
        "logistic_regression": LogisticRegression(family="multinomial", maxIter=500, regParam=1.0 / rows, elasticNetParam=0.0, standardization=False),
        "random_forest": RandomForestClassifier(numTrees=100, seed=seed),
    }


def fit_predict(name: str, train: DataFrame, test: DataFrame, columns: list[str], label: str, seed: int = 42):
    """(model, test with prediction)"""
    if name == "svm_rbf":
        ready = rbf_features(train, columns)
        model = fit_folds(ready(train), "features", label)
        return model, ready(test).withColumn("prediction", model.predict(F.col("features")))
    n, names = train.count(), columns
    # Every iteration reads the assembled rows again; they are kept, not computed anew.
    ready = _assembled(train, names).select(label, "features").persist()
    model = estimators(n, seed)[name].setLabelCol(label).setFeaturesCol("features").fit(ready)
    ready.unpersist()
    return model, model.transform(_assembled(test, names))


def rbf_features(train: DataFrame, columns: list[str], n: int = 256):
    """A function that gives a table its column `features`, for a support vector machine with RBF kernel: random Fourier
    features, an approximation, with gamma = 1 / (columns * mean variance) of train."""
    spread = train.agg(*(F.var_pop(c) for c in columns)).first()
    gamma = 1 / (len(columns) * (sum(v or 0.0 for v in spread) / len(columns) or 1.0))
    return lambda df: df.withColumn("features", fourier_features(F.array(*(F.col(c).cast("double") for c in columns)), len(columns), gamma, n))


def tree_rules(model, columns: list[str], spark) -> DataFrame:
    """(rule_id, conditions, prediction) of an MLlib decision tree, a row per leaf, in the order of its text."""
    rows: list[tuple] = []
    path: list[str] = []
    depth_of: dict[int, int] = {}  # indentation -> place in the path
    for line in model.toDebugString.splitlines()[1:]:
        depth, text = len(line) - len(line.lstrip()), line.strip()
        if text.startswith("Predict:"):
            rows.append((len(rows) + 1, " AND ".join(path), float(text.removeprefix("Predict:"))))
            continue
        test = re.sub(r"feature (\d+)", lambda m: columns[int(m[1])], text[text.index("(") + 1 : -1])
        if text.startswith("If"):
            path.append(test)
        else:  # the other side of the test of the same depth
            path[depth_of[depth] :] = [test]
            continue
        depth_of[depth] = len(path) - 1
    return spark.createDataFrame(rows, "rule_id int, conditions string, prediction double")


def importances(model, columns: list[str], spark) -> DataFrame:
    """(feature, importance), ascending."""
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy("importance", "feature")


def _bayes_of_folds(df: DataFrame, fold: str, columns: list[str], label: str, smoothing: float = 1e-9) -> DataFrame:
    """(fold, model_): Gaussian models of the rows outside each fold. One pass sums x and x^2 by fold and class, about
    the means of all rows; a fold's model is the total less its own."""
    mean = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    x = F.array(*(F.col(c).cast("double") - F.lit(mean[c]) for c in columns))
    rows = df.select(F.col(fold).alias("f"), F.col(label).alias("c"), x.alias("x"))
    d = range(len(columns))
    sums = rows.groupBy("f", "c").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[k]).alias(f"s{k}") for k in d), *(F.sum(F.col("x")[k] * F.col("x")[k]).alias(f"q{k}") for k in d))
    names = ["n", *(f"s{k}" for k in d), *(f"q{k}" for k in d)]
    sums = cut(sums)  # a row per fold and class
    every = sums.select("f").distinct().crossJoin(sums.groupBy("c").agg(*(F.sum(v).alias(f"t_{v}") for v in names)))
    own = sums.select(F.col("f").alias("f_"), F.col("c").alias("c_"), *(F.col(v).alias(f"o_{v}") for v in names))
    left = every.join(own, (F.col("f") == F.col("f_")) & F.col("c").eqNullSafe(F.col("c_")), "left")
    left = left.select("f", "c", *((F.col(f"t_{v}") - F.coalesce(f"o_{v}", F.lit(0))).alias(v) for v in names)).where("n > 0")

    def variances(n: Column, pre: str = "") -> list[Column]:
        return [F.greatest(F.lit(0.0), F.col(f"{pre}q{k}") / n - (F.col(f"{pre}s{k}") / n) * (F.col(f"{pre}s{k}") / n)) for k in d]

    whole = left.groupBy("f").agg(*(F.sum(v).alias(f"w_{v}") for v in names))
    most = F.array_max(F.array(*variances(F.col("w_n"), "w_"))) * smoothing
    both = left.join(whole.select("f", F.col("w_n"), most.alias("e")), "f")
    var = F.transform(F.array(*variances(F.col("n"))), lambda v: v + F.col("e"))
    mu = F.array(*(F.col(f"s{k}") / F.col("n") + F.lit(mean[columns[k]]) for k in d))
    base = F.log(F.col("n") / F.col("w_n")) - F.aggregate("v", F.lit(0.0), lambda s, v: s + 0.5 * F.log(2 * math.pi * v))
    both = both.withColumn("v", var).withColumn("m", mu)
    model = F.struct(F.col("c").alias("y"), base.alias("b"), "m", F.transform("v", lambda v: 2 * v).alias("v"))
    return both.groupBy(F.col("f").alias("fold_")).agg(F.collect_list(model).alias("model_"))  # a row per class in a list


def _scored_folds(df: DataFrame, fold: str, name: str, columns: list[str], label: str, key: str | None, workers: int) -> DataFrame:
    """df with prediction, each row's by a model of the other folds."""
    if name == "zero_r":
        counts = df.groupBy(F.col(fold).alias("f"), F.col(label).alias("c")).agg(F.count("*").alias("n"))
        total = counts.groupBy("c").agg(F.sum("n").alias("t"))
        rest = counts.select("f").distinct().crossJoin(total).join(counts, ["f", "c"], "left").select("f", "c", (F.col("t") - F.coalesce("n", F.lit(0))).alias("n"))
        most = rest.where("n > 0").groupBy(F.col("f").alias("fold_")).agg(F.min(F.struct((-F.col("n")).alias("n"), "c")).alias("b"))
        return df.join(F.broadcast(most), F.col(fold) == F.col("fold_")).withColumn("prediction", F.col("b.c"))  # a row per fold
    if name == "naive_bayes":
        models = _bayes_of_folds(df, fold, columns, label)
        rows = df.join(F.broadcast(models), F.col(fold) == F.col("fold_"))  # a row per fold
        return rows.withColumn("best_", _densest(columns)).withColumn("prediction", F.when(F.col("best_.s").isNotNull(), F.col("best_.y")))
    if name == "knn":
        rows = df.withColumn("vector_", F.array(*columns))
        return df.join(nearest_neighbours(rows, rows, key, "vector_", label, apart=fold), key)
    if name in ("svm_rbf", "logistic_regression"):
        make = rbf_features(df, columns) if name == "svm_rbf" else lambda d: d.withColumn("features", F.array(*(F.col(c).cast("double") for c in columns)))
        ready = make(df)
        model = fit_folds(ready, "features", label, fold, squared_hinge if name == "svm_rbf" else softmax)
        return ready.withColumn("prediction", model.predict(F.col("features"), F.col(fold)))
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    with ThreadPoolExecutor(workers) as pool:  # MLlib's trees: a fit for each fold, several at a time
        parts = list(pool.map(lambda k: fit_predict(name, df.where(F.col(fold) != k), df.where(F.col(fold) == k), columns, label)[1], folds))
    return reduce(DataFrame.unionByName, [p.select(fold, label, "prediction") for p in parts])


def cross_validate(df: DataFrame, fold: str, names: list[str], columns: list[str], label: str, key: str | None = None, workers: int = 4) -> DataFrame:
    """(model, fold, accuracy, weighted_f1) for every fold. zero_r, the majority rule, and naive_bayes are worked out
    from sums by fold; knn, three neighbours (needs a key), compares each pair of rows once; svm_rbf and
    logistic_regression fit all folds in the same passes, the features of the former scaled by the variance of all
    rows; decision_tree and random_forest are MLlib's, fold by fold."""
    cells = []
    for name in names:
        scored = _scored_folds(df, fold, name, columns, label, key, workers)
        cells.append(
            scored.groupBy(F.lit(name).alias("model"), F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), F.col("prediction").cast("double").alias("p"))
            .agg(F.count("*").alias("n"))
        )
    cells = cut(reduce(DataFrame.unionByName, cells))
    by = ["model", "fold"]
    sides = cells.select(*by, F.inline(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen"), F.lit(0).cast("long").alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
    ))).where("c is not null")
    s = sides.groupBy(*by, "c").agg(*(F.sum(v).alias(v) for v in ("support", "chosen", "hit")))
    f1 = F.round(F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("chosen")), F.lit(0.0)), 6)
    return s.groupBy(*by).agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.round(F.sum(f1 * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))


def compare(scores: DataFrame, order: list[str]) -> DataFrame:
    """(model, cv_mean, cv_std, f1, best): population deviation over folds; best is the first of the largest means,
    the majority rule left out."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    table = scores.groupBy("model").agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"), F.avg("weighted_f1").alias("f1"))
    best = table.where("model <> 'zero_r'").agg(F.max(F.struct("cv_mean", (-at).alias("o"), "model")).alias("b"))
    return table.crossJoin(F.broadcast(best)).select(
        "model", F.round("cv_mean", 6).alias("cv_mean"), F.round("cv_std", 6).alias("cv_std"), F.round("f1", 6).alias("f1"), (F.col("model") == F.col("b.model")).alias("best")
    )
