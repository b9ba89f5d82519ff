"""Trees of thousands of nodes and attributes of very many values, against plain recursion over rows."""

import math
from collections import Counter

from pyspark.sql import functions as F

from orebody.operators import trees


def entropy(ys):
    return -sum(c / len(ys) * math.log2(c / len(ys)) for c in Counter(ys).values())


def grow(rows, attributes, values):
    """ID3 by recursion: nested (label, attribute, children), counting nodes."""
    ys = [r["y"] for r in rows]
    label = min(Counter(ys).items(), key=lambda kv: (-kv[1], kv[0]))[0]
    if len(set(ys)) == 1 or not attributes:
        return label, None, {}
    gains = []
    for a in attributes:
        parts = [[r["y"] for r in rows if r[a] == v] for v in values[a]]
        gains.append(round(entropy(ys) - sum(len(p) / len(ys) * entropy(p) for p in parts if p), 11))
    if max(gains) <= 0:
        return label, None, {}
    a = attributes[gains.index(max(gains))]
    kids = {}
    for v in values[a]:
        part = [r for r in rows if r[a] == v]
        kids[v] = grow(part, [x for x in attributes if x != a], values) if part else (label, None, {})
    return label, a, kids


def as_tuple(node):
    return node.label, node.attribute, {k: as_tuple(c) for k, c in node.children.items()}


def test_five_thousand_nodes(spark):
    names = [f"a{k}" for k in range(6)]
    bits = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(6)).cast("string").alias(n) for k, n in enumerate(names)]
    df = spark.range(9_000).select(*bits, F.pmod(F.xxhash64("id", F.lit("y")), F.lit(3)).cast("string").alias("y"))
    tree = trees.build_tree(df, names, "y", ratio=False, max_depth=5)
    assert trees.nodes(tree) > 5_000
    rows = [r.asDict() for r in df.collect()]
    values = {a: sorted({r[a] for r in rows}) for a in names}

    def cut_at(t, depth):
        return (t[0], t[1], {k: cut_at(c, depth - 1) for k, c in t[2].items()}) if depth else (t[0], None, {})

    assert as_tuple(tree) == cut_at(grow(rows, names, values), 5)

    def walk(t, r):
        while t[1]:
            t = t[2][r[t[1]]]
        return t[0]

    t = as_tuple(tree)
    got = Counter((r["y"], r["p"]) for r in df.withColumn("p", trees.predict(tree)).select("y", "p").collect())
    assert got == Counter((r["y"], walk(t, r)) for r in rows)
    pruned = trees.prune(tree, df.sample(0.3, 5), "y")
    assert 1 < trees.nodes(pruned) < trees.nodes(tree)


def test_thresholds_of_very_many_values(spark):
    df = spark.range(60_000).select((F.col("id") * 7 % 60_000 / 3).alias("x"), F.when(F.col("id") * 7 % 60_000 < 41_234, "low").otherwise("high").alias("y"), F.lit(1.0).alias("one"))
    got = {r["attribute"]: r for r in trees.best_thresholds(df, ["x", "one"], "y").collect()}
    assert got["x"]["threshold"] == (41_233 / 3 + 41_234 / 3) / 2 and got["x"]["gain_ratio"] == 1.0 and got["one"]["threshold"] is None
    tree = trees.build_tree(df, ["x", "one"], "y", numeric=["x", "one"])
    assert trees.nodes(tree) == 3 and tree.threshold == got["x"]["threshold"]
    plan = trees.best_thresholds(df, ["x"], "y")._jdf.queryExecution().executedPlan().toString()
    assert "range_" in plan  # windows run within ranges
