"""What only shows on tables larger than the given ones."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.operators import agglomerate, evaluate, prep, rules, stats, trees
from orebody.operators.blocks import closest, distances
from orebody.plans import association
from orebody.plans.registry import ORACLES, QUERIES


def test_customers_without_an_id_repeat_nobody(spark, tmp_path):
    """The second and third lose their ids, and all that is left of them is alike."""
    rows = spark.createDataFrame([(k, f"Customer#{k}", 55.5) for k in (20, 2431, 2431 * 13)], "c_custkey long, c_name string, c_acctbal double")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.sql(ORACLES["etl_duplicates"]).fetchall()
    assert [tuple(r) for r in QUERIES["etl_duplicates"](spark, str(tmp_path)).collect()] == want == [(1,)]


def test_filling_in_time_reads_no_frame_anew_for_each_row(spark):
    """Every frame grows from row to row; values before the first and in empty buckets come from what follows."""
    values = [None, None, 3.0, None, None, None, 7.0, None]
    rows = spark.createDataFrame([(n, n // 2, v) for n, v in enumerate(values)], "id long, day long, value double")
    filled = prep.fill_in_time(rows, "id", "value", F.col("day"), ["id"])
    assert [r["value"] for r in filled.orderBy("id").collect()] == [3.0, 3.0, 3.0, 3.0, 3.0, 3.0, 7.0, 7.0]
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()


def test_a_tree_of_counted_rows_is_that_of_all_rows(spark):
    rows = spark.range(600).select(F.expr("string(id % 3)").alias("a"), F.expr("id % 7").alias("b"), F.expr("string((id % 3 * id % 7) % 4)").alias("y"))
    counted = rows.groupBy("a", "b", "y").agg(F.count("*").alias("n"))
    tree = trees.build_tree(rows, ["a", "b"], "y", numeric=["b"])
    small = trees.build_tree(counted, ["a", "b"], "y", numeric=["b"], weight="n")
    assert trees.nodes(tree) > 3 and small == tree
    for scope in ("routed", "global"):
        assert trees.prune(small, counted, "y", scope, "n") == trees.prune(tree, rows, "y", scope)
    one, two = (trees.compare_trees({"t": tree}, {"all": d}, "y", w).first() for d, w in ((rows, None), (counted, "n")))
    assert one == two
    cells = [{tuple(r) for r in evaluate.confusion(d.withColumn("p", trees.predict(tree)), "y", "p", w).collect()} for d, w in ((rows, None), (counted, "n"))]
    assert cells[0] == cells[1]


def test_closest_rows_are_those_of_all_differences():
    """Far from the origin, with copies and rows that do not count for each other."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(1e4, 1, (50, 64)), rng.normal(1e4, 1, (90, 64))
    y[30:60] = y[:30]
    x[:5] = y[:5]
    within, group, of = np.r_[np.full(40, np.inf), np.full(10, 11.0)], np.arange(50) % 3, np.arange(90) % 3
    d = np.round(np.sqrt((np.abs(x[:, None] - y[None]) ** 2).sum(axis=2)), 9)
    d[group[:, None] == of] = np.inf
    got = [(i, j, v) for a in closest(x, y, 3, within, lambda part: group[part][:, None] == of) for i, j, v in zip(*a)]
    assert got == [(i, j, d[i, j]) for i in range(50) for j in np.argsort(d[i], kind="stable")[:3] if d[i, j] <= within[i]]
    for metric, fold in (("euclidean", lambda a: np.sqrt((a * a).sum(-1))), ("manhattan", lambda a: a.sum(-1)), ("chebyshev", lambda a: a.max(-1))):
        assert np.array_equal(np.concatenate([p for _, p in distances(x[:, :3], y[:, :3], metric)]), fold(np.abs(x[:, None, :3] - y[None, :, :3])))


def test_silhouettes_of_several_clusterings_are_those_of_each(spark):
    rows = spark.range(70).selectExpr("id", "array(double(id * 37 % 101), double(id * id % 53)) as v", "int(id % 2) as a", "int(if(id = 9, 2, id % 2)) as b")
    got = evaluate.silhouette_means(rows, "id", "v", {"a": 2, "b": 4}, size=16)
    want = [evaluate.silhouettes(rows, "id", "v", c).agg(F.avg("silhouette")).first()[0] for c in "ab"]
    assert np.allclose(got, want)


@pytest.mark.parametrize("linkage", ["ward", "single", "complete"])
def test_pruned_rounds_find_the_pairs_of_all_rounds(spark, monkeypatch, linkage):
    rows = spark.range(90).selectExpr("id as cluster_", "1 + id % 3 as w_", "array(double(id * 37 % 101), double(id * id % 53)) as vector")
    pairs = []
    for many in (0, 1_000):
        monkeypatch.setattr(agglomerate, "MANY", many)
        pairs.append({(r[0], r[1]) for r in agglomerate._mutual(rows, linkage, 16).collect()})
    assert pairs[0] == pairs[1] and pairs[0]


def test_no_join_puts_all_baskets_of_an_item_into_one_task(spark, monkeypatch):
    """Joins of baskets or bitmaps have the slice in their keys."""
    joins = []

    def seen(node):
        if node.nodeName() == "Join" and any(f"{c}#" in node.output().mkString(" ") for c in ("tid", "slice")):
            joins.append(node.condition().toString())
        for k in range(node.children().size()):
            seen(node.children().apply(k))

    def watched(df, cut=rules.cut):
        seen(df._jdf.queryExecution().optimizedPlan())
        return cut(df)

    monkeypatch.setattr(rules, "SLICE", 9)
    monkeypatch.setattr(rules, "cut", watched)
    baskets = spark.range(60).selectExpr("id as tid", "explode(array('a', if(id % 2 = 0, 'b', 'c'), if(id % 3 < 2, 'd', 'a'), concat('rare', id))) as item")
    got = {",".join(r["items"]): r["cnt"] for r in rules.apriori(baskets, 20).collect()}
    assert got == {"a": 60, "b": 30, "c": 30, "d": 40, "a,b": 30, "a,c": 30, "a,d": 40, "b,d": 20, "c,d": 20, "a,b,d": 20, "a,c,d": 20}
    assert len(joins) > 3 and all("slice#" in j for j in joins)


def test_equal_distances_of_copies_lie_in_runs(spark, monkeypatch):
    """Pairs of two stretches of equal vectors follow each other, in several blocks and tasks."""
    rows = spark.range(60).selectExpr("id", "array(double(id % 3), double(id % 3 * id % 3)) as v").repartition(5, "id")
    want = {(i, j): math.dist((i % 3, i % 3 * i % 3), (j % 3, j % 3 * j % 3)) for j in range(60) for i in range(j)}
    whole = stats.own_pairs
    for size, tasks in ((60, 1), (20, 2)):
        monkeypatch.setattr(stats, "own_pairs", lambda df, work, schema: whole(df, work, schema, size))
        got = stats.pairwise(rows, "id", "v").withColumn("task", F.spark_partition_id()).collect()
        assert {(r["i"], r["j"]): r["d"] for r in got} == pytest.approx(want) and len(got) == len(want)
        assert sum((a["d"], a["task"]) != (b["d"], b["task"]) for a, b in zip(got, got[1:])) < 9
        assert len({r["task"] for r in got}) >= tasks
    assert stats.pairwise(rows.limit(0), "id", "v").count() == 0


@pytest.mark.parametrize("name", ["cross_sell", "rule_summary", "rules_for_promo", "surest_rule"])
def test_what_a_task_holds_of_baskets_does_not_grow_with_the_tables(spark, sf, monkeypatch, name):
    """Not even where shuffles are set to few partitions, or joined to few."""
    held = []

    def watched(df, cut=rules.cut):
        out = cut(df)
        held.append(max((r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()), default=0))
        return out

    monkeypatch.setattr(rules, "TASK_ROWS", 500, raising=False)
    monkeypatch.setattr(rules, "SLICE", 100)
    monkeypatch.setattr(rules, "cut", watched)
    monkeypatch.setattr(association, "cut", watched)
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(tuple(r) for r in QUERIES[name](spark, sf).collect()) == sorted(con.sql(ORACLES[name]).fetchall())
    assert len(held) > 4 and max(held) < 1_000
