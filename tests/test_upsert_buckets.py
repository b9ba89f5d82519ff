"""Upserts that rewrite the buckets they touch, and what becomes of one that stops."""

import pytest
from pyspark.sql import functions as F

from orebody.operators import etl


def tables(spark, name):
    for n in (name, f"{name}__staging", f"{name}__merged", f"{name}__old"):
        spark.sql(f"DROP TABLE IF EXISTS {n}")
    return name


def files(spark, name):
    spark.catalog.refreshTable(name)
    return set(spark.table(name).inputFiles())


def held(spark, name):
    spark.catalog.refreshTable(name)
    return sorted((tuple(r) for r in spark.table(name).drop(etl.BUCKET).collect()), key=str)


def rows(spark, *values, kind="id long, v string"):
    return spark.createDataFrame(list(values), kind)


def test_only_touched_buckets_are_rewritten(spark):
    name = tables(spark, "bucketed")
    start = spark.range(1000).select("id", F.lit("old").alias("v"))
    assert etl.load(start, name, "replace", "id", 16) == 1000
    before = files(spark, name)
    assert len(before) >= 16
    own = {f for f in before if f"{etl.BUCKET}={spark.table(name).where('id = 5').first()[etl.BUCKET]}/" in f}
    assert etl.load(rows(spark, (5, "new"), kind="id int, v string"), name, "upsert", "id") == 1  # a narrower type, the same bucket
    after = files(spark, name)
    assert before - after == own and before & after == before - own
    assert held(spark, name) == sorted(((i, "new" if i == 5 else "old") for i in range(1000)), key=str)
    assert etl.load(rows(spark, (5000, "more"), (5000, "twice"), (None, "none")), name, "upsert", "id") == 3
    assert etl.load(rows(spark, (None, "again")), name, "upsert", "id") == 1  # a null key meets none
    assert etl.load(rows(spark, (6000, "last")), name, "append") == 1 and spark.table(name).count() == 1005
    assert etl.load(rows(spark, (6000, "over")), name, "upsert", "id") == 1
    got = held(spark, name)
    assert [r for r in got if r[0] == 6000] == [(6000, "over")] and sum(r[0] == 5000 for r in got) == 2 and sum(r[0] is None for r in got) == 2
    files_now = files(spark, name)
    assert etl.load(rows(spark).limit(0), name, "upsert", "id") == 0 and files(spark, name) == files_now


def test_stopped_upserts(spark, monkeypatch):
    name = tables(spark, "stopped")
    etl.load(rows(spark, *((i, "old") for i in range(50))), name, "upsert", "id", 4)  # there is none: made with buckets

    def stop(*_):
        raise RuntimeError("stopped")

    whole = etl._replace_buckets
    monkeypatch.setattr(etl, "_replace_buckets", stop)
    with pytest.raises(RuntimeError):
        etl.load(rows(spark, (1, "new")), name, "upsert", "id")
    monkeypatch.setattr(etl, "_replace_buckets", whole)
    assert (1, "old") in held(spark, name) and spark.catalog.tableExists(f"{name}__merged")
    assert etl.load(rows(spark, (2, "new")), name, "upsert", "id") == 1  # the first is made good, then the second
    got = held(spark, name)
    assert {r for r in got if r[1] == "new"} == {(1, "new"), (2, "new")} and len(got) == 50
    assert not spark.catalog.tableExists(f"{name}__merged")


def test_other_keys_and_names(spark):
    name = tables(spark, "rekeyed")
    etl.load(rows(spark, (1, "a"), (2, "b")), name, "replace", "id", 4)
    assert etl.load(rows(spark, (9, "b")), name, "upsert", "v") == 1
    assert held(spark, name) == [(1, "a"), (9, "b")] and etl.BUCKET not in spark.table(name).columns
    for df, key in ((rows(spark, (1, 1), kind=f"id long, {etl.BUCKET} int"), "id"), (rows(spark), None), (rows(spark), "w")):
        with pytest.raises(ValueError):
            etl.load(df, name, "replace", key, 4)


def test_pipeline_in_buckets(spark, tmp_path):
    name = tables(spark, "piped_buckets")
    (tmp_path / "a.csv").write_text("id,email,amount\n1,a@x,5\n2,b@x,500\n3,nobody,1\n")
    flow = etl.Pipeline(spark, {"csv": lambda s, path: s.read.option("header", True).csv(path)})
    for mode in ("replace", "upsert"):
        stats = flow.run("csv", str(tmp_path), name, {"id": "int", "amount": "float"}, mode, "id", buckets=4)
        assert (stats["rows_extracted"], stats["rows_cleaned"], stats["rows_rejected"], stats["rows_loaded"]) == (3, 3, 1, 2)
        assert spark.table(name).count() == 2
