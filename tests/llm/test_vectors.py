"""Neighbours and codes of vectors against brute force."""

import duckdb
import numpy as np
import pytest

pytest.importorskip("orebody.llm.registry")

from orebody.llm import hnsw, vector_codes  # noqa: E402
from orebody.llm.registry import ORACLES, QUERIES  # noqa: E402


def nearest(ids, x, query, k):
    score = {int(i): float(v @ query[1]) for i, v in zip(ids, x) if i != query[0]}
    return sorted(score.items(), key=lambda r: (-r[1], r[0]))[:k]


def check(rows, ids, x, k, recall):
    """Ranks, ties, scores and recall of rows (query_id, rank, vec_id, score)."""
    vector = dict(zip(ids, x))
    by: dict = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    hit = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        got = sorted(by.pop(q), key=lambda r: r["rank"])
        truth = nearest(ids, x, (q, vector[q]), k)
        assert [r["rank"] for r in got] == list(range(1, len(truth) + 1)) and q not in [r["vec_id"] for r in got]
        assert len({r["vec_id"] for r in got}) == len(got)
        assert all(r["score"] == pytest.approx(float(vector[r["vec_id"]] @ vector[q]), rel=1e-12, abs=1e-12) for r in got)
        order = [(-r["score"], r["vec_id"]) for r in got]
        assert order == sorted(order)
        hit += sum(r["score"] >= truth[-1][1] - 1e-12 for r in got)
        total += len(truth)
    assert not by and hit >= recall * total


def test_neighbours_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    check(QUERIES["op11_hnsw"](spark, sf).collect(), ids, x, 20, 0.98)


def test_neighbours_of_several_shards_any_norms_and_many_copies(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3_000)] + 0.6 * rng.normal(size=(3_000, 16))) * rng.lognormal(0, 0.5, (3_000, 1))
    x[:1_000] = x[0]  # a third of all rows are alike
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    index = hnsw.build_index(table, shard_rows=700)
    assert index.shards_ == 5 and index.agg({"nodes": "max"}).first()[0] < 700
    queries = index.rows_.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "v as q")
    check(hnsw.search(index, queries, 20).collect(), list(range(3_000)), x, 20, 0.95)
    layers = index.orderBy("shard", "slice").first()["layers"]
    assert len(layers) > 1 and len(layers[0]) == 2 * len(layers[1])  # flat, twice as many links in the lowest


def test_graph_of_one_shard_keeps_recall():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 24))
    graph = hnsw.build(x)
    assert all(0 <= layer.max() < 3_000 and layer.min() >= -1 for layer in graph.layers)
    assert not (graph.layers[0] == np.arange(3_000)[:, None]).any()
    q = x[::30] / np.linalg.norm(x[::30], axis=1, keepdims=True)
    lifted = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
    found, _ = graph.search(lifted, 128, 0, graph.descend(lifted, 0))
    truth = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b[:20].tolist())) / 20 for a, b in zip(truth.tolist(), found)]) > 0.9


def test_awkward_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [9.0, 9.0]), (8, [-1.0, 0.0]), (9, [-0.0, 2.0])]
    table = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, label int, rank int")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op11_hnsw"](spark, str(tmp_path)).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.5), (0, 4, 9, 0.0), (0, 5, 8, -1.0), (20, 1, 9, 1.0), (20, 2, 0, 0.5), (20, 3, 6, 0.5), (20, 4, 7, 0.5), (20, 5, 8, -0.5)]
    table.limit(0).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["op11_hnsw"](spark, str(tmp_path)).count() == 0
    assert QUERIES["op12_vector_codes"](spark, str(tmp_path)).count() == 0


def test_bounds_lose_no_entry():
    rng = np.random.default_rng(0)
    spared = 0
    for trial in range(80):
        n, d, k = rng.integers(1, 500), rng.integers(1, 6), rng.integers(1, 40)
        high = int(rng.choice([3, 20, 1 << 24]))
        x = rng.integers(-high, high, (n, d))
        book = vector_codes.Codebook(x[:k], vector_codes.grouped(x[:k], 6), np.zeros(len(x[:k])))
        own = bounds = None
        for _ in range(7):
            at, least, bounds, done = vector_codes.assign(x, book, own, bounds)
            bounds = np.nextafter(bounds.astype(np.float32), np.float32(-np.inf)).astype(float)
            d2 = ((x[:, None, :] - book.entries) ** 2).sum(axis=2)
            assert (at == d2.argmin(axis=1)).all() and (least == d2.min(axis=1)).all(), trial
            spared += own is not None and n * len(book.entries) - done
            own, new = at, book.entries.copy()
            for c in np.unique(at):
                new[c] = x[at == c].sum(axis=0) // (at == c).sum()
            book = book.moved(new)
    assert spared > 100_000  # distances that the bounds made unnecessary


def by_sql(folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}'")
    return sorted(map(str, con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({ORACLES['op12_vector_codes']})").fetchall()))


def test_codes_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.integers(-4, 5, (700, 8)) / 1024 + rng.choice([0, 1e-5], (700, 8))  # ties abound
    rows = [(i if i % 50 else None, v.tolist() if i % 90 else None, int(rng.integers(0, 3)) if i % 7 else None) for i, v in enumerate(x)]
    rows += [(5_000, [float("nan")] * 8, 1), (5_001, [None] + [0.0] * 7, 1), (3, x[3].tolist(), 9), (5_002, [float("-inf")] * 8, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    (tmp_path / "t").mkdir()
    table.coalesce(1).write.parquet(str(tmp_path / "t/embeddings.parquet"))
    got = QUERIES["op12_vector_codes"](spark, str(tmp_path / "t")).collect()
    assert sorted(str(tuple(r)) for r in got) == by_sql(f"{tmp_path}/t/embeddings.parquet/*.parquet") and len(got) > 650


def test_components_too_large_are_refused(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="after scaling"):
        vector_codes.train_and_encode(table)
    table = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 1), (2, [1.0] * 8, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="one length"):
        vector_codes.train_and_encode(table)
