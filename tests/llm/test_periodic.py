"""Periodic runs against a brute-force version, of word lists and of the query's contract."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import pytest

pytest.importorskip("orebody.llm.registry")

from orebody.llm import periodic  # noqa: E402
from orebody.llm.registry import QUERIES  # noqa: E402


def runs_of(w, least=6):
    """All maximal stretches of every period, and of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < e for s, e, q in runs)]


def test_runs_by_brute_force():
    rng = random.Random(5)
    for _ in range(1_500):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 70), "abcde"[: rng.choice((1, 2, 2, 3, 5))]
            w = [rng.choice(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange((n - a) // 3 + 1)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            texts.append(" ".join(w))
        for text, (words, runs) in zip(texts, periodic.find_runs(texts)):
            expected = runs_of(text.split())
            assert [tuple(r) for r in runs.tolist()] == expected
            assert periodic.kept_words(words, runs) == kept(words, expected)


def test_long_texts_take_little_more_than_linear_time():
    began = time.perf_counter()
    (_, one), (_, two) = periodic.find_runs(["a " * 100_000, "a b c " * 40_000])
    assert one.tolist() == [[0, 100_000, 1]] and two.tolist() == [[0, 120_000, 3]]
    assert time.perf_counter() - began < 20


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = runs_of(w)
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2])) if runs else None
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{e - s},{q}\n" for s, e, q in runs), " ".join(kept(w, runs)))]
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, *digest)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, sf).collect()))
    # The brute-force version takes the square of a text's words: long texts that were not made periodic are left to the
    # test above.
    short = {d for d, t in docs if len(t or "") < 9_000}
    assert len(got) == len(docs) and len(short) > 150
    assert [r for r in got if r[0] in short] == sorted(contract(d, t) for d, t in docs if d in short)
    assert sum(r[1] > 0 for r in got) > 5


def test_awkward_rows(spark, tmp_path):
    texts = [None, "", " \n\t", "a", "x " * 30, "la la la la la la di di di di di di", "word " * 5_000, "é é é é é é", "a b a b a b a b", "a\x1cb " * 9]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(None, "y y y y y y y", 7, "x")] * 2 + [(4, "x " * 30, 7, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string").repartition(3)
    path = str(tmp_path / "documents.parquet")
    table.write.parquet(path)
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((contract(r[0], r[1]) for r in rows), key=str)
    found = {r["doc_id"]: r for r in periodic.periodic_runs(table).collect()}
    assert found[5]["collapsed"] == "la di" and [tuple(r) for r in found[5]["runs"]] == [(0, 6, 1), (6, 6, 1)]
    assert found[0]["collapsed"] == "" and found[0]["n_words"] == 0
    table.limit(0).write.mode("overwrite").parquet(path)
    assert QUERIES["op13_periodic_runs"](spark, str(tmp_path)).count() == 0
