"""Near copies in crowded groups: every link kept, few pairs given out."""

import random

import numpy as np
import pytest

pytest.importorskip("orebody.llm.registry")

from orebody.llm import near_copies  # noqa: E402


def crowd(seed, groups, size, words, changed):
    """Groups of texts, each a base text with some words of its own."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(5_000)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for k in rng.sample(range(words), rng.randint(*changed)):
                w[k] = f"z{rng.randrange(10**9)}"
            out.append(" ".join(w))
    return out


def smallest(texts):
    """The least place of each component of links at an exact similarity of 0.8."""
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]
    names = {s: k for k, s in enumerate(set().union(*sets))}
    x = np.zeros((len(sets), len(names)), dtype=np.float32)
    for i, s in enumerate(sets):
        x[i, [names[g] for g in s]] = 1
    both, size = x @ x.T, x.sum(axis=1)
    link = 9 * both >= 4 * (size[:, None] + size)
    label = np.arange(len(sets))
    while True:
        low = np.where(link, label, len(sets)).min(axis=1)
        if (low == label).all():
            return np.flatnonzero(label == np.arange(len(sets))).tolist()
        label = np.minimum(low, label)


@pytest.fixture
def tables(monkeypatch):
    rows, write = {}, near_copies.materialize

    def counted(df, name, **options):
        out = write(df, name, **options)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    return rows


@pytest.mark.parametrize(("words", "changed"), [(200, (4, 4)), (700, (8, 16))])
def test_a_crowd_gives_few_pairs(spark, tables, words, changed, monkeypatch):
    monkeypatch.setattr(near_copies, "LIST", 100)  # lists of several chunks
    monkeypatch.setattr(near_copies, "SAMPLE", 150)  # an order by sampled shingles
    texts = crowd(1, 1, 400, words, changed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert sorted(r[0] for r in near_copies.keep_one(docs).select("doc_id").collect()) == smallest(texts)
    assert sum(tables["proposed"]) < 400 * 399 / 2 / 10


def test_groups_apart(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LIST", 8)
    texts = crowd(2, 12, 25, 90, (0, 5)) + crowd(3, 30, 2, 400, (1, 12)) + crowd(4, 5, 10, 1_500, (10, 40))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r[0] for r in near_copies.keep_one(docs).select("doc_id").collect()) == smallest(texts)


def test_signatures_never_exceed_what_differs():
    rng = np.random.default_rng(6)
    pool = rng.integers(-(2**63), 2**63 - 1, 6_000)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (1, 5, 120, 130, 300, 700, 1_000, 2_500, 5_000)]
    signs = near_copies.Signatures(np.array([*map(near_copies.signature, sets), None], dtype=object)[:-1])
    assert len(set(signs.bits.tolist())) > 3
    i, j = np.triu_indices(len(sets))
    apart = signs.apart(i, j)
    differ = [len(set(sets[a]) ^ set(sets[b])) for a, b in zip(i, j)]
    assert (apart <= differ).all() and (apart[i == j] == 0).all()
    assert all(a >= 0.5 * d for a, d in zip(apart.tolist(), differ) if d < 150)
