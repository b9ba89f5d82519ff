"""Periodic runs of words by Main-Lorentz divide and conquer (operator 13).

A run is a stretch of consecutive words with smallest period q, of at least `least` words and `EXPONENT` periods, that
no neighbouring word extends. Texts are cut into words, and words interned as integers: of a batch all texts lie in one
array, with a number of its own between two of them, so that no run crosses.

The array is halved down to blocks of four. Each boundary between two halves belongs to one level, and all boundaries of
a level are worked at once. A run that lies within the two halves and crosses their boundary has two periods or more on
one side of it. On the right that is Z(q) >= q for the Z-function of the right half (how many words from the boundary on
agree with those q later), on the left the same for the left half read backwards. So the smallest such q is looked for:
three single words thin the candidates out, then Z is counted by comparison, which the half bounds. All candidates
that the found stretch covers twice are multiples of q, by Fine and Wilf, and go; the next is at least half a stretch
further, so a boundary has a logarithmic number of them. The stretch is extended over the boundary within the block.
Where it reaches the block's edge and goes on, it crosses a boundary of a higher level and is found there. Intervals
found from both sides, or with several periods, are one, with the smallest period. Work is O(n log^2 n) words at most.

Null and empty texts have no words and no runs. Texts of any length are read whole: the memory of a task is that of some
SLICE bytes of text, or of the longest text, in some hundred bytes a word. Rows with null or repeated ids get a row each, an empty
table none. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import JAVA_SPACE, WORD, byte_slices, table

EXPONENT = 4
LEAST = 6
SLICE = 4 << 20
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def agreement(ids: np.ndarray, at: np.ndarray, other: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from `at` on (step 1), or from it back (step -1), equal those from `other` on: at most `most`."""
    out = np.zeros(len(at), dtype=np.int64)
    left, width = np.flatnonzero(most > 0), 8
    while len(left):
        room = np.minimum(most[left] - out[left], width)
        k = np.arange(int(room.max()))
        inside = k < room[:, None]
        move = step * np.where(inside, out[left][:, None] + k, 0)
        differ = (ids[at[left][:, None] + move] != ids[other[left][:, None] + move]) & inside
        hit = differ.any(axis=1)
        out[left] += np.where(hit, differ.argmax(axis=1), room)
        left = left[~hit]
        left = left[out[left] < most[left]]
        width = max(8, min(2 * width, (1 << 20) // max(1, len(left))))
    return out


def _crossing(ids: np.ndarray, mids: np.ndarray, half: int, longest: int) -> Iterator[np.ndarray]:
    """Rows (start, end, period) of stretches across the boundaries mids, periodic from one of their sides."""
    far = min(half // 2, longest)  # the largest period looked for
    for step in (1, -1):
        base = mids if step == 1 else mids - 1  # the first word of the half, away from the boundary
        found: list[tuple[np.ndarray, np.ndarray]] = []
        periods = np.arange(1, far + 1)
        for at in range(0, len(mids), max(1, (1 << 20) // far)):
            own = base[at : at + max(1, (1 << 20) // far), None]
            same = ids[own + step * periods] == ids[own]
            row, k = np.nonzero(same)
            p = periods[k]
            b = own[row, 0]
            ok = ids[b + step * (p - 1)] == ids[b + step * (2 * p - 1)]
            row, p, b = row[ok], p[ok], b[ok]
            for n in range(1, 8):
                ok = ids[b + step * (p * n // 8)] == ids[b + step * (p * n // 8 + p)]
                row, p, b = row[ok], p[ok], b[ok]
            found.append((row + at, p))
        row, p = (np.concatenate(x) for x in zip(*found))
        while len(row):
            first = np.append(True, row[1:] != row[:-1])  # the smallest candidate of each boundary
            r, q = row[first], p[first]
            z = agreement(ids, base[r], base[r] + step * q, half - q, step)
            good = z >= q
            back = agreement(ids, base[r[good]] - step, base[r[good]] + step * (q[good] - 1), np.full(int(good.sum()), half), -step)
            near = base[r[good]] - step * back
            edge = base[r[good]] + step * (q[good] + z[good] - 1)
            yield np.stack([np.minimum(near, edge), np.maximum(near, edge) + 1, q[good]], axis=1)
            # What the stretch covers twice is done with; a failed candidate is done with itself.
            reach = np.zeros(len(mids), dtype=np.int64)
            reach[r] = np.where(good, (q + z) // 2, q)
            keep = p > reach[row]
            row, p = row[keep], p[keep]


def word_runs(ids: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of an array of words, in order. longest: of its texts; numbers between
    texts occur once."""
    top = 4
    while top < longest:
        top *= 2
    pad, n = 2 * top, len(ids)
    size = pad + -(-max(1, n) // top) * top + pad
    padded = -1 - np.arange(size, dtype=np.int64) - n  # each once
    padded[pad : pad + n] = ids
    if n and ids.min() < -n:
        raise ValueError("numbers between texts start at -1 and go down to minus the array's length at most")
    found = [np.empty((0, 3), dtype=np.int64)]
    half = 4
    while half <= top:
        mids = np.arange(pad, pad + n + top, half)
        if half < top:
            mids = mids[(mids // half) % 2 == 1]
        for rows in _crossing(padded, mids, half, max(1, longest // EXPONENT)):
            s, e, p = rows.T
            ok = (e - s >= least) & (e - s >= EXPONENT * p) & (padded[s - 1] != padded[s - 1 + p]) & (padded[e] != padded[e - p])
            found.append(rows[ok])
        half *= 2
    made = np.concatenate(found)
    made = made[np.lexsort((made[:, 2], made[:, 1], made[:, 0]))]
    new = np.ones(len(made), dtype=bool)
    new[1:] = (made[1:, :2] != made[:-1, :2]).any(axis=1)
    return made[new] - np.array([pad, pad, 0])


class _Interned(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def find_runs(texts: list[str], least: int = LEAST) -> list[tuple[list[str], np.ndarray]]:
    """Of each text its words and its runs (start, end, period), in the order of start, then period."""
    interned = _Interned()
    words = [WORD.findall(t) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(int(sizes.sum()) + len(texts), dtype=np.int64)
    for k, (at, w) in enumerate(zip(starts.tolist(), words)):
        ids[at : at + len(w)] = np.fromiter(map(interned.__getitem__, w), dtype=np.int64, count=len(w))
        ids[at + len(w)] = -1 - k
    runs = word_runs(ids, int(sizes.max(initial=0)), least)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cut = np.searchsorted(runs[:, 0], np.append(starts, len(ids)))
    return [(w, runs[a:b] - np.array([s, s, 0])) for w, s, a, b in zip(words, starts.tolist(), cut[:-1].tolist(), cut[1:].tolist())]


def kept_words(words: list[str], runs: np.ndarray) -> list[str]:
    """Without the words that a run repeats: those after its first period."""
    if not len(runs):
        return words
    out, at = [], 0
    for first, end in sorted(zip((runs[:, 0] + runs[:, 2]).tolist(), runs[:, 1].tolist())):
        out += words[at:first]  # none if the run before goes on beyond
        at = max(at, end)
    return out + words[at:]


def periodic_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): runs in the order of start, then period; collapsed: the words that no run
    repeats, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1, SLICE):
            found = find_runs([t or "" for t in b.column(1).to_pylist()], least)
            runs = [[{"start": s, "length": e - s, "period": p} for s, e, p in r.tolist()] for _, r in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(w) for w, _ in found], pa.int64()), pa.array(runs, _RUNS),
                    pa.array([" ".join(kept_words(w, r)) for w, r in found], pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal doc_id and g = h div 10, a text of n words with h % 10 = 0 goes on
    from word g % n with period 1 + (n - g % n) div (3 + g % 8). Texts without an id stay as they are."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", JAVA_SPACE), lambda w: w != "")
    rows = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10).cast("long")))
    rows = rows.withColumn("_w", F.when(F.col("_g").isNotNull(), words)).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)) + 1)

    def word(i: Column) -> Column:
        return F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    # The greatest exact length / period; of equal ones the first: runs are in the order of start, then period.
    best = "reduce(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (x, y) -> if(y.length * x.period > x.length * y.period, y, x))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    found = found.select("doc_id", "runs", F.expr(f"if(size(runs) > 0, {best}, null)").alias("b"), F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.selectExpr(
        "doc_id", "cast(size(runs) as long) as n_runs", "b.start as start", "b.length as length", "b.period as period",
        "b.length * 1000 div b.period as exponent_milli", "runs_sha256", "collapsed_sha256",
    )
