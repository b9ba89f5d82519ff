"""Best-fit packing of tokenised documents into sequences (operator 9).

1. One pass over the texts encodes them, cuts documents of more than `capacity` tokens into pieces and numbers the
   pieces of each length within their partition. Only (doc_id, piece, start, length, checksum) is kept.
2. The length histogram has at most `capacity` entries whatever the corpus. On it the driver solves the
   configuration linear program (a variable for each multiset of lengths that fits a sequence; each length covered
   as often as it occurs) by multiplicative weights: a length's dual price falls exponentially with its coverage,
   and the pricing problem, the multiset of largest price, is a bounded knapsack solved by dynamic programming.
   Each round prices a random partition of the lengths not yet covered, block by block, so that one round raises
   many variables; a step covers a configuration's scarcest length. Rounds go on until every length is covered.
3. Rounding: configurations that waste nothing (or little) are used floor(share x) times, and what is left goes in
   decreasing length into the fullest sequence that has room; of a few shares the one with the fewest sequences is
   taken. The plan is a table of runs: pieces number a to b of a length go to consecutive sequences. It grows with the
   number of lengths, not of documents.
4. A piece finds its number among all pieces of its length (its number within the partition plus a base) and from
   the run its sequence and offset. No group of equal lengths ever meets in one task.

Null texts count as empty: such a document is its end id alone. Rows with equal or null doc_ids are packed each
for itself. Empty tables give no rows. Further columns of the input are not read.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import END_ID, vocabulary, word_encoder

CAPACITY = 4096
TILT = 0.25  # prices rise a little faster than sizes, so large pieces go first and small ones are left to fill
BLOCK = 160  # lengths priced together
#: Roundings tried: (free tokens that a configuration may leave, share of its LP value that is used).
ROUNDINGS = ((0, 1.0), (0, 0.9), (0, 0.8), (0, 0.5), (1, 0.98), (8, 0.8), (8, 1.0), (-1, 0.0))
RATE = 1.0  # how fast prices fall with coverage

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seen = TaskContext.get().partitionId(), word_encoder(tokenizer), [0] * (capacity + 1)
        for b in batches:
            rows: list[tuple] = []
            for key, ids in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((key, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows) if rows else ((),) * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in _PIECES.split(", ")]
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, _PIECES)


def best_configuration(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Bounded knapsack: the multiset of lengths (index -> times) of largest total price within capacity.
    Multiplicities are split into powers of two, so each step is a choice to take or leave."""
    items = []
    for i, n in enumerate(np.minimum(most, capacity // lengths).tolist()):
        k = 1
        while n > 0:
            items.append((i, min(k, n)))
            n -= k
            k *= 2
    best, taken = np.zeros(capacity + 1), []
    for i, k in items:
        size = int(lengths[i]) * k
        other = best[: capacity + 1 - size] + prices[i] * k
        better = other > best[size:]
        taken.append(better)
        np.copyto(best[size:], other, where=better)
    at, chosen = capacity, {}
    for (i, k), better in zip(reversed(items), reversed(taken)):
        size = int(lengths[i]) * k
        if at >= size and better[at - size]:
            chosen[i] = chosen.get(i, 0) + k
            at -= size
    return chosen


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 7):
    """Multiplicative weights on the configuration LP: {configuration as ((index, times), ...): x}. It ends when each
    length is covered. Each configuration covers one length wholly, so there are no more of them than lengths."""
    rng = np.random.default_rng(seed)
    rest, x = counts.astype(float), {}
    while len(live := np.flatnonzero(rest > 0)):
        # Where every sequence is full, a length's optimal price is its size; coverage bends that.
        prices = lengths * (1 + TILT * lengths / capacity) * np.exp(-RATE * (1 - rest / counts)) * (1 + 1e-3 * rng.random(len(lengths)))
        order = rng.permutation(live)
        for at in range(0, len(order), BLOCK):
            block = order[at : at + BLOCK]
            chosen = best_configuration(lengths[block], prices[block], np.ceil(rest[block]).astype(np.int64), capacity)
            config = tuple(sorted((int(block[i]), k) for i, k in chosen.items()))
            index = np.array([i for i, _ in config])
            times = np.array([k for _, k in config])
            step = float((rest[index] / times).min())
            x[config] = x.get(config, 0.0) + step
            rest[index] -= step * times
            rest[rest < 1e-9] = 0
    return x


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first number, pieces, first sequence, pieces per sequence, offset), sorted, and the number of
    sequences. histogram: length -> how many pieces have it. Of the roundings of the LP's solution the first of those
    with the fewest sequences is taken. They keep back a share of every length for best fit, which needs small pieces
    to fill up with. The last one rounds every configuration down to nothing and leaves all to best fit, so the plan
    never has more sequences than best fit decreasing."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), dtype=np.int64)
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    x = sorted(solve_configurations(lengths, counts, capacity).items(), key=lambda kv: (-kv[1], kv[0]))
    full, least = histogram.get(capacity, 0), -(-int(lengths @ counts) // capacity)
    best = None
    for waste, share in ROUNDINGS:
        runs, bins = _rounded(lengths, counts, x, capacity, waste, share, full)
        if best is None or bins < best[1]:
            best = runs, bins
        if bins - full <= least:
            break  # as many as the tokens fill
    return best


def _rounded(lengths: np.ndarray, counts: np.ndarray, x: list, capacity: int, waste: int, share: float, full: int) -> tuple[np.ndarray, int]:
    """Configurations that leave at most `waste` free, a share of x times rounded down; best fit for the rest."""
    runs, used, bins = [], dict.fromkeys([*lengths.tolist(), capacity], 0), 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, how many)

    def put(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], pieces, first, each, offset))
        used[length] += pieces

    if full:
        put(capacity, full, 0, 1, 0)
        bins = full
    rest = counts.copy()
    for config, times in x:
        n = min(int(times * share + 1e-9), *(int(rest[i]) // k for i, k in config))
        free = capacity - sum(int(lengths[i]) * k for i, k in config)
        if n < 1 or free > waste:
            continue  # best fit does better with these pieces
        offset = 0
        for i, k in config:
            put(int(lengths[i]), n * k, bins, k, offset)
            offset += int(lengths[i]) * k
            rest[i] -= n * k
        if free:
            rooms.setdefault(free, []).append((bins, n))
        bins += n

    free = sorted(rooms)

    def add_room(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(free, room)
            rooms[room].append((first, n))

    for length, n in zip(reversed(lengths.tolist()), reversed(rest.tolist())):
        while n:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                room, first, have = capacity, bins, math.ceil(n / (capacity // length))
                bins += have
            else:
                room = free[at]
                first, have = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], free[at]
            each = room // length
            full = min(have, n // each)
            if full:
                put(length, full * each, first, each, capacity - room)
                add_room(room - each * length, first, full)
                n -= full * each
            if full < have and n:  # fewer than `each` are left: one more sequence takes them
                put(length, n, first + full, n, capacity - room)
                add_room(room - n * length, first + full, 1)
                n, full = 0, full + 1
            add_room(room, first + full, have - full)
    runs.sort()
    return np.array(runs, dtype=np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces: a written table of token_pieces (it is read more than once)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy(F.col("length").alias("_length"), F.col("part").alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # At most `capacity` rows reach the driver.
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).collect()}
    plan, _ = packing_plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)  # bounded by the number of lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, each, offset = shared.value.T
        keys = (length << 44) + first
        for b in batches:
            own, nth = b.column("length").to_numpy().astype(np.int64), b.column("nth").to_numpy()
            run = np.searchsorted(keys, (own << 44) + nth, side="right") - 1
            k = nth - first[run]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in ("doc_id", "piece", "start")),
                    pa.array(own),
                    b.column("ids_crc32"),
                    pa.array(sequence[run] + k // each[run]),
                    pa.array(offset[run] + k % each[run] * own),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    at = pieces.join(bases, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
    return at.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("_base")).alias("nth")
    ).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(token_pieces(documents, tokenizer, capacity), "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
