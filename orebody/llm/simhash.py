"""SimHash near-duplicates (operator 10).

A document's fingerprint has a bit set where more than half of its word shingles' XXH64 hashes have it. Two
fingerprints link if they differ in at most `radius` bits. Equal fingerprints are one node, so copies cost one
row each however many they are.

Candidates: 64 bits are cut into 6 blocks; two fingerprints within 4 bits agree on at least two of them, so each is
filed under its 15 pairs of blocks (about 21 bits) and compared within its files: no link is missed. A file with
more than FILE fingerprints is dealt into chunks, and pairs of chunks are compared in tasks of their own.

Comparison is bit-sliced: a partition's fingerprints are stored as 64 vertical planes, 64 fingerprints to a word.
XOR of a plane with itself moved by s gives one bit of 64 distances at once; carry-save counters (ones, twos,
fours, more) add the planes up, and a block is abandoned once all its distances exceed the radius. From each
comparison only links that join two parts are passed on: a spanning forest, never all pairs of a group.

Components are found by star contraction: every node is hung on its smallest neighbour, in turn from above and from
below, until nothing moves. Each round is written to the shared folder; the driver sees a count and a checksum. A
fingerprint of very many documents, or the root of a giant component, is joined by broadcast (join_split): at most a
thousand such keys.

Null texts have no words: fingerprint zero, linked like any other. Null doc_ids get a row, but are never a
component's smallest id; a component of such rows alone has a null id. Repeated rows stay repeated. Empty tables
give no rows. Further columns of the input are not read; keep_one passes them on. A text of any length is hashed whole,
in some hundred bytes a word; a bit set in exactly half of the hashes is 0.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, byte_slices, discard, join_split, materialize, plain_names, table

SHINGLE = 4
RADIUS = 4
SEED = 42
CUTS = (0, 11, 22, 33, 44, 54, 64)
FILE = 1024
LANES = 1 << 16

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    words = WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    grams = map(" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=n)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 400:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp long)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            fp = np.array([fingerprint(t or "") for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def bit_planes(values: np.ndarray, spare: int) -> np.ndarray:
    """64 planes of words; lane p of plane b is bit b of values[p]. `spare` zero words follow."""
    n = len(values)
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, ((n + 63) // 64 + spare) * 64), dtype=np.uint8)
    padded[:, :n] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _lanes(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans (a multiple of 64 of them) as words."""
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def beyond(planes: np.ndarray, shifts: np.ndarray, words: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """For each shift s and lane p: does the value p+s differ from value p in more than `radius` bits (at most 7)?
    wanted: the lanes that matter; counting stops when all of them exceed."""
    q, r = (shifts // 64).astype(np.int64), (shifts % 64).astype(np.uint64)[:, None]
    low = q[:, None] + np.arange(words)
    up, whole = (np.uint64(64) - r) & np.uint64(63), r == 0
    ones, twos, fours, more = (np.zeros((len(shifts), words), dtype=np.uint64) for _ in range(4))
    bit = [np.uint64(-(radius >> k & 1) & 0xFFFFFFFFFFFFFFFF) for k in range(3)]

    def exceed() -> np.ndarray:
        # count > radius, from the high bit down
        over, equal = more.copy(), ~more
        for have, most in ((fours, bit[2]), (twos, bit[1]), (ones, bit[0])):
            over |= equal & have & ~most
            equal &= ~(have ^ most)
        return over

    for b in range(64):
        plane = planes[b]
        moved = plane[low] >> r
        moved |= np.where(whole, np.uint64(0), plane[low + 1] << up)
        x = moved ^ plane[:words]
        carry = ones & x
        ones ^= x
        x = twos & carry
        twos ^= carry
        carry = fours & x
        fours ^= x
        more |= carry
        if b % 8 == 7 and b < 63:
            over = exceed()
            if not (wanted & ~over).any():
                return over
    return exceed()


class Forest:
    """Labels of positions; only links that join two parts are kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.left: list[int] = []
        self.right: list[int] = []

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        new = label[i] != label[j]
        i, j = i[new], j[new]
        if not len(i):
            return
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for a, b, la, lb in zip(i.tolist(), j.tolist(), label[i].tolist(), label[j].tolist()):
            ra, rb = find(la), find(lb)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                self.left.append(a)
                self.right.append(b)
        old = np.array(sorted(parent))
        roots = np.array([find(x) for x in old.tolist()])
        at = np.searchsorted(old, label).clip(max=len(old) - 1)
        self.label = np.where(old[at] == label, roots[at], label)


def near_links(values: np.ndarray, stop: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) that span the links of values in groups. Groups are consecutive; stop[p] is the end of p's.
    side: -1 where all pairs of the group count, else 0 or 1 and only pairs of different sides count."""
    forest = Forest(len(values))
    keep, first, step = np.arange(len(values)), 1, 1
    while True:
        # Positions of groups in which some pair lies `first` or more apart.
        start_of = np.searchsorted(stop[keep], stop[keep], side="left")
        size = np.searchsorted(stop[keep], stop[keep], side="right") - start_of
        alive = size > first
        if not alive.any():
            break
        keep, end = keep[alive], stop[keep][alive]
        end_at = np.searchsorted(end, end, side="right")
        shifts = np.arange(first, first + step)
        for at in range(0, len(keep), LANES):
            n = min(LANES, len(keep) - at)
            reach = min(len(keep), at + n + int(shifts[-1]))
            own = keep[at:reach]
            planes = bit_planes(values[own], spare=2 + int(shifts[-1]) // 64)
            words = (n + 63) // 64
            lane = np.arange(words * 64)
            ends = np.zeros(words * 64, dtype=np.int64)
            ends[:n] = end_at[at : at + n] - at
            other = lane[None, :] + shifts[:, None]
            ok = other < ends[None, :]
            sides = np.full(other.max() + 1, -1, dtype=np.int8)
            sides[: len(own)] = side[own]
            ok &= (sides[lane][None, :] < 0) | (sides[lane][None, :] != sides[other])
            if not ok.any():
                continue
            wanted = _lanes(ok)
            hit = wanted & ~beyond(planes, shifts, words, wanted, radius)
            if hit.any():
                s, p = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little"))
                forest.link(own[p], own[p + shifts[s]])
        first += step
        step = min(64, step * 2)
    return np.array(forest.left, dtype=np.int64), np.array(forest.right, dtype=np.int64)


def _compare(radius: int):
    names = ("file", "key", "lo", "hi", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.empty(0, dtype=np.int64) for c in names}

        def links(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            group = np.stack([rows[c] for c in names[:4]])
            change = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            ends = np.append(change, len(rows["fp"]))
            stop = np.repeat(ends, np.diff(ends, prepend=0))
            i, j = near_links(rows["fp"].view(np.uint64), stop, rows["side"].astype(np.int8), radius)
            return pa.RecordBatch.from_arrays([pa.array(rows["fp"][i]), pa.array(rows["fp"][j])], ["a", "b"])

        for batch in batches:
            rows = {c: np.concatenate([held[c], batch.column(c).to_numpy().astype(np.int64)]) for c in names}
            if not len(rows["fp"]):
                continue
            last = np.ones(len(rows["fp"]), dtype=bool)  # rows of the group that may go on in the next batch
            for c in names[:4]:
                last &= rows[c] == rows[c][-1]
            cut = int(np.argmax(last))
            if cut:
                yield links({c: v[:cut] for c, v in rows.items()})
            held = {c: v[cut:] for c, v in rows.items()}
        if len(held["fp"]):
            yield links(held)

    return run


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes: a written table of distinct fp. (a, b): links that span the components of all links."""
    if radius > 4:
        raise ValueError("six blocks with two in common find links of at most 4 differing bits")
    block = [f"(shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1})" for a, b in zip(CUTS, CUTS[1:])]
    files = ", ".join(f"struct({n} as file, {block[i]} * 2048 + {block[j]} as key)" for n, (i, j) in enumerate(itertools.combinations(range(6), 2)))
    filed = nodes.selectExpr("fp", f"explode(array({files})) as f").selectExpr("f.file as file", "f.key as key", "fp")
    sizes = filed.groupBy("file", "key").count().where("count > 1")
    sizes = sizes.selectExpr("file as _file", "key as _key", f"cast(ceil(count / {FILE}) as int) as _chunks")
    rows = filed.join(sizes, (F.col("file") == F.col("_file")) & (F.col("key") == F.col("_key")))
    rows = rows.selectExpr("file", "key", "fp", "_chunks", "cast(pmod(xxhash64(fp), _chunks) as int) as own")
    rows = rows.selectExpr("file", "key", "fp", "own", "explode(sequence(0, _chunks - 1)) as other").selectExpr(
        "file", "key", "least(own, other) as lo", "greatest(own, other) as hi",
        "case when own = other then -1 when own < other then 0 else 1 end as side", "fp",
    )
    group = ["file", "key", "lo", "hi"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "fp")
    return rows.mapInArrow(_compare(radius), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) with the smallest node that it reaches, itself left out if it
    is the smallest. Star contraction; the driver sees a count and a checksum a round."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # u > v in every edge.
    edges = links.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct()
    edges = materialize(edges, "edges")
    now, before = state(edges), None
    while now != before:
        known = edges
        # From above: each node sends its smallest neighbour (or itself) to its larger neighbours.
        both = edges.selectExpr("u as x", "v as y", "0 as n").union(edges.selectExpr("v as x", "u as y", "1 as n"))
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.sum("n").alias("n")).where("n > 0").selectExpr("x as v", "least(x, m) as m", "n")
        large = join_split(edges, least, "v", "n", now[0]).selectExpr("u", "m as v").distinct()
        # From below: each node and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_split(large, least, "u", "n", now[0]).selectExpr("explode(array(struct(u as u, m as m), struct(v as u, m as m))) as e")
        edges = small.selectExpr("e.u as u", "e.m as v").where("u <> v").distinct()
        edges, old = materialize(edges, "edges"), known
        now, before = state(edges), now
        discard(old)
    return edges.selectExpr("u as node", "v as root")


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id)"""
    docs = materialize(fingerprints(documents), "fingerprints")
    nodes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    named = materialize(component_of(nodes, fingerprint_links(nodes.select("fp"), radius)), "components")
    return join_split(docs, named, "fp", "n", docs.count()).select("doc_id", "fp", "component_id")


def component_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (fp, least, n) with component_id: the smallest `least` of their component."""
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = materialize(nodes.join(roots, "fp", "left").selectExpr("fp", "least", "n", "coalesce(root, fp) as root"), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    return join_split(rooted, ids, "root", "size", rooted.count()).select("fp", "n", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")


def keep_one(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of each component the document with the smallest id (nulls last; then the smallest text hash), with all its
    columns. Of rows alike in id and text one stays."""
    plain, key, text = plain_names(documents)
    number = F.col(key).cast("long")
    keys = {"no_id_": number.isNull(), "id_": F.coalesce(number, F.lit(0)), "text_hash_": F.xxhash64(text)}
    docs = plain.withColumns(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            fp = np.array([fingerprint(t or "") for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    keyed = docs.select(number.alias("doc_id"), F.col(text).cast("string").alias("text"), "text_hash_")
    prints = materialize(keyed.mapInArrow(run, "doc_id long, text_hash long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    nodes = materialize(prints.groupBy("fp").agg(first.alias("least")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").selectExpr("least", "coalesce(root, fp) as root")
    chosen = rooted.groupBy("root").agg(F.min("least").alias("k"))
    chosen = chosen.selectExpr("k.no_id as no_id_", "coalesce(k.doc_id, 0) as id_", "k.text_hash as text_hash_")
    # The window has the join's keys: the texts are shuffled once.
    kept = docs.join(chosen, list(keys), "left_semi")
    once = Window.partitionBy(*keys).orderBy(F.lit(0))
    return kept.withColumn("nth_", F.row_number().over(once)).where("nth_ = 1").select(*plain.columns).toDF(*documents.columns)
