"""Near copies by exact Jaccard: texts link if their sets of five-word shingles have a similarity of 0.8 or more.

At that similarity SimHash fingerprints differ in 13 bits and more, with no bound, so no radius finds every link.
Fingerprints propose the near links (radius 4, as operator 10); the rest come from prefix filtering, which misses none.

Of a set of n shingles, t = ceil(0.8 n) are in every set that it links with. With the shingles of all texts in one order,
two linked sets share l of the first n - t + l. l is a tenth of n, so a text that has less than a quarter in common with
all others, a passage say, is out at once, and one shuffle of three tenths of the shingles (hash and node) settles it.
The order puts shingles that are common in a sample of the texts last; whatever the sample, no link is lost.

1. One pass over the texts: fingerprint, hash of the shingle set, size and prefix. Equal sets are one node; a task gives
   the prefix of each of its sets once.
2. Shingles of one node alone are dropped, and nodes that are left with too few. The others' texts are read again for
   their whole sets, and the same is done with these: who shares fewer than t shingles is out, and of the rest each
   keeps its rarest, all but t - 1. What is left are the lists: nodes by shingle.
3. Links of the fingerprints, and of neighbours (by size) in a node's rarest few lists, are confirmed and contracted.
4. In each list the nodes outside its largest component meet all whose sizes allow 0.8 and that are not in their own
   component. A pair is given out only if three exact bounds leave it open: each has enough shingles after this one, in
   the lists' order, for it to be the first in common; and the parity signatures of the whole sets (a bit is the parity
   of the shingles that fall on it, so each shingle that only one of them has turns at most one bit) differ in no more
   bits than a ninth of both sizes. Lists of over LIST nodes are dealt into chunks, and pairs of chunks are tasks of
   their own. Components of all confirmed links follow. What 3 contracted costs no pairs here, however large.

Every pair is confirmed on the whole sets.

Shingles and sets are told apart by 64-bit hashes. Texts of fewer than five words are one shingle; texts without words,
nulls among them, are one node. Repeated rows are one; an empty table gives none; further columns of any name pass
through. A text's memory is that of its own shingles, eight bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Memo, byte_slices, join_split, materialize, plain_names
from .simhash import _LOWER, components, fingerprint, fingerprint_links

SHINGLE = 5
SAMPLE = 2_000  # documents that say which shingles are common
COMMON = 200_000  # at most so many common shingles are broadcast
FEW = 3  # lists of a node that propose neighbours
PART = 10  # the share of a set that its prefix must have in common, as a divisor
SEEN = 1_000_000  # sets that a task remembers
LIST = 2_048  # nodes of a list, or of a chunk of one
LEAST_BITS, MOST_BITS = 256, 2_048  # of a signature: twice the set, as a power of two, within these
AT_ONCE = 1 << 16  # pairs that a task looks at together
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Hashes(Memo):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 5)
        return h


def shingles(text: str, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = WORD.findall(text.translate(_LOWER))
    if not words:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out += h[k : k + n] * _SPREAD[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def signature(members: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: is it that of an odd number of them?"""
    bits = LEAST_BITS
    while bits < min(2 * len(members), MOST_BITS):
        bits *= 2
    odd = np.bincount((members & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Signatures:
    """Signatures of rows. Of two of different length the longer is folded: bits of equal residue are added up."""

    def __init__(self, values: np.ndarray):
        self.bits = np.array([8 * len(v) for v in values])
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in np.unique(self.bits).tolist():
            rows = np.flatnonzero(self.bits >= b)
            folded = np.zeros((len(rows), b // 64), dtype=np.uint64)
            for own in np.unique(self.bits[rows]).tolist():
                at = np.flatnonzero(self.bits[rows] == own)
                words = np.frombuffer(b"".join(values[rows[at]]), dtype="<u8").reshape(len(at), own // b, b // 64)
                folded[at] = np.bitwise_xor.reduce(words, axis=1)
            place = np.full(len(values), -1)
            place[rows] = np.arange(len(rows))
            self.of[b] = place, folded

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the rows i differ from the rows j: no more than their sets' members."""
        out = np.zeros(len(i), dtype=np.int64)
        least = np.minimum(self.bits[i], self.bits[j])
        for b, (place, words) in self.of.items():
            own = np.flatnonzero(least == b)
            if len(own):
                out[own] = np.bitwise_count(words[place[i[own]]] ^ words[place[j[own]]]).sum(axis=1, dtype=np.int64)
        return out


def _common(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """Shingles of several sampled documents, and how common they are (log2); sorted."""
    least = docs.where(f"{text} is not null").select(F.xxhash64(key, F.substring(text, 1, 200)).alias("_h"), F.col(text).cast("string").alias("_t"))
    total = least.count()
    if total > SAMPLE:
        # A share by hash, so no sort of the texts is needed.
        least = least.where(F.col("_h") < int(-(2**63) + 2**64 * SAMPLE / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes(1 << 18)
        for b in batches:
            found = [shingles(t, memo) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, dtype=np.int64)]))], ["s"])

    counts = least.select("_t").mapInArrow(run, "s long").groupBy("s").count().where("count > 2")
    rows = counts.orderBy(F.desc("count"), "s").limit(COMMON).selectExpr("s", "cast(log2(count) as int) as c").collect()
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 2)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shingle, node) in order each once, and only those of shingles with several nodes. One row is held."""
    s, node, matched = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), False
    for b in batches:
        if not b.num_rows:
            continue
        s, node = np.concatenate([s, b.column(0).to_numpy()]), np.concatenate([node, b.column(1).to_numpy()])
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (node[1:] != node[:-1])
        s, node = s[new], node[new]
        same = s[1:] == s[:-1]
        more = np.append(False, same) | np.append(same, False)
        more[0] |= matched
        out = more[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(s[:-1][out]), pa.array(node[:-1][out])], ["shingle", "node"])
        s, node, matched = s[-1:], node[-1:], bool(more[-1])
    if matched:
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(node)], ["shingle", "node"])


def _pairs(neighbours: bool):
    """Candidates (a, b) of lists, sorted by list, size and node. Neighbours in a list, or all that the contracted roots
    and the bounds leave open."""
    keys = ("shingle", "lo", "hi")
    names = (*keys, "side", "size", "node", "root", "n", "at")

    def pairs(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        n, node, root, side = rows["size"], rows["node"], rows["root"], rows["side"]
        new = np.ones(len(n), dtype=bool)
        new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in keys], axis=0)
        which = np.cumsum(new) - 1  # the list of each row
        found = [np.empty((0, 2), dtype=np.int64)]

        def propose(i: np.ndarray, j: np.ndarray) -> None:
            ok = (root[i] != root[j]) & ((side[i] < 0) | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            if not neighbours:
                common = (4 * (n[i] + n[j]) + 8) // 9  # so many shingles a linked pair shares
                ok = np.all([rows["at"][k] + common <= rows["n"][k] + 1 for k in (i, j)], axis=0)
                i, j = i[ok], j[ok]
                ok = 9 * signs.apart(i, j) <= n[i] + n[j]
                i, j = i[ok], j[ok]
            if len(i):
                found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
                if sum(map(len, found)) > 1 << 20:
                    found[:] = [np.unique(np.concatenate(found), axis=0)]

        if neighbours:
            i = np.flatnonzero((which[1:] == which[:-1]) & (5 * n[:-1] >= 4 * n[1:]))
            propose(i, i + 1)
        else:
            signs = Signatures(rows["sign"])
            # The most frequent root of each list.
            order = np.lexsort((root, which))
            start = np.flatnonzero(np.append(True, (which[order][1:] != which[order][:-1]) | (root[order][1:] != root[order][:-1])))
            times = np.diff(np.append(start, len(n)))
            best = np.lexsort((times, which[order][start]))
            main = np.zeros(which[-1] + 1, dtype=np.int64)
            main[which[order][start][best]] = root[order][start][best]
            out = np.flatnonzero(root != main[which])
            # Rows of a list whose sizes allow a link lie together.
            place = (which << 32) + n
            first = np.searchsorted(place, (which[out] << 32) + (4 * n[out] + 4) // 5)
            many = np.searchsorted(place, (which[out] << 32) + 5 * n[out] // 4, side="right") - first
            ends = np.cumsum(many)
            at = 0
            while at < len(out):
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
                own = many[at:stop]
                j = np.repeat(first[at:stop] - (ends[at:stop] - own - before), own) + np.arange(int(own.sum()))
                propose(np.repeat(out[at:stop], own), j)
                at = stop
        made = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # the list that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            rows = {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
            rows["sign"] = np.array([*b.column("sign").to_pylist(), None], dtype=object)[:-1]
            cut = b.num_rows - int(np.argmin(np.append(np.all([rows[c][::-1] == rows[c][-1] for c in keys], axis=0), False)))
            if held and (cut or any(held[-1][c][-1] != rows[c][0] for c in keys)):
                whole = [*held, {c: v[:cut] for c, v in rows.items()}]
                yield pairs({c: np.concatenate([p[c] for p in whole]) for c in rows})
                held = []
            elif cut:
                yield pairs({c: v[:cut] for c, v in rows.items()})
            held.append({c: v[cut:] for c, v in rows.items()})
        if held:
            yield pairs({c: np.concatenate([p[c] for p in held]) for c in held[0]})

    return run


def keep_one(documents: DataFrame) -> DataFrame:
    """Of each component of near copies the document with the smallest id (nulls last; then the smallest text hash),
    with all its columns. Of rows alike in id and text one stays."""
    spark = documents.sparkSession
    plain, key, text = plain_names(documents)
    number = F.col(key).cast("long")
    keys = {"no_id_": number.isNull(), "id_": F.coalesce(number, F.lit(0)), "text_hash_": F.xxhash64(text)}
    docs = plain.withColumns(keys)
    common = spark.sparkContext.broadcast(_common(plain, key, text))  # at most COMMON rows

    def digest(members: np.ndarray) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(members.tobytes(), 5) - (1 << 63)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, often, seen = _Hashes(1 << 18), common.value, set()
        for b in byte_slices(batches, 1):
            prints, nodes, sizes, firsts = [], [], [], []
            for t in b.column(1).to_pylist():
                members = shingles(t or "", memo)
                n, node = len(members), digest(members)
                prints.append(fingerprint(t or ""))
                nodes.append(node)
                sizes.append(n)
                if node in seen:  # its row in this task stands for it
                    firsts.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                if len(often) and n:
                    at = np.searchsorted(often[:, 0], members).clip(max=len(often) - 1)
                    weight = np.where(often[at, 0] == members, often[at, 1], 0)
                    members = members[np.argsort(weight, kind="stable")]
                firsts.append(members[: n + (-4 * n // 5) - (-n // PART)])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(2), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)),
                    pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "fp", "node", "size", "first"],
            )

    keyed = docs.select(number.alias("doc_id"), F.col(text).cast("string").alias("text"), "text_hash_")
    prints = keyed.mapInArrow(scan, "doc_id long, text_hash long, fp long, node long, size int, first array<long>")
    prints = materialize(prints, "prints")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    nodes = materialize(prints.groupBy("node").agg(smallest.alias("least"), F.max("size").alias("size")), "nodes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes(1 << 18)
        for b in byte_slices(batches, 0):
            sets = [shingles(t or "", memo) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(map(signature, sets), pa.binary())],
                ["node", "members", "sign"],
            )

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, members, sign) of the wanted nodes, from their texts."""
        found = nodes.join(wanted.select("node").distinct(), "node")
        found = materialize(found.selectExpr("least.no_id as no_id_", "coalesce(least.doc_id, 0) as id_", "least.text_hash as text_hash_"), "wanted")
        texts = docs.join(found, list(keys), "left_semi").select(F.col(text).cast("string").alias("text"))
        return materialize(texts.mapInArrow(read, "node long, members array<long>, sign binary").dropDuplicates(["node"]), "sets")

    def shared(rows: DataFrame) -> DataFrame:
        rows = rows.select("shingle", "node").repartition("shingle").sortWithinPartitions("shingle", "node")
        return materialize(rows.mapInArrow(_shared, "shingle long, node long"), "shared")

    def holding(rows: DataFrame, least: Column) -> DataFrame:
        """(node, size) of the nodes with so many of the rows."""
        counts = rows.groupBy("node").agg(F.count("*").alias("n")).join(nodes.select("node", "size"), "node")
        return materialize(counts.where(F.col("n") >= least).select("node", "size"), "held")

    whole = F.expr("cast(ceil(4 * size / 5) as int)")
    rows = shared(prints.select(F.explode("first").alias("shingle"), "node"))
    # Of the other set's size all that is known is that it has 0.8 of this one's: its prefix has a PART of that in common.
    sets = sets_of(holding(rows, F.expr(f"cast(ceil(ceil(4 * size / 5) / {PART}) as int)")))
    rows = shared(sets.select("node", F.explode("members").alias("shingle")))
    rows = materialize(rows.join(holding(rows, whole), "node"), "shared")
    often = materialize(rows.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1"), "times")
    rows = join_split(rows, often, "shingle", "times", rows.count())
    own = Window.partitionBy("node")
    rows = rows.withColumn("at", F.row_number().over(own.orderBy("times", "shingle"))).withColumn("n", F.count("*").over(own))
    lists = rows.where(F.col("at") <= F.col("n") - whole + 1).join(sets.select("node", "sign"), "node")
    lists = materialize(lists.select("shingle", "size", "node", "n", "at", "sign"), "lists")
    chunks = lists.groupBy("shingle").agg(F.count("*").alias("count")).where("count > 1")
    chunks = materialize(chunks.withColumn("chunks", F.ceil(F.col("count") / LIST).cast("int")), "chunks")

    total = lists.count()
    marks = materialize(prints.groupBy("fp").agg(F.min("node").alias("node")), "marks")
    near = fingerprint_links(marks.select("fp"))
    near = near.join(marks.selectExpr("fp as a", "node as na"), "a").join(marks.selectExpr("fp as b", "node as nb"), "b")
    near = materialize(near.selectExpr("least(na, nb) as a", "greatest(na, nb) as b"), "near")
    near_sets = sets_of(near.selectExpr("explode(array(a, b)) as node").join(sets.select("node"), "node", "left_anti"))

    def proposals(rows: DataFrame, neighbours: bool) -> DataFrame:
        rows = join_split(rows, chunks, "shingle", "count", total).withColumn("own", F.expr("cast(pmod(xxhash64(node), chunks) as int)"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).selectExpr(
            "shingle", "least(own, other) as lo", "greatest(own, other) as hi", "case when own = other then -1 when own < other then 0 else 1 end as side",
            "size", "node", "root", "n", "at", "null as sign" if neighbours else "sign",
        )
        group = ["shingle", "lo", "hi"]
        rows = rows.repartition(*group).sortWithinPartitions(*group, "size", "node")
        return rows.mapInArrow(_pairs(neighbours), "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more."""
        both = sets.unionByName(near_sets)
        left, right = both.selectExpr("node as a", "members as ma"), both.selectExpr("node as b", "members as mb")
        pairs = materialize(pairs.where("a <> b").distinct(), "proposed").join(left, "a").join(right, "b")
        return materialize(pairs.where("9 * size(array_intersect(ma, mb)) >= 4 * (size(ma) + size(mb))").select("a", "b"), "links")

    first = confirmed(proposals(lists.where(F.col("at") <= FEW).withColumn("root", F.col("node")), True).union(near))
    roots = components(first)
    rooted = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = confirmed(proposals(rooted, False))
    roots = components(first.union(rest)).withColumnRenamed("node", "_node")

    rooted = nodes.join(roots, F.col("node") == F.col("_node"), "left").selectExpr("least", "coalesce(root, node) as root")
    chosen = rooted.groupBy("root").agg(F.min("least").alias("k"))
    chosen = chosen.selectExpr("k.no_id as no_id_", "coalesce(k.doc_id, 0) as id_", "k.text_hash as text_hash_")
    # The window has the join's keys: the texts are shuffled once.
    kept = docs.join(chosen, list(keys), "left_semi")
    once = Window.partitionBy(*keys).orderBy(F.lit(0))
    return kept.withColumn("nth_", F.row_number().over(once)).where("nth_ = 1").select(*plain.columns).toDF(*documents.columns)
