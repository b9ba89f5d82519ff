"""Approximate nearest neighbours by a navigable small-world graph per shard (operator 11).

Nearness is the largest inner product. A shard's vectors get one component more, sqrt(m^2 - |x|^2) with m the shard's
largest norm, and a query a zero: then the nearest by distance is the largest by inner product, whatever the norms.

Rows are dealt into shards of at most about `shard_rows` by a hash of vec_id. A task builds the graph of a shard: equal
vectors are one node (so copies do not crowd each other's neighbours); every node has a top layer drawn with falling
odds; a layer's graph is a flat array of neighbours, so many per node, filled up with -1. Nodes are inserted in batches:
a batch searches the graph so far from the top layer down, and the nodes found, with the batch's own, are the
candidates. Of these the nearest are linked that are nearer to the node than to any neighbour taken before (then the
nearest of the rest), and back, where a full list is chosen anew in the same way. The index is a table of these flat
arrays, cut into slices of nodes, in the shared folder.

Searching meets every block of queries with every shard: all queries of a block move through the layers together, the
best `ef` kept of each. The score is the inner product in double precision on the vectors as they are; a node stands for all its
ids, smallest first, the query's own left out. A query's rows of all shards are merged by score, then id.

The graph of a shard is a sample of nothing: all rows are indexed. Recall against brute force is measured in the tests.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Of rows
alike in vec_id the smallest vector counts. A table of one row or none gives no rows; vectors should have one length,
and a shard that holds others fails. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

LINKS = 16  # neighbours of a node in upper layers; twice as many in the lowest
EF_BUILD, EF_SEARCH = 80, 96
SHARD_ROWS = 16_384
BATCH = 256
BLOCK = 1_024  # queries of a block
SLICE = 1_024  # nodes of a slice of the stored index
WIDE = 4  # nodes that a step of a search opens


@dataclass
class Graph:
    """points: vectors of length one, with the component that makes them so; half a squared distance is 1 - the product.
    layers[l]: rows of neighbours, all nodes'."""

    points: np.ndarray
    layers: list[np.ndarray]
    entry: int

    def search(self, q: np.ndarray, ef: int, layer: int = 0, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """From the entry (of each query) the nearest ef nodes found on a layer, nearest first, -1 where fewer."""
        n, links = len(self.points), self.layers[layer]
        count = len(q)
        rows = np.arange(count)
        start = np.full(count, self.entry) if entry is None else entry
        ids = np.full((count, ef), -1, dtype=np.int64)
        far = np.full((count, ef), np.inf, dtype=np.float32)
        opened = np.zeros((count, ef), dtype=bool)
        ids[:, 0], far[:, 0] = start, self._distance(q, start[:, None])[:, 0]
        seen = np.zeros((count, n), dtype=bool)
        seen[rows, start] = True
        active, wide = rows, min(WIDE, ef)
        while len(active):
            open_ = np.where(opened[active], np.inf, far[active])
            k = np.argpartition(open_, wide - 1, axis=1)[:, :wide] if wide < ef else np.tile(np.arange(ef), (len(active), 1))
            found = np.take_along_axis(open_, k, axis=1) < np.inf
            alive = found.any(axis=1)
            active, k, found = active[alive], k[alive], found[alive]
            if not len(active):
                break
            opened[active[:, None], k] |= found
            near = np.where(found[:, :, None], links[ids[active[:, None], k]], -1).reshape(len(active), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[active[:, None], near]
            row, col = np.nonzero(new)
            if not len(row):
                continue
            seen[active[row], near[row, col]] = True
            # Packed to the left: most of what is near has been seen.
            many = new.sum(axis=1)
            width = int(many.max())
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            cand = np.full((len(active), width), -1, dtype=np.int64)
            cand[row, at] = near[row, col]
            dist = np.where(cand >= 0, self._distance(q[active], cand), np.float32(np.inf))
            all_far = np.concatenate([far[active], dist], axis=1)
            pick = np.argpartition(all_far, ef - 1, axis=1)[:, :ef]
            far[active] = np.take_along_axis(all_far, pick, axis=1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], cand], axis=1), pick, axis=1)
            opened[active] = np.take_along_axis(np.concatenate([opened[active], cand < 0], axis=1), pick, axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return 1 - (self.points[ids] @ q[:, :, None])[:, :, 0]

    def descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """The nearest node that a walk from the top finds, on the layer above down_to."""
        at = np.full(len(q), self.entry)
        for layer in range(len(self.layers) - 1, down_to, -1):
            at = self.search(q, 1, layer, at)[0][:, 0]
        return at


def chosen(points: np.ndarray, own: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates (-1: none) at most `most`: from the nearest on, those nearer to their own node than to any
    taken before; then the nearest of the others. Filled up with -1."""
    vectors = points[cand]
    far = 1 - (vectors @ points[own][:, :, None])[:, :, 0]
    far[(cand < 0) | (cand == own[:, None])] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    cand, far = np.take_along_axis(cand, order, axis=1), np.take_along_axis(far, order, axis=1)
    cand = np.where(np.isfinite(far), cand, -1)
    vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
    between = 1 - vectors @ vectors.transpose(0, 2, 1)
    n, width = cand.shape
    shut, taken, count = cand < 0, np.zeros((n, width), dtype=bool), np.zeros(n, dtype=np.int64)
    for k in range(width):
        take = ~shut[:, k] & (count < most)
        if take.any():
            taken[:, k] = take
            count += take
            shut |= take[:, None] & (between[:, k] <= far)
    first = np.argsort(np.where(taken, 0, np.where(cand >= 0, 1, 2)) * width + np.arange(width), axis=1)[:, :most]
    out = np.take_along_axis(cand, first, axis=1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(points: np.ndarray, links: np.ndarray, nodes: np.ndarray) -> None:
    """Of the links of these nodes also the other direction."""
    to = links[nodes].ravel()
    back = np.repeat(nodes, links.shape[1])[to >= 0]
    to = to[to >= 0]
    most = links.shape[1]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    while len(to):
        start = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        nth = np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to))))
        now = nth < most  # so many at once: a node that very many link to takes several rounds
        own = to[start]
        new = np.full((len(own), min(most, int(nth.max()) + 1)), -1, dtype=np.int64)
        new[np.searchsorted(own, to[now]), nth[now]] = back[now]
        known = links[own]
        new[(new[:, :, None] == known[:, None, :]).any(axis=2)] = -1
        free, want = (known < 0).sum(axis=1), (new >= 0).sum(axis=1)
        both = np.concatenate([known, new], axis=1)
        fits = want <= free
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
        links[own[fits]] = packed[fits][:, :most]
        for at in range(0, int((~fits).sum()), 1024):
            own_, both_ = own[~fits][at : at + 1024], both[~fits][at : at + 1024]
            links[own_] = chosen(points, own_, both_, most)
        to, back = to[~now], back[~now]


def build(vectors: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 11) -> Graph:
    """The graph of distinct vectors (rows)."""
    n = len(vectors)
    norm2 = (vectors.astype(np.float64) ** 2).sum(axis=1)
    scale = max(np.sqrt(norm2.max()), 1e-300)
    lift = np.sqrt(np.maximum(0, 1 - norm2 / scale / scale))
    points = np.column_stack([vectors / scale, lift]).astype(np.float32)
    rng = np.random.default_rng(seed)
    top = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int64), 8)
    # A node of the top layer first; batches grow with the graph.
    order = np.concatenate([[top.argmax()], np.delete(np.arange(n), top.argmax())])
    graph = Graph(points, [np.full((n, links * (1 if layer else 2)), -1, dtype=np.int32) for layer in range(int(top.max()) + 1)], int(order[0]))
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        entry = np.full(len(batch), graph.entry)
        for layer in range(len(graph.layers) - 1, -1, -1):
            here = top[batch] >= layer
            if (~here).any():
                entry[~here] = graph.search(points[batch[~here]], 1, layer, entry[~here])[0][:, 0]
            if here.any():
                own = batch[here]
                found, _ = graph.search(points[own], ef, layer, entry[here])
                entry[here] = found[:, 0]
                # Nodes of the batch cannot find each other in the graph yet: the nearest of them are candidates too.
                gap = 1 - points[own] @ points[own].T
                np.fill_diagonal(gap, np.inf)
                mates = own[np.argsort(gap, axis=1, kind="stable")[:, : min(links, len(own) - 1)]]
                graph.layers[layer][own] = chosen(points, own, np.concatenate([found, mates], axis=1), graph.layers[layer].shape[1])
                _link_back(points, graph.layers[layer], own)
    return graph


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, one for each id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = "vec_id is not null and v is not null and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity')) and exists(v, c -> c <> 0)"
    return rows.where(finite).groupBy("vec_id").agg(F.min("v").alias("v"))


_INDEX = "shard int, slice int, nodes int, dims int, entry int, ids array<long>, id_nodes array<int>, vectors array<double>, layers array<array<int>>"


def _build_shard(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The slices of a shard's index. layers: neighbours of the slice's nodes, flat, for each layer."""
    rows = rows.sort_by("vec_id")
    flat = rows.column("v").combine_chunks()
    dims = len(flat[0])
    if not (np.diff(flat.offsets.to_numpy()) == dims).all():
        raise ValueError("vectors should have one length")
    values, ids = flat.flatten().to_numpy().reshape(-1, dims), rows.column("vec_id").to_numpy()
    values = values + 0.0  # minus zero is zero
    distinct, first, node = np.unique(values, axis=0, return_index=True, return_inverse=True)
    node = node.ravel()
    order = np.argsort(node, kind="stable")  # ids of a node rise
    graph = build(distinct)
    starts = np.searchsorted(node[order], np.arange(0, len(distinct) + SLICE, SLICE))
    for k in range(0, -(-len(distinct) // SLICE)):
        span, own = slice(k * SLICE, (k + 1) * SLICE), order[starts[k] : starts[k + 1]]
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "shard": key[0].as_py(), "slice": k, "nodes": len(distinct), "dims": dims, "entry": graph.entry, "ids": ids[own],
                    "id_nodes": node[own].astype(np.int32), "vectors": distinct[span].ravel(), "layers": [layer[span].ravel() for layer in graph.layers],
                }
            ],
            pa.schema([("shard", pa.int32()), ("slice", pa.int32()), ("nodes", pa.int32()), ("dims", pa.int32()), ("entry", pa.int32()), ("ids", pa.list_(pa.int64())), ("id_nodes", pa.list_(pa.int32())), ("vectors", pa.list_(pa.float64())), ("layers", pa.list_(pa.list_(pa.int32())))]),
        )


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The written index of all rows, and how many shards it has."""
    rows = materialize(_rows(vectors), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def shard(key: tuple, group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_build_shard(key, group))

    index = materialize(dealt.groupBy("shard").applyInArrow(shard, _INDEX), "index")
    index.rows_, index.shards_ = rows, shards
    return index


def _search_group(k: int, ef: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        queries = rows.filter(pa.compute.is_valid(rows.column("query_id")))
        parts = rows.filter(pa.compute.is_valid(rows.column("slice"))).sort_by("slice")
        if not parts.num_rows or not queries.num_rows:
            return schema.empty_table()
        dims = parts.column("dims")[0].as_py()

        def flat(name: str) -> np.ndarray:
            return parts.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

        vectors, ids, owner = flat("vectors").reshape(-1, dims), flat("ids"), flat("id_nodes")
        layers: list[list[np.ndarray]] = [[np.array(x, dtype=np.int32) for x in part] for part in parts.column("layers").to_pylist()]
        links = [np.concatenate([p[n] for p in layers]).reshape(len(vectors), -1) for n in range(len(layers[0]))]
        norm2 = (vectors**2).sum(axis=1)
        scale = max(np.sqrt(norm2.max()), 1e-300)
        points = np.column_stack([vectors / scale, np.sqrt(np.maximum(0, 1 - norm2 / scale / scale))]).astype(np.float32)
        graph = Graph(points, links, parts.column("entry")[0].as_py())
        first = np.searchsorted(owner, np.arange(len(vectors) + 1))
        names, wanted = queries.column("query_id").to_numpy(), queries.column("q").combine_chunks()
        if not (np.diff(wanted.offsets.to_numpy()) == dims).all():
            raise ValueError("vectors should have one length")
        q = wanted.flatten().to_numpy().reshape(-1, dims)
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), BATCH):
            own = q[at : at + BATCH]
            length = np.sqrt((own**2).sum(axis=1, keepdims=True))
            lifted = np.column_stack([own / length, np.zeros(len(own))]).astype(np.float32)
            found, _ = graph.search(lifted, ef, 0, graph.descend(lifted, 0))
            for name, x, nodes in zip(names[at : at + BATCH].tolist(), own, found):
                nodes = nodes[nodes >= 0]
                score = vectors[nodes] @ x
                # The best k ids: nodes' smallest k + 1 each, as one may be the query's own.
                held = [ids[first[n] : first[n + 1]][: k + 1] for n in nodes.tolist()]
                far, near = np.repeat(score, [len(h) for h in held]), np.concatenate([np.empty(0, np.int64), *held])
                other = near != name
                far, near = far[other], near[other]
                best = np.lexsort((near, -far))[:k]
                made.append((np.full(len(best), name), near[best], far[best]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*made)], schema=schema)

    return run


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """queries (query_id, q). Of each its k nearest rows found: query_id, rank, vec_id, score."""
    many = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(index.shards_ - 1))).alias("shard"), block.alias("block"), "query_id", "q")
    parts = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    # A group is one shard's index and one block of queries, whatever the table's size.
    both = parts.unionByName(asked, allowMissingColumns=True)
    found = both.groupBy("shard", "block").applyInArrow(_search_group(k, ef), "query_id long, vec_id long, score double")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "embeddings"))
    queries = index.rows_.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "v as q")
    return search(index, queries, 20)
