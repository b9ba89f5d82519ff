"""Single linkage by a shortest tree. Of all paths between two rows the tree's has the least longest step, so its edges in
order of length are the merges. A pair of blocks gives the tree of its own rows alone; all these edges together hold a
shortest tree of the table. Pairs of blocks whose boxes are farther apart than the longest step of a way already found are
left out. Edges are merged in rounds down to a number that one task may hold (that of a table of the last clusters).

Means come afterwards: rows are put in the order in which every cluster is one stretch. The merge that joins two rows is then
the latest of those between their places, and a pair of blocks gives a sum for each merge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ordering import running_totals
from .blocks import TASKS, THIN, block_table_pairs, distances, is_own, type_of, vectors, work_on
from .cells import placed


def spanning(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, length): the edges of a shortest tree of the rows of x, grown row by row."""
    rest, best, link = np.arange(1, len(x)), np.full(max(0, len(x) - 1), np.inf), np.zeros(max(0, len(x) - 1), dtype=int)
    lines, at, out = [c.copy() for c in x[1:].T], 0, []
    while len(rest):
        d = np.zeros(len(rest))
        for line, own in zip(lines, x[at]):
            d += np.square(line - own)
        np.sqrt(d, out=d)
        nearer = d < best
        np.copyto(best, d, where=nearer)
        link[nearer] = at
        k, end = int(best.argmin()), len(rest) - 1
        at = int(rest[k])
        out.append((int(link[k]), at, float(best[k])))
        for line in (rest, best, link, *lines):  # the last one takes the place
            line[k] = line[end]
        rest, best, link, lines = rest[:end], best[:end], link[:end], [line[:end] for line in lines]
    return tuple(np.array([e[f] for e in out], dtype=float if f == 2 else int) for f in range(3))


def _tree(points: DataFrame, dims: int, block: int) -> DataFrame:
    """(a, b, v): edges, a shortest tree of the points among them."""
    spark, kind = points.sparkSession, type_of(points, "cluster_")
    lines = points.select("cluster_", F.lit(1).cast("long").alias("n_"), *(F.col("vector")[k].alias(f"c{k}_") for k in range(dims)))
    dealt = placed(lines, dims, block, 1)[0]
    held = dealt.groupBy("cell_").count().withColumn("parts_", F.ceil(F.col("count") / (2 * block))).select("cell_", "parts_")
    name = F.struct("cell_", F.pmod(F.xxhash64("cluster_"), F.col("parts_")).alias("part_"))
    dealt = cut(dealt.join(held, "cell_").select("cluster_", F.array(*(f"c{k}_" for k in range(dims))).alias("vector"), name.alias("name_")))
    ends = [f(F.col("vector")[k]) for f in (F.min, F.max) for k in range(dims)]
    got = dealt.groupBy("name_").agg(*ends).orderBy("name_").collect()  # a row per block
    if not got:
        return spark.createDataFrame([], f"a {kind}, b {kind}, v double")
    numbers = spark.createDataFrame([(tuple(r[0]), n) for n, r in enumerate(got)], f"name_ {type_of(dealt, 'name_')}, block_ long")
    dealt = cut(dealt.join(F.broadcast(numbers), "name_").drop("name_"))
    lo, hi = (np.array([r[at : at + dims] for r in got], dtype=float).reshape(-1, dims) for at in (1, 1 + dims))

    def work(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        both = p if is_own(p, q) else pd.concat([p, q], ignore_index=True)
        i, j, v = spanning(vectors(both["vector"]))
        ids, left = both["cluster_"].to_numpy(), int(p["left_block_"].iloc[0])
        right = int(q["right_block_"].iloc[0])
        across = np.ones(len(v), dtype=bool) if left == right else (i < len(p)) != (j < len(p))
        i, j, v = i[across], j[across], v[across]
        return pd.DataFrame({"a": np.where(ids[i] < ids[j], ids[i], ids[j]), "b": np.where(ids[i] < ids[j], ids[j], ids[i]), "v": v, "left": left, "right": right})

    def worked(pairs: set[tuple[int, int]]) -> DataFrame:
        named = spark.createDataFrame(sorted(pairs), "left_block_ long, right_block_ long")
        return cut(work_on(dealt, dealt, cut(named), work, f"a {kind}, b {kind}, v double, left long, right long", min(TASKS, 2 * len(pairs))))

    i, j, _ = spanning((lo + hi) / 2)
    begun = worked({(n, n) for n in range(len(got))} | {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())})
    if len(got) == 1:
        return begun.select("a", "b", "v")
    # Within a block its longest edge leads anywhere, between two its shortest: `way` is the longest step from block to block.
    found = {(r["left"], r["right"]): (r["lo"], r["hi"]) for r in begun.groupBy("left", "right").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    way = np.zeros((len(got), len(got)))
    for n in range(len(got)):
        way[n, n] = found.get((n, n), (0.0, 0.0))[1]
    seen = [0]
    for a, b in zip(i.tolist(), j.tolist()):
        way[b, seen] = way[seen, b] = np.maximum(np.maximum(way[a, seen], found[min(a, b), max(a, b)][0]), way[b, b])
        seen.append(b)
    open_ = set()
    for n in range(len(got)):
        gap = np.sqrt((np.maximum(0, np.maximum(lo - hi[n], lo[n] - hi)) ** 2).sum(axis=1)) * (1 - 1e-9)
        open_.update((n, int(b)) for b in np.flatnonzero(gap <= way[n]) if b > n and (n, int(b)) not in found)
    return (begun.unionByName(worked(open_)) if open_ else begun).select("a", "b", "v")


def tree_merges(points: DataFrame, clusters: DataFrame, dims: int, last: int, block: int, contracted: Callable) -> DataFrame:
    """(left_id, right_id, height, size, left_size, mean, round_), mean null. The last edges, `last` squared at most, are merged
    in one task."""
    links, turn, out, kind = _tree(points, dims, block), 0, [], type_of(points, "cluster_")
    while links.count() > last * last:
        turn += 1
        merged, links, clusters = contracted(links, clusters, turn)
        out.append(merged)
    base = (turn + 1) << 32

    def run(got: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        parts, got = parts.sort_values("cluster_"), got.sort_values(["v", "a", "b"])
        ids, size, top = parts["cluster_"].to_numpy(), parts["size_"].tolist(), parts["top_"].tolist()
        up, done = list(range(len(ids))), []

        def root(n: int) -> int:
            while up[n] != n:
                up[n] = n = up[up[n]]
            return n

        for v, i, j in zip(got["v"].tolist(), np.searchsorted(ids, got["a"].to_numpy()).tolist(), np.searchsorted(ids, got["b"].to_numpy()).tolist()):
            i, j = sorted((root(i), root(j)))
            if i != j:
                up[j], left, size[i], top[i] = i, size[i], size[i] + size[j], max(v, top[i], top[j])
                done.append((i, j, top[i], size[i], left, None, base + len(done)))
        made = pd.DataFrame(done, columns=["left_id", "right_id", "height", "size", "left_size", "mean", "round_"])
        return made.assign(left_id=ids[made["left_id"].to_numpy(int)], right_id=ids[made["right_id"].to_numpy(int)], mean=made["mean"].astype(float))

    all_ = F.lit(0).alias("all_")
    both = links.select("*", all_).groupBy("all_").cogroup(clusters.select("*", all_).groupBy("all_"))
    made = both.applyInPandas(lambda got, parts: run(got, parts), f"left_id {kind}, right_id {kind}, height double, size long, left_size long, mean double, round_ long")
    for merged in out:
        made = made.unionByName(merged)
    return made


def with_means(points: DataFrame, steps: DataFrame, block: int, to_roots: Callable) -> DataFrame:
    """steps with the mean distances of what they merge. A row lies behind the left clusters of the merges on its way up; the
    merge at which its own name ends is the one that joins it to the row before it."""
    ends = steps.select(F.col("right_id").alias("cluster_"), F.col("left_id").alias("up_"), F.col("left_size").alias("off_"), F.col("step").alias("gap_"))
    own = cut(points.join(ends, "cluster_", "left"))
    up = own.select("cluster_", F.lit(0).alias("by_"), F.coalesce("up_", "cluster_").alias("up_"), F.coalesce("off_", F.lit(0)).alias("off_"))
    off = to_roots(cut(up), "cluster_", "by_").select("cluster_", "off_")
    line = own.select("cluster_", "w_", "vector", F.coalesce("gap_", F.lit(0)).alias("gap_")).join(off, "cluster_").withColumn("one_", F.lit(1))
    line = running_totals(line, ["off_"], "one_", "rank_").select("w_", "vector", "gap_", "rank_", F.floor(F.col("rank_") / block).alias("block_"))
    line = cut(line)
    most = np.array([r["m"] for r in line.groupBy("block_").agg(F.max("gap_").alias("m")).orderBy("block_").collect()], dtype=np.int64)

    def work(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        own, (left, right) = is_own(p, q), (int(p["left_block_"].iloc[0]), int(q["right_block_"].iloc[0]))
        p, q = (d.sort_values("rank_") for d in (p, q))
        wp, wq, g, h = p["w_"].to_numpy(float), q["w_"].to_numpy(float), p["gap_"].to_numpy(), q["gap_"].to_numpy()
        n, x, y = len(p), vectors(p["vector"]), vectors(q["vector"])
        if own:
            names, totals = [], []
            for part, d in distances(x, y):
                later = np.arange(n) > np.arange(part.start, part.stop)[:, None]
                names.append(np.maximum.accumulate(np.where(later, h, -1), axis=1)[later])
                totals.append((d * wq * wp[part, None])[later])
        else:
            # u joins a row to the first `till` of q, from behind it in p or from between the blocks; rows with one u go together.
            v = np.maximum.accumulate(h)
            u = np.maximum(np.r_[np.maximum.accumulate(g[:0:-1])[::-1], -1], most[left + 1 : right].max(initial=-1))
            till, own_, other = np.searchsorted(v, u), np.zeros(n), np.zeros(len(q))
            for part, d in distances(x, y, strip=THIN):
                turns = np.flatnonzero(np.r_[True, np.diff(u[part]) != 0])
                for a, b in zip(turns, np.r_[turns[1:], len(d)]):
                    at = part.start + a
                    sums = (wp[at : part.start + b] @ d[a:b]) * wq
                    own_[at] = sums[: till[at]].sum()
                    other[till[at] :] += sums[till[at] :]
            names, totals = [u, v], [own_, other]
        names, code = np.unique(np.concatenate(names), return_inverse=True)
        totals = np.bincount(code, np.concatenate(totals), len(names))
        return pd.DataFrame({"step": names[totals > 0], "total": totals[totals > 0]})

    if not len(most):
        return steps
    sums = block_table_pairs(line, len(most), work, "step long, total double", min(TASKS, len(most) * (len(most) + 1) // 2))
    sums = sums.groupBy("step").agg(F.sum("total").alias("total_"))
    mean = F.coalesce(F.col("total_") / (F.col("left_size") * (F.col("size") - F.col("left_size"))), F.lit(0.0))
    return steps.join(sums, "step", "left").withColumn("mean", mean).drop("total_")
