"""Cells of space for clusters, and the merging that a cell can do by itself. Centres are dealt into boxes by halving at
medians of a sample; the sample decides only how evenly. With complete, average and Ward's linkage two clusters are no nearer
than their centres allow, and merging brings no cluster nearer to a third. So a cluster whose centre is farther from its
box's walls than from a cluster inside has its nearest one inside, whatever the other cells do in the meantime: each cell
merges, over and over, all pairs that are each other's nearest within that bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .blocks import TASKS, THIN, distances, type_of, vectors

SAMPLED = 32  # centres for each cell


@dataclass
class Boxes:
    """A tree of halvings along turned axes, and the boxes of its leaves, the cells."""

    axes: np.ndarray
    along: np.ndarray
    at: np.ndarray
    below: np.ndarray
    above: np.ndarray
    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        x, node = x @ self.axes, np.zeros(len(x), dtype=int)
        while (self.cell[node] < 0).any():
            inner = np.flatnonzero(self.cell[node] < 0)
            n = node[inner]
            node[inner] = np.where(x[inner, self.along[n]] >= self.at[n], self.above[n], self.below[n])
        return self.cell[node]

    def walls(self, x: np.ndarray, cell: int) -> np.ndarray:
        """The distances of points in a cell to its nearest wall."""
        x = x @ self.axes
        return np.minimum(x - self.lo[cell], self.hi[cell] - x).min(axis=1)


def boxes(x: np.ndarray, weight: np.ndarray, cells: int, turn: int) -> Boxes:
    """About `cells` boxes that hold about the same weight of x each. From the second turn on axes are turned, so that walls
    lie elsewhere."""
    dims = x.shape[1]
    axes = np.linalg.qr(np.random.default_rng(turn).normal(size=(dims, dims)))[0] if turn > 1 and dims > 1 else np.eye(dims)
    x = x @ axes
    nodes, leaves = [], []
    todo = [(np.arange(len(x)), np.full(dims, -np.inf), np.full(dims, np.inf), cells, None)]
    while todo:
        own, lo, hi, n, link = todo.pop()
        if link:
            nodes[link[0]][link[1]] = len(nodes)
        k = int(np.ptp(x[own], axis=0).argmax()) if len(own) else 0
        line = own[np.argsort(x[own, k], kind="stable")]
        steps = np.flatnonzero(np.diff(x[line, k]) > 0)
        if n < 2 or not len(steps):
            nodes.append([0, 0.0, 0, 0, len(leaves)])
            leaves.append((lo, hi))
            continue
        sums = np.cumsum(weight[line])
        step = steps[np.abs(sums[steps] - sums[-1] * (n // 2) / n).argmin()]
        cut_ = (x[line[step], k] + x[line[step + 1], k]) / 2
        up, down = hi.copy(), lo.copy()
        up[k] = down[k] = cut_
        nodes.append([k, cut_, 0, 0, -1])
        here = len(nodes) - 1
        todo.append((line[step + 1 :], down, hi, n - n // 2, (here, 3)))
        todo.append((line[: step + 1], lo, up, n // 2, (here, 2)))
    along, at, below, above, cell = (np.array([n[f] for n in nodes]) for f in range(5))
    return Boxes(axes, along.astype(int), at, below.astype(int), above.astype(int), cell.astype(int), *(np.array([e[s] for e in leaves]) for s in range(2)))


def placed(centres: DataFrame, dims: int, block: int, turn: int) -> tuple[DataFrame, Boxes]:
    """(centres with cell_, the boxes): cells of about `block` of the n_ rows of clusters with centres c0_, c1_, ... The driver
    gets SAMPLED centres for each."""
    cells = max(1, -(-int(centres.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]) // block))
    at = [f"c{k}_" for k in range(dims)]
    few = centres.orderBy(F.xxhash64("cluster_", F.lit(turn)), "cluster_").limit(SAMPLED * cells if cells > 1 else 1)
    got = np.array([tuple(r) for r in few.select("n_", *at).collect()], dtype=float).reshape(-1, dims + 1)
    made = boxes(got[:, 1:], got[:, 0], cells, turn)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in centres.schema.fields)

    def place(batches):
        for rows in batches:
            yield rows.assign(cell_=made.place(rows[at].to_numpy(float)))

    return cut(centres.mapInPandas(place, f"{fields}, cell_ long")), made


def between(x: np.ndarray, wx: np.ndarray, fx: np.ndarray, y: np.ndarray, wy: np.ndarray, fy: np.ndarray, linkage: str) -> tuple[np.ndarray, np.ndarray]:
    """(v, total) for the clusters of x and of y: their distance (of average linkage the total) and the sum of their rows'
    distances by weight. Rows lie cluster by cluster; fx and fy are the places of the first ones."""
    extreme = {"complete": np.maximum, "single": np.minimum, "ward": np.minimum}.get(linkage)
    best = np.full((len(fx), len(fy)), -np.inf if linkage == "complete" else np.inf) if extreme else None
    total = np.zeros((len(fx), len(fy)))
    code = np.repeat(np.arange(len(fx)), np.diff(np.r_[fx, len(x)]))
    plain = (wx == 1).all() and (wy == 1).all()

    def folded(f, d, first):
        d = f.reduceat(d, first, axis=0) if len(first) < len(d) else d
        return f.reduceat(d if f is not np.add or plain else d * wy, fy, axis=1) if len(fy) < len(y) else d if f is not np.add or plain else d * wy

    for part, d in distances(x, y, strip=THIN):
        own = code[part]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        spot = slice(own[0], own[-1] + 1)
        if linkage == "ward":
            d = d * np.sqrt(2 * (wx[part, None] * wy) / (wx[part, None] + wy))
        if extreme:
            best[spot] = extreme(best[spot], folded(extreme, d, first))
        if linkage != "ward":  # whose merges carry no means
            total[spot] += folded(np.add, d if plain else d * wx[part, None], first)
    return (best if extreme else total), total


def merged_by(d: np.ndarray, dj: np.ndarray, a: np.ndarray, b: np.ndarray, other: np.ndarray, h: np.ndarray, linkage: str) -> np.ndarray:
    """Distances of merged clusters, by Lance and Williams: rows d and dj of clusters of a and b rows, at h of each other, to
    clusters of `other` rows. Ward's are squares."""
    if linkage == "single":
        return np.minimum(d, dj)
    if linkage == "complete":
        return np.maximum(d, dj)
    a, b, h = a[:, None], b[:, None], h[:, None]
    if linkage == "average":
        return (a * d + b * dj) / (a + b)
    return ((a + other) * d + (b + other) * dj - other * h) / (a + b + other)


def _nearest(d: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of each row's least; of equals that of the least hash of both."""
    at = d.argmin(axis=1)
    near = d[np.arange(len(d)), at]
    tied = np.flatnonzero((d == near[:, None]).sum(axis=1) > 1)
    for few in np.array_split(tied, -(-len(tied) // 512)) if len(tied) else ():
        at[few] = np.where(d[few] == near[few, None], rank[few, None] ^ rank, np.iinfo(np.int64).max).argmin(axis=1)
    return at, near


def near_merges(points: DataFrame, clusters: DataFrame, centres: DataFrame, linkage: str, block: int, turn: int, base: int) -> DataFrame:
    """(left_id, right_id, height, size, left_size, mean, top, round_, root_): what cells merge by themselves; root_ is what
    right_id is part of in the end. A cluster of over a quarter of a cell's rows stands by, as its centre, and so does what
    falls into a cell of over twice its rows."""
    dims, kind = len([c for c in centres.columns if c[0] == "c" and c[1:-1].isdigit()]), type_of(points, "cluster_")
    dealt, made = placed(centres, dims, block, turn)
    dealt = dealt.join(clusters, "cluster_").withColumn("by_", F.col("n_") > block // 4)
    held = {r["cell_"]: r["n"] for r in dealt.where("not by_").groupBy("cell_").agg(F.sum("n_").alias("n")).collect()}
    full = [c for c, n in held.items() if n > 2 * block]
    dealt = dealt.where(~F.col("cell_").isin(full)) if full else dealt
    least = float(points.agg(F.min("w_")).first()[0])
    rest = ["cell_", "by_", "size_", "top_"]
    inside = points.join(dealt.where("not by_").select("cluster_", *rest), "cluster_").select("cluster_", "w_", "vector", *rest)
    aside = dealt.where("by_").select("cluster_", F.lit(0).cast("long").alias("w_"), F.array(*(f"c{k}_" for k in range(dims))).alias("vector"), *rest)
    rows = inside.unionByName(aside).withColumn("hash_", F.xxhash64("cluster_"))
    names = ["left_id", "right_id", "height", "size", "left_size", "mean", "top", "round_", "root_"]

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        cell, by = int(rows["cell_"].iloc[0]), rows["by_"].to_numpy(bool)
        apart, rows = vectors(rows["vector"][by]), rows[~by].sort_values("cluster_", kind="stable")
        if len(rows) < 2:
            return pd.DataFrame(columns=names, dtype=object)
        x, w = vectors(rows["vector"]), rows["w_"].to_numpy(float)
        ids, first = np.unique(rows["cluster_"].to_numpy(), return_index=True)
        size, top, rank = (rows[c].to_numpy()[first] for c in ("size_", "top_", "hash_"))
        weight, at = np.add.reduceat(w, first), np.arange(len(ids))
        centre = np.add.reduceat(x * w[:, None], first, axis=0) / weight[:, None]
        d, mean = between(x, w, first, x, w, first, linkage)
        if linkage != "ward":
            mean /= weight[:, None] * weight
        d = mean if linkage == "average" else np.square(d) if linkage == "ward" else d
        d = np.minimum(d, d.T)  # whatever the rounding of sums
        np.fill_diagonal(d, np.inf)
        room, out = 1e-12 * (1 + np.abs(x).max()), []

        def bound() -> np.ndarray:
            free = made.walls(centre, cell)
            for part, gap in distances(centre, apart) if len(apart) else ():
                free[part] = np.minimum(free[part], gap.min(axis=1))
            free = free * (1 - 1e-9) - room
            return np.where(free > 0, free**2 * 2 * weight * least / (weight + least), -1.0) if linkage == "ward" else free

        for turn_ in range(len(ids)):
            near, v = _nearest(d, rank[at])
            free, here = bound(), np.arange(len(at))
            i = np.flatnonzero((near[near] == here) & (here < near) & (v <= np.minimum(free, free[near])))
            if not len(i):
                break
            j, h = near[i], v[i]
            a, b = at[i], at[j]
            left, right = size[a], size[b]
            top[a] = np.maximum(np.sqrt(h) if linkage == "ward" else h, np.maximum(top[a], top[b]))
            size[a] = left + right
            out.append((a, b, top[a], size[a], left, h if linkage == "average" else np.zeros(len(i)) if linkage == "ward" else mean[i, j], turn_))
            kept, wi, wj = np.delete(here, j), weight[i], weight[j]
            centre[i] = (wi[:, None] * centre[i] + wj[:, None] * centre[j]) / (wi + wj)[:, None]
            sides = [(d, linkage)] + ([(mean, "average")] if linkage == "complete" else [])
            grown = weight.copy()
            grown[i] += wj
            new = []
            for table, by_ in sides:
                table[i] = merged_by(table[i], table[j], wi, wj, weight, h, by_)
                table = table[kept].T  # symmetric but for what the columns lack
                table[i] = merged_by(table[i], table[j], wi, wj, grown[kept], h, by_)
                new.append(table[kept])
                new[-1] = np.minimum(new[-1], new[-1].T)
            d, mean = new[0], new[-1]
            np.fill_diagonal(d, np.inf)
            weight, centre, at = grown[kept], centre[kept], at[kept]
            if len(at) < 2:
                break
        if not out:
            return pd.DataFrame(columns=names, dtype=object)
        a, b, height, sizes, lefts, means, turns = (np.concatenate([np.broadcast_to(o[f], len(o[0])) for o in out]) for f in range(7))
        root = np.arange(len(ids))
        for k in range(len(a) - 1, -1, -1):
            root[b[k]] = root[a[k]]
        return pd.DataFrame(dict(zip(names, (ids[a], ids[b], height, sizes, lefts, means, height, base + turns, ids[root[b]]))))

    schema = f"left_id {kind}, right_id {kind}, height double, size long, left_size long, mean double, top double, round_ long, root_ {kind}"
    done = rows.repartition(min(TASKS, 4 * len(made.lo)), "cell_").groupBy("cell_").applyInPandas(work, schema)
    return done.withColumn("mean", F.lit(None).cast("double")) if linkage == "ward" else done
