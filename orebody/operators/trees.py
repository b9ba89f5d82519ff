"""Decision trees on nominal and numeric attributes, built level by level. Every row carries the number of its open node;
a level takes one step of routing, one aggregation of class counts by (node, attribute, value), and chooses the splits
on the executors: the driver gets a row per open node. The tree is a small object; prediction walks it through literal
arrays, as many steps as it is deep. Ties between classes go to the smaller label, ties between attributes to the earlier
one."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ordering import running_counts


def entropy_of(counts: Column) -> Column:
    """Entropy in bits of an array of counts."""
    n = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda s, x: s - x / n * F.log2(x / n))


def class_entropy(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").cast("double").alias("n_"))
    t = counts.agg(F.sum("n_").alias("t_"))
    return counts.crossJoin(F.broadcast(t)).agg(F.round(F.coalesce(-F.sum(F.col("n_") / F.col("t_") * F.log2(F.col("n_") / F.col("t_"))), F.lit(0.0)), 6).alias("entropy"))


def _nlogn(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def attribute_gains(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """(attribute, gain, split_info, gain_ratio) of nominal attributes, all in one pass. Split information 0 counts
    as 1e-9. Entropies are sums of n log n, so no list of an attribute's values is formed."""
    long = df.select(F.col(label).alias("y_"), F.inline(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("v_")) for a in attributes))))
    cells = long.groupBy("attribute", "v_", "y_").agg(F.count("*").cast("double").alias("n_"))
    values = cells.groupBy("attribute", "v_").agg(F.sum("n_").alias("nv_"), F.sum(_nlogn(F.col("n_"))).alias("s_"))
    split = values.groupBy("attribute").agg(F.sum("nv_").alias("t_"), F.sum(_nlogn(F.col("nv_")) - F.col("s_")).alias("rest_"), F.sum(_nlogn(F.col("nv_"))).alias("sv_"))
    classes = cells.groupBy("attribute", "y_").agg(F.sum("n_").alias("ny_")).groupBy("attribute").agg(F.sum(_nlogn(F.col("ny_"))).alias("sy_"))
    t = F.col("t_")
    gain, si = F.log2(t) - (F.col("sy_") + F.col("rest_")) / t, F.round(F.log2(t) - F.col("sv_") / t, 12)
    return split.join(classes, "attribute").select(
        "attribute", F.round(gain, 6).alias("gain"), F.round(si, 6).alias("split_info"), F.round(gain / F.when(si == 0, F.lit(1e-9)).otherwise(si), 6).alias("gain_ratio")
    )


def best_thresholds(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """(attribute, threshold, gain_ratio): the midpoint between neighbouring values with the best gain ratio, the
    lowest on ties; null and 0 with under two values. Class counts of distinct values are summed up over ranges of the
    values, so no task holds an attribute."""
    classes = [r[0] for r in df.select(F.col(label).cast("string")).distinct().orderBy(label).collect()]  # a row per class
    long = df.select(F.col(label).cast("string").alias("y_"), F.inline(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("v_")) for a in attributes))))
    cells = long.where("v_ is not null").groupBy("attribute", "v_").agg(*_class_counts(classes))
    names = [f"c{k}_" for k in range(len(classes))]
    totals = cells.groupBy("attribute").agg(*(F.sum(c).alias(f"t{c}") for c in names))
    at = running_counts(cells, "v_", names, ["attribute"]).where("next_ is not null").join(totals, "attribute")
    scored = at.select("attribute", ((F.col("v_") + F.col("next_")) / 2).alias("threshold"), F.round(_two_way(names, ratio=True), 6).alias("gain_ratio"))
    best = scored.groupBy("attribute").agg(F.max(F.struct("gain_ratio", (-F.col("threshold")).alias("t"))).alias("b"))
    all_of = long.select("attribute").distinct()
    return all_of.join(best, "attribute", "left").select("attribute", (-F.col("b.t")).alias("threshold"), F.coalesce("b.gain_ratio", F.lit(0.0)).alias("gain_ratio"))


def _class_counts(classes: list, weight: str | None = None) -> list[Column]:
    w = _weight(weight)
    return [F.sum(F.when(F.col("y_").eqNullSafe(F.lit(y)), w).otherwise(0)).cast("double").alias(f"c{k}_") for k, y in enumerate(classes)]


def _weight(weight: str | None) -> Column:
    """How many rows a row stands for."""
    return F.col(weight) if weight else F.lit(1).cast("long")


def _sum(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def _two_way(names: list[str], ratio: bool) -> Column:
    """The worth of a split behind a value: counts of the value's classes `names`, of those before it b<name>, of all t<name>."""
    left = [F.col(f"b{c}") + F.col(c) for c in names]
    right, all_ = [F.col(f"t{c}") - x for c, x in zip(names, left)], [F.col(f"t{c}") for c in names]
    t, nl, nr = _sum(all_), _sum(left), _sum(right)
    own = _nlogn(t) - _sum([_nlogn(x) for x in all_])
    rest = _nlogn(nl) + _nlogn(nr) - _sum([_nlogn(x) for x in (*left, *right)])
    gain, info = (own - rest) / t, F.round((_nlogn(t) - _nlogn(nl) - _nlogn(nr)) / t, 12)
    return gain / F.when(info == 0, F.lit(1e-9)).otherwise(info) if ratio else gain


@dataclass
class Node:
    label: str | None
    counts: dict[str, int]
    attribute: str | None = None
    threshold: float | None = None
    score: float = 0.0
    children: dict[object, Node] = field(default_factory=dict)  # value, or "<=" and ">"

    @property
    def n(self) -> int:
        return sum(self.counts.values())

    @property
    def leaf(self) -> bool:
        return not self.children


def _majority(counts: dict[str, int]) -> str | None:
    return min(counts, key=lambda k: (-counts[k], k)) if counts else None


def _h(counts) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts if c) if n else 0.0


def _literal(values: list, kind: str) -> Column:
    """A literal array, however long: one string to split, not a call for each of its values."""
    return F.split(F.lit(",".join("NULL" if v is None else repr(v) for v in values)), ",").try_cast(f"array<{kind}>")


def _step(nodes_: list[Node], first: list[int], here: Column) -> Column:
    """The place of a row's next node: nodes_[k] has its children from place first[k] on. -1 - k where its value has no
    branch, k itself at a leaf."""
    splits = [n for n in nodes_ if not n.leaf]
    if not splits:
        return here
    attributes = sorted({n.attribute for n in splits})
    place = {a: k for k, a in enumerate(attributes)}
    of = F.get(_literal([-1 if n.leaf else place[n.attribute] for n in nodes_], "int"), here)
    start = F.get(_literal(first, "int"), here)
    threshold = F.get(_literal([n.threshold for n in nodes_], "double"), here)
    names = {n.attribute: list(n.children) for n in splits if n.threshold is None}
    value = F.get(F.array(*(F.col(a).cast("string") for a in attributes)), of)
    number = F.get(F.array(*(F.lit(None).cast("double") if a in names else F.col(a).cast("double") for a in attributes)), of)
    known = F.get(F.array(*(F.array(*map(F.lit, names.get(a, [""]))) for a in attributes)), of)
    branch = F.when(threshold.isNotNull(), F.when(number <= threshold, 0).when(number > threshold, 1)).otherwise(F.array_position(known, value).cast("int") - 1)
    branch = F.when(branch >= 0, start + branch).otherwise(-1 - here)
    return F.when(of < 0, here).otherwise(branch)


def flat(root: Node) -> tuple[list[Node], list[int], int]:
    """The nodes level by level, the place of each one's first child, and how deep the tree is."""
    out, first, at, depth, level = [root], [], 0, 0, 1
    while at < len(out):
        end = at + level
        for node in out[at:end]:
            first.append(len(out))
            out.extend(node.children.values())
        at, level = end, len(out) - end
        depth += level > 0
    return out, first, depth


def locate(root: Node) -> Column:
    """The place in flat(root) of the last node that a row gets to: a leaf, or the node that does not know its value."""
    nodes_, first, depth = flat(root)
    here = F.lit(0)
    if depth:
        here = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda k, _: F.when(k < 0, k).otherwise(_step(nodes_, first, k)))
    return F.when(here < 0, -1 - here).otherwise(here)


def build_tree(
    df: DataFrame, attributes: list[str], label: str, numeric: Collection[str] = (), ratio: bool = True, min_rows: int | None = None,
    max_depth: int | None = None, weight: str | None = None,
) -> Node:
    """attributes in the order that settles ties; those in numeric split in two. ratio=False: by information gain
    (ID3). ratio=True: by gain ratio (J48). An attribute is used once on a path. A node of min_rows or fewer rows is a
    leaf (2 for J48, none for ID3); depth is not limited unless asked. A branch that no row takes is a leaf with its
    parent's majority. Rows alike are counted once, so a level has a row per distinct one; weight: a column that says how many
    rows each stands for. The driver gets the classes, the values of nominal attributes and a row per open node."""
    min_rows = (2 if ratio else 0) if min_rows is None else min_rows
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y_"), *(F.col(a) for a in attributes), _weight(weight).alias("w_"))
    rows = cut(rows.groupBy("y_", *attributes).agg(F.sum("w_").alias("w_")).withColumn("node_", F.lit(0)))
    classes = [r[0] for r in rows.select("y_").distinct().orderBy("y_").collect()]
    nominal = [a for a in attributes if a not in numeric]
    values: dict[str, list[str]] = {a: [] for a in nominal}
    if nominal:
        pairs = F.array(*(F.struct(F.lit(a).alias("a_"), F.col(a).cast("string").alias("v_")) for a in nominal))
        for r in rows.select(F.inline(pairs)).where("v_ is not null").distinct().orderBy("a_", "v_").collect():
            values[r["a_"]].append(r["v_"])
    root = Node(None, {})
    open_: list[tuple[Node, list[int]]] = [(root, list(range(len(attributes))))]
    depth = 0
    while open_ and classes:
        depth += 1
        got = {r["node_"]: r for r in _splits(rows, attributes, set(numeric), classes, [left for _, left in open_], ratio).collect()}
        next_: list[tuple[Node, list[int]]] = []
        first = []
        for k, (node, left) in enumerate(open_):
            first.append(len(next_))
            if k not in got:
                continue
            r = got[k]
            node.counts = {y: int(c) for y, c in zip(classes, r["counts"]) if c}
            node.label = _majority(node.counts) or node.label
            if len(node.counts) < 2 or node.n <= min_rows or (max_depth is not None and depth > max_depth) or r["best"] is None or r["best"]["score"] <= 0:
                continue
            best = r["best"]
            a = -best["a"]
            node.attribute, node.score, node.threshold = attributes[a], best["score"], None if attributes[a] in values else -best["t"]
            for name in ("<=", ">") if node.threshold is not None else values[node.attribute]:
                node.children[name] = Node(node.label, {})
                next_.append((node.children[name], [x for x in left if x != a]))
        step = _step([n for n, _ in open_], first, F.col("node_"))
        leaf = _literal([int(n.leaf) for n, _ in open_], "int")
        rows = cut(rows.withColumn("node_", F.when(F.get(leaf, F.col("node_")) == 0, step)).where("node_ >= 0")) if next_ else rows
        open_ = next_
    return root


def _splits(rows: DataFrame, attributes: list[str], numeric: set[str], classes: list[str], left: list[list[int]], ratio: bool) -> DataFrame:
    """(node_, counts, best): of each open node its class counts and its best split (score, a: minus the attribute's place,
    t: minus the threshold). left: the attributes that a node may still use."""
    names = [f"c{k}_" for k in range(len(classes))]
    mask = F.get(F.split(F.lit(";".join(" ".join(map(str, x)) for x in left)), ";"), F.col("node_"))
    mine = F.split(mask, " ")
    # What a level reads several times is a row per node, attribute and value, not per row of the table.
    number = {a: F.col(a).cast("double") if a in numeric else F.lit(None).cast("double") for a in attributes}
    value = {a: F.lit(None).cast("string") if a in numeric else F.col(a).cast("string") for a in attributes}
    kinds = [F.struct(F.lit(k).alias("a_"), number[a].alias("x_"), value[a].alias("v_")) for k, a in enumerate(attributes)]
    long = rows.select("node_", "y_", "w_", F.inline(F.filter(F.array(*kinds), lambda s: F.array_contains(mine, s["a_"].cast("string")))))
    cells = cut(long.groupBy("node_", "a_", "x_", "v_").agg(*_class_counts(classes, "w_")))
    totals = cut(rows.groupBy("node_").agg(*_class_counts(classes, "w_")))
    sized = totals.select("node_", *(F.col(c).alias(f"t{c}") for c in names))
    n = _sum([F.col(c) for c in names])
    scores = []
    if len(numeric) < len(attributes):
        flags = F.array(*(F.lit(a not in numeric) for a in attributes))
        by = cells.where(F.get(flags, F.col("a_"))).groupBy("node_", "a_").agg(
            F.sum(_nlogn(n)).alias("sv_"), F.sum(_sum([_nlogn(F.col(c)) for c in names])).alias("s_")
        ).join(sized, "node_")
        all_ = [F.col(f"t{c}") for c in names]
        t = _sum(all_)
        gain, info = (F.col("s_") - F.col("sv_") + _nlogn(t) - _sum([_nlogn(x) for x in all_])) / t, F.round(F.log2(t) - F.col("sv_") / t, 12)
        worth = gain / F.when(info == 0, F.lit(1e-9)).otherwise(info) if ratio else gain
        scores.append(by.select("node_", "a_", F.round(worth, 11).alias("score"), F.lit(None).cast("double").alias("t")))
    if numeric:
        points = cells.where("x_ is not null").select("node_", "a_", "x_", *names)
        at = running_counts(points, "x_", names, ["node_", "a_"]).where("next_ is not null").join(sized, "node_")
        scores.append(at.select("node_", "a_", F.round(_two_way(names, ratio), 11).alias("score"), (-(F.col("x_") + F.col("next_")) / 2).alias("t")))
    found = scores[0] if len(scores) == 1 else scores[0].unionByName(scores[1])
    best = found.groupBy("node_").agg(F.max(F.struct("score", (-F.col("a_")).alias("a"), "t")).alias("best"))
    return totals.select("node_", F.array(*names).alias("counts")).join(best, "node_", "left")


def compare_trees(trees: dict[str, Node], sets: dict[str, DataFrame], label: str, weight: str | None = None) -> DataFrame:
    """(tree, nodes, leaves, rules, accuracy on each of the sets): pruned against unpruned. weight: as of build_tree."""
    spark, w = next(iter(sets.values())).sparkSession, _weight(weight)
    hit = {n: predict(t) == F.col(label).cast("string") for n, t in trees.items()}
    share = [F.try_divide(F.sum(F.when(h, w).when(~h, 0)), F.sum(F.when(h.isNotNull(), w))).alias(n) for n, h in hit.items()]
    right = {s: df.agg(*share).first() for s, df in sets.items()}
    rows = [(n, nodes(t), leaves(t), len(rules(t)), *(None if right[s][n] is None else round(right[s][n], 6) for s in sets)) for n, t in trees.items()]
    return spark.createDataFrame(rows, ", ".join(["tree string", "nodes int", "leaves int", "rules int", *(f"{s}_accuracy double" for s in sets)]))


def predict(node: Node) -> Column:
    """A value that the tree does not know gets the majority of the last node before it."""
    nodes_, _, _ = flat(node)
    labels = sorted({n.label for n in nodes_ if n.label is not None})
    at = F.get(_literal([-1 if n.label is None else labels.index(n.label) for n in nodes_], "int"), locate(node))
    return F.get(F.array(*map(F.lit, labels)), at) if labels else F.lit(None).cast("string")


def nodes(node: Node) -> int:
    return 1 + sum(map(nodes, node.children.values()))


def leaves(node: Node) -> int:
    return 1 if node.leaf else sum(map(leaves, node.children.values()))


def rules(node: Node, path: tuple[str, ...] = ()) -> list[tuple[list[str], str | None, int]]:
    """(conditions, label, training rows) of every leaf."""
    if node.leaf:
        return [(list(path), node.label, node.n)]
    out = []
    for name, child in node.children.items():
        test = f"{node.attribute} {name} {node.threshold:g}" if node.threshold is not None else f"{node.attribute} = {name}"
        out += rules(child, (*path, test))
    return out


def rules_frame(spark, node: Node) -> DataFrame:
    rows = [(k, " AND ".join(c), y, n) for k, (c, y, n) in enumerate(rules(node), 1)]
    return spark.createDataFrame(rows, "rule_id int, conditions string, label string, n long")


def render(node: Node, indent: str = "") -> str:
    if node.leaf:
        return f"{indent}-> {node.label} ({node.n})\n"
    out = ""
    for name, child in node.children.items():
        test = f"{name} {node.threshold:g}" if node.threshold is not None else f"= {name}"
        out += f"{indent}{node.attribute} {test}\n{render(child, indent + '  ')}"
    return out


def prune(node: Node, df: DataFrame, label: str, scope: str = "routed", weight: str | None = None) -> Node:
    """Reduced-error pruning, bottom up: a node becomes a leaf if that does not lower accuracy on df. 'routed' judges
    a node on the rows that reach it; 'global' on all rows, as if the node alone were the tree. One aggregation counts
    the classes at the last node that rows get to; for 'global' one more for each level, of all its nodes at once. weight: as
    of build_tree."""
    every, first, _ = flat(node)
    seen: list[dict[str, int]] = [defaultdict(int) for _ in every]
    y = F.col(label).cast("string").alias("y_")
    for r in df.select(locate(node).alias("k_"), y, _weight(weight).alias("w_")).groupBy("k_", "y_").agg(F.sum("w_").alias("n_")).collect():
        seen[r["k_"]][r["y_"]] += r["n_"]
    for k in range(len(every) - 1, -1, -1):  # children lie behind their parents
        for child in range(first[k], first[k] + len(every[k].children)):
            for name, c in seen[child].items():
                seen[k][name] += c
    right, kept = [0] * len(every), list(every)
    levels, hi = [(0, 1)], 1
    while hi < len(every):
        lo, hi = hi, hi + sum(len(n.children) for n in every[levels[-1][0] : hi])
        levels.append((lo, hi))
    for lo, hi in reversed(levels):
        trees: list[int] = []
        for k in range(lo, hi):
            n, kids = every[k], range(first[k], first[k] + len(every[k].children))
            if n.leaf:
                kept[k], right[k] = Node(n.label, n.counts), seen[k].get(n.label, 0)
                continue
            right[k] = sum(right[c] for c in kids)
            kept[k] = Node(n.label, n.counts, n.attribute, n.threshold, n.score, dict(zip(n.children, (kept[c] for c in kids))))
            trees.append(k)
        if scope == "global" and trees:
            alone = df.agg(*(F.coalesce(F.sum(F.when(predict(kept[k]) == F.col(label).cast("string"), _weight(weight))), F.lit(0)).alias(f"n{k}") for k in trees)).first()
        for k in trees:
            as_leaf = seen[k].get(every[k].label, 0)
            if (seen[0].get(every[k].label, 0) >= alone[f"n{k}"]) if scope == "global" else (as_leaf >= right[k]):
                kept[k], right[k] = Node(every[k].label, every[k].counts), as_leaf
    return kept[0]
