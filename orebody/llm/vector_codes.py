"""Product codes of vectors by Yinyang Lloyd, in whole numbers (operator 12).

Components become floor(SCALE * x); vectors are cut into `parts` equal parts, each with a codebook of its own. A
codebook starts as that part of the `entries` smallest vec_ids (of rows alike in id by vector; nulls last), and each
round assigns every part to its nearest entry and replaces the entries by floored means.

Yinyang: the entries of a codebook are clustered into groups once. A row carries for each part its entry and one lower
bound per group, on the distance to the nearest entry of the group but its own. When entries move, a group's bound falls
by the group's largest drift; the distance to the row's own entry is computed anew and is the upper bound. Only groups
whose bound does not exceed it are scanned, and get a new bound. Distances are squared in whole numbers, so ties go to
the lower index exactly; bounds are floats, rounded down beyond their error, so no entry at an equal distance is passed
over. The first round scans all groups.

Each round is one pass: the rows' state is written to the shared folder and read by the next, and sums per part, entry
and component are aggregated; the driver gets `entries` times the dimension of these, and broadcasts the codebooks. What
a round needs of the one before is dropped after it.

Rows whose vector is null or holds null or non-finite components are dropped; null ids and labels stay, repeated rows
stay repeated. With fewer rows than entries there are as many entries as rows; an empty table gives none. Vectors whose
length is not that of the first entry or does not divide by `parts`, and components of 2**25 or more in size after
scaling, are refused: their result is not defined, or would not fit whole numbers. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_split, materialize, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
GROUPS = 16
LARGEST = 1 << 25
BLOCK = 4096  # rows that are compared at once


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) in whole numbers: by floats where they hold every sum exactly."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * largest * largest < 1 << 53:
        y, d = x.astype(np.float64), c.astype(np.float64)
        return ((y * y).sum(axis=1)[:, None] - 2 * (y @ d.T) + (d * d).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in c], axis=1)


def grouped(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each entry, by a few rounds of Lloyd among the entries themselves."""
    k = min(groups, len(entries))
    centres = entries[np.linspace(0, len(entries) - 1, k).astype(int)].astype(np.float64)
    own = np.zeros(len(entries), dtype=np.int64)
    for _ in range(5):
        own = ((entries[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(own):
            centres[g] = entries[own == g].mean(axis=0)
    return np.unique(own, return_inverse=True)[1]


@dataclass(frozen=True)
class Codebook:
    """Entries of one part, their groups, and how far each moved in the last update (rounded up)."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def moved(self, entries: np.ndarray) -> Codebook:
        d2 = ((entries - self.entries) ** 2).sum(axis=1)
        return Codebook(entries, self.group, np.sqrt(d2.astype(np.float64)) * (1 + 1e-9))

    def drops(self) -> np.ndarray:
        out = np.zeros(self.group.max() + 1)
        np.maximum.at(out, self.group, self.drift)
        return out


def assign(x: np.ndarray, book: Codebook, own: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries (lower index in ties) of rows x, their squared distances, the groups' lower bounds, and how many
    distances to entries of scanned groups were computed. own, bounds: of the round before; None in the first."""
    n, groups = len(x), int(book.group.max()) + 1
    first = own is None
    if first:
        own = np.zeros(n, dtype=np.int64)
        bounds = np.full((n, groups), -1.0)
    else:
        bounds = bounds - book.drops() * (1 + 1e-6)
    best = ((x - book.entries[own]) ** 2).sum(axis=1)
    limit = np.sqrt(best.astype(np.float64)) * (1 + 1e-6) + 1e-6
    scan = bounds <= limit[:, None]
    least, at = best.copy(), own.copy()
    # Of each scanned group the least distance, and the least but for one entry: the bound if that entry is the row's own.
    near = np.full((n, groups), np.iinfo(np.int64).max)
    second, which = near.copy(), np.full((n, groups), -1)
    done = 0
    for g in range(groups):
        rows, members = np.flatnonzero(scan[:, g]), np.flatnonzero(book.group == g)
        if not len(rows):
            continue
        done += len(rows) * len(members)
        d2 = squared(x[rows], book.entries[members])
        k = d2.argmin(axis=1)  # members rise, so the lowest index of equal ones
        line = np.arange(len(rows))
        near[rows, g], which[rows, g] = d2[line, k], members[k]
        d2[line, k] = np.iinfo(np.int64).max
        second[rows, g] = d2.min(axis=1)
        better = (near[rows, g] < least[rows]) | ((near[rows, g] == least[rows]) & (which[rows, g] < at[rows]))
        least[rows[better]], at[rows[better]] = near[rows, g][better], which[rows, g][better]
    old = book.group[own]
    line = np.arange(n)
    fresh = np.sqrt(np.where(which == at[:, None], second, near).astype(np.float64)) * (1 - 1e-6)
    bounds = np.where(scan, fresh, bounds)
    # A row that leaves a group that was not scanned: its old entry counts there now.
    left = (at != own) & ~scan[line, old]
    bounds[left, old[left]] = np.minimum(bounds[left, old[left]], np.sqrt(best[left].astype(np.float64)) * (1 - 1e-6))
    return at, least, bounds, done


def _kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): whole components of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = "v is not null and not exists(v, c -> c is null or isnan(c) or abs(c) = double('infinity'))"
    large = F.exists("v", lambda c: F.floor(c * SCALE).between(-LARGEST + 1, LARGEST - 1) == F.lit(False))
    whole = F.when(large, F.raise_error(F.lit(f"components of {LARGEST} or more after scaling"))).otherwise(
        F.transform("v", lambda c: F.floor(c * SCALE).cast("int"))
    )
    return rows.where(finite).select("vec_id", "label", whole.cast("array<int>").alias("x"))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    if column.null_count or (len(column) and not (np.diff(column.offsets.to_numpy()) == width).all()):
        raise ValueError(f"vectors should have {width} components, as the first entry has")
    return column.flatten().to_numpy().reshape(len(column), width).astype(kind)


def _round(books: list[Codebook], width: int, first: bool):
    """One assignment of every row: codes, errors and bounds."""
    size = width // len(books)
    spans = np.cumsum([0, *(int(b.group.max()) + 1 for b in books)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = _matrix(b.column(2), width, np.int64)
                codes, errors, bounds = [], np.zeros(len(x), dtype=np.int64), []
                before = None if first else _matrix(b.column(3), len(books), np.int64)
                old = None if first else _matrix(b.column(4), int(spans[-1]), np.float64)
                for k, book in enumerate(books):
                    part = x[:, k * size : (k + 1) * size]
                    own, least, low, _ = assign(part, book, None if first else before[:, k], None if first else old[:, spans[k] : spans[k + 1]])
                    codes.append(own)
                    errors += least
                    bounds.append(np.minimum(low, 3e38))
                low = np.concatenate(bounds, axis=1)
                down = np.nextafter(low.astype(np.float32), np.float32(-np.inf))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]) for v in (np.stack(codes, axis=1).astype(np.int16), down)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), lists[0].cast(pa.list_(pa.int16())), lists[1].cast(pa.list_(pa.float32())), pa.array(errors)],
                    ["vec_id", "label", "x", "codes", "bounds", "error"],
                )

    return run


def _sums(parts: int, width: int):
    """Of a partition, sums of the components and counts by part and entry, as one row per (part, entry)."""
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, codes = _matrix(b.column(0), width, np.int64), _matrix(b.column(1), parts, np.int64)
            for k in range(parts):
                order = np.argsort(codes[:, k], kind="stable")
                found, start = np.unique(codes[order, k], return_index=True)
                counts = np.diff(np.append(start, len(order)))
                sums = np.add.reduceat(x[order, k * size : (k + 1) * size], start, axis=0)
                for c, row in zip(found.tolist(), np.column_stack([counts, sums])):
                    total[k, c] = total.get((k, c), 0) + row
        keys = [(k, c, i) for k, c in total for i in range(size + 1)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([key[i] for key in keys], pa.int32()) for i in range(3)), pa.array(np.concatenate([np.empty(0, np.int64), *total.values()]))],
            ["part", "entry", "at", "v"],
        )

    return run


def train_and_encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook]]:
    """(vec_id, label, codes array<short>, error), and the final codebooks."""
    spark = vectors.sparkSession
    state = materialize(_kept(vectors), "whole")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return state.selectExpr("vec_id", "label", "cast(array() as array<smallint>) as codes", "0L as error"), []
    width = len(first[0]["x"])
    if not width or width % parts or any(len(r["x"]) != width for r in first):
        raise ValueError(f"vectors should have one length that {parts} divides")
    start = np.array([r["x"] for r in first], dtype=np.int64)
    size = width // parts
    books = []
    for k in range(parts):
        own = start[:, k * size : (k + 1) * size]
        books.append(Codebook(own, grouped(own), np.zeros(len(own))))
    kind = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, x array<int>, codes array<smallint>, bounds array<float>, error long"
    for n in range(rounds + 1):
        old = state
        state = materialize(old.mapInArrow(_round(books, width, n == 0), kind), "codes")
        discard(old)
        if n == rounds:
            break
        sums = state.select("x", "codes").mapInArrow(_sums(parts, width), "part int, entry int, at int, v long")
        # entries * (width + parts) rows at most.
        got = sums.groupBy("part", "entry", "at").agg(F.sum("v").alias("v")).collect()
        table_ = np.zeros((parts, len(first), size + 1), dtype=np.int64)
        for r in got:
            table_[r["part"], r["entry"], r["at"]] = r["v"]
        for k, book in enumerate(books):
            counts = table_[k, :, :1]
            books[k] = book.moved(np.where(counts > 0, table_[k, :, 1:] // np.maximum(1, counts), book.entries))
    return state.select("vec_id", "label", "codes", "error"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = train_and_encode(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()
    # Equal labels meet in a string of their own: nulls together, and a label of very many rows is joined by broadcast.
    rows = found.withColumn("_l", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    by_label = materialize(rows.groupBy("_l").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    rows = join_split(rows, by_label, "_l", "_n", rows.count())
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB: every distance computed, round by round. One length of vectors is taken for granted."""
    at = "(p - 1) * (len(x) // {n}) + 1"
    sql = [
        f"""WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label,
            list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    cut AS MATERIALIZED (SELECT r, p, x[{at.format(n=parts)} : p * (len(x) // {parts})] AS v FROM whole, range(1, {parts + 1}) t(p)),
    first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS c FROM whole QUALIFY c < {entries}),
    book0 AS MATERIALIZED (SELECT p, c, v FROM cut JOIN first USING (r))"""
    ]
    for n in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(cut.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        sql.append(f"""near{n} AS MATERIALIZED (SELECT r, p, min((d, c)) AS best FROM
            (SELECT cut.r, cut.p, b.c, {distance} AS d FROM cut JOIN book{n} b ON cut.p = b.p) GROUP BY r, p)""")
        if n < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            sql.append(f"""sum{n} AS (SELECT p, c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM
            (SELECT p, struct_extract_at(best, 2) AS c, v, unnest(range(1, len(v) + 1)) AS i FROM near{n} JOIN cut USING (r, p)) GROUP BY p, c, i),
    book{n + 1} AS MATERIALIZED (SELECT p, c, coalesce(m, book{n}.v) AS v FROM book{n}
        LEFT JOIN (SELECT p, c, list({mean} ORDER BY i) AS m FROM sum{n} GROUP BY p, c) USING (p, c))""")
    return (
        ",\n    ".join(sql)
        + f""",
    coded AS (SELECT r, string_agg(printf('%02x', struct_extract_at(best, 2)), '' ORDER BY p) AS code, sum(struct_extract_at(best, 1))::BIGINT AS error
        FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY p, c)) FROM book{rounds}) AS codebooks_sha256
FROM whole JOIN coded USING (r)"""
    )
