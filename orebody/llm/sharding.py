"""Sharding by a Feistel permutation of global row numbers (operator 5). DataFrame operations only.

Rows are numbered 0 .. N-1 in the order of (doc_id, checksum, size): the digest of the documents is range-partitioned
and written; a row's number is its rank within its range plus the sizes of the ranges before. A keyed permutation of
0 .. N-1 then shuffles the numbers: p is dealt to shard p mod S at slot p div S, so shard sizes differ by at most
one, slots have no gaps, and (shard, slot) can be computed from the number, N and the key alone.

The permutation is a Feistel network over Z_a x Z_b with a = ceil(sqrt(N)) and b = ceil(N / a): rounds add a keyed
function of one half to the other, modulo a or b, so each can be undone. The product is at most N + a; a number that
leaves 0 .. N-1 is permuted again until it is back (cycle walking).

Null texts have no bytes and the checksum of an empty text. Null doc_ids are numbered first. Rows alike in all
three columns get different slots, interchangeably. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, running_base, table, utf8_bytes

SHARDS = 40
OVERHEAD = 16
ROUNDS = 6
KEY = 20_240_601
PRIME = 2_147_483_647  # 2^31 - 1: squares of residues fit 64 bits
WALKS = 64


def round_keys(key: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, from a linear congruence on the key."""
    out, x = [], key % PRIME
    for _ in range(rounds):
        x = (x * 48_271 + 11) % PRIME
        y = (x * 48_271 + 13) % PRIME
        out.append((x or 1, y))
        x = y
    return out


def feistel_sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted_sql(x: str, n: int, key: int = KEY) -> str:
    """One application of the network to the number x, as SQL that Spark and others understand alike."""
    a, b = feistel_sides(n)
    if a >= PRIME:
        raise ValueError("too many rows")
    left, right = f"({x} % {a})", f"({x} div {a})"
    steps = []
    for k, (m, c) in enumerate(round_keys(key)):
        source, target, size = ("r", "l", a) if k % 2 == 0 else ("l", "r", b)
        steps.append((source, target, size, m, c))
    # Each round names its halves anew through a one-element transform, so no half is written out twice.
    text = f"struct({left} as l, {right} as r)"
    for source, target, size, m, c in steps:
        t = f"((s.{source} * {m}L + {c}L) % {PRIME}L)"
        new = f"(s.{target} + ({t} * {t} % {PRIME}L) % {size}L) % {size}L"
        l, r = (new, "s.r") if target == "l" else ("s.l", new)
        text = f"transform(array({text}), s -> struct({l} as l, {r} as r))[0]"
    return f"transform(array({text}), s -> s.l + s.r * {a}L)[0]"


def permute(number: Column, n: int, key: int = KEY) -> Column:
    """The permutation of 0 .. n-1. A walk ends as soon as it is back; the numbers outside are fewer than
    sqrt(n) + 1 of n, so for n under 4,096 WALKS steps reach them all, and beyond that a walk as long as WALKS has
    a chance under (1/64)^64. Should one occur the job stops rather than give a wrong row."""
    a, b = feistel_sides(n)
    outside = a * b - n
    once = permuted_sql("x", n, key)
    walks = min(outside + 1, WALKS)
    end = F.expr(f"aggregate(sequence(1, {walks}), named_struct('p', number_, 'done', false), (w, i) -> "
                 f"if(w.done, w, transform(array(transform(array(w.p), x -> {once})[0]), y -> named_struct('p', y, 'done', y < {n}L))[0]), w -> w.p)")  # fmt: skip
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("the walk did not return")).cast("long"))


def global_numbers(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with number_ (0 .. N-1 in the order of the columns, nulls first), and N. The ranges are written once and
    read back, so every use sees the same ones; the driver gets N alone."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    n = counts.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]
    bases = running_base(counts, "part_", "n_", "base_").withColumnRenamed("part_", "base_part_")
    within = Window.partitionBy("part_").orderBy(*order)
    numbered = ranged.withColumn("rank_", F.row_number().over(within)).join(bases, F.col("part_") == F.col("base_part_"))
    return numbered.select(*rows.columns, (F.col("base_") + F.col("rank_") - 1).alias("number_")), n


def shards(documents: DataFrame, shard_count: int = SHARDS, key: int = KEY) -> DataFrame:
    """(doc_id, size, text_crc32, number_, shard, slot)"""
    digest = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (utf8_bytes(F.col("text")) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    numbered, n = global_numbers(digest, ["doc_id", "text_crc32", "size"])
    place = numbered.withColumn("place_", permute(F.col("number_"), n, key))
    return place.select(
        "doc_id", "size", "text_crc32", "number_",
        (F.col("place_") % shard_count).cast("int").alias("shard"), F.expr(f"place_ div {shard_count}").alias("slot"),
    )


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def crc32_sql(octets: str) -> str:
    """DuckDB SQL for the CRC-32 of a list of octets. A table entry is the XOR of the entries of its index's bits."""
    entries = []
    for k in range(8):
        v = 1 << k
        for _ in range(8):
            v = v >> 1 ^ 0xEDB88320 * (v & 1)
        entries.append(v)
    step = "c >> 8"
    for k, v in enumerate(entries):
        step = f"xor({step}, ((xor(c, x) >> {k}) & 1) * {v})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: {step}), 4294967295)"


def oracle_sql(shard_count: int = SHARDS, key: int = KEY) -> str:
    """The query's rows in DuckDB SQL: numbers by a window, the walk by a recursive query."""
    walk = "SELECT num, step, p % a AS l, p // a AS r FROM walk, sides WHERE p >= n OR step = 0"
    for k, (m, c) in enumerate(round_keys(key)):
        ours, theirs, side = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        t = f"(({theirs} * {m} + {c}) % {PRIME})"
        walk = f"SELECT num, step, {theirs}, ({ours} + ({t} * {t} % {PRIME}) % {side}) % {side} AS {ours} FROM ({walk}), sides"
    return f"""
WITH RECURSIVE h AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT doc_id, (strlen(t) + {OVERHEAD})::BIGINT AS size, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS octets FROM h),
d AS MATERIALIZED (SELECT doc_id, size, {crc32_sql("octets")} AS text_crc32 FROM o),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS num FROM d),
sides AS MATERIALIZED (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT count(*) AS n, greatest(1, ceil(sqrt(count(*)))::BIGINT) AS a FROM documents)),
walk AS (SELECT num, num AS p, 0 AS step FROM numbered UNION ALL
  SELECT num, l + r * a, step + 1 FROM ({walk}), sides)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shard_count})::INT AS shard, (p // {shard_count})::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered JOIN (SELECT num, p FROM walk, sides WHERE step > 0 AND p < n) USING (num)
"""
