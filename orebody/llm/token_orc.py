"""Token ids in ORC files (operator 2).

`write_token_orc` encodes whole texts and writes (doc_id, n_tokens, ids, part, before) in ascending doc_id order:
documents are range-partitioned and sorted by (doc_id, hash of the text, its length), so file follows file, and rows
of one doc_id, or without one, spread over as many ranges as they need. ORC stores the ids with its integer run-length
encoding, keeps a row index every `row_index_stride` rows and a Bloom filter on doc_id in each; stripes are the unit of
parallel reads. `read_token_orc` reads them back, and with `doc_ids` the predicate is pushed down to file and stripe
statistics, row indexes and Bloom filters.

part is the number of a range, before the ids of the range's documents ahead of a row: a row's start is the sum of the
ranges before its own plus that, in the order of the files, without a sort.

Null texts count as empty and give the end id alone. Null doc_ids come first. Rows with the same doc_id keep one row
each, in the order of their texts' hash and length; rows alike in all are interchangeable. A text of any length is one
row; batches to and from Python are cut by bytes. Empty tables give no rows. Further columns of the input, whatever
their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_base, scratch_path, table
from .tokens import END_ID, vocabulary, word_encoder

SCHEMA = "doc_id long, n_tokens long, ids array<int>, part int, before long"
#: Rows of one Arrow batch of encoded documents, by their ids' bytes.
BATCH_BYTES = 8 << 20


def _encode(path: str, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, total = TaskContext.get().partitionId(), word_encoder(path), 0

        def batch(keys: list, ids: list[bytes]) -> pa.RecordBatch:
            nonlocal total
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            flat = np.frombuffer(b"".join(ids), dtype="<i4")
            stops = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))
            before = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sizes), lists, pa.array(np.full(len(ids), part, np.int32)), pa.array(before)],
                ["doc_id", "n_tokens", "ids", "part", "before"],
            )

        for b in batches:
            keys, ids, size = [], [], 0
            texts = [x or "" for x in b.column(1).to_pylist()]
            for key, x in zip(b.column(0).to_pylist(), encoder.encode(texts)):
                keys.append(key)
                ids.append(x + end)
                size += len(x)
                if size > BATCH_BYTES:
                    yield batch(keys, ids)
                    keys, ids, size = [], [], 0
            if keys:
                yield batch(keys, ids)

    return run


def write_token_orc(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    partitions: int | None = None,
    stripe_bytes: int = 64 << 20,
    row_index_stride: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Texts are shuffled, not ids: they are the smaller of the two, and each is encoded once."""
    spark = documents.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.length("text")]
    ordered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order)
    (
        ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(bloom_fpp))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    ids = spark.read.schema(SCHEMA).orc(path)
    return ids if doc_ids is None else ids.where(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        stops, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        raw = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(stops.tolist(), stops[1:].tolist())]
        sizes = np.diff(stops).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), b.column(3), pa.array(sizes), pa.array(crc, pa.int64())],
            ["doc_id", "part", "before", "n_tokens", "ids_crc32"],
        )


def token_orc_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from what read_token_orc gives. The sums of whole ranges, one row each, are
    added up apart and broadcast: there are as many as write_token_orc had partitions."""
    rows = tokens.select("doc_id", "ids", "part", "before").mapInArrow(_digest, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    sums = running_base(
        tokens.groupBy(F.col("part").alias("_part")).agg(F.sum("n_tokens").alias("_n")), "_part", "_n", "_base"
    )
    return rows.join(F.broadcast(sums), F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    write_token_orc(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_orc_digest(read_token_orc(spark, path))
