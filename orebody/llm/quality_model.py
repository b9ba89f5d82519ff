"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader (operator 6).

A text's words (split at white space) give two token streams: the lower-cased word, and its shape (runs of capitals,
small letters, digits, and the other characters as they are; the whole word counts). Single tokens and pairs of neighbours in each stream
are hashed into 2^BITS columns; a column's value is its share of all n-grams of the text, times SCALE. The score is
the sigmoid of the sparse dot product of these with the weights.

Training passes twice over at most `max_rows` labelled documents in the order of a hash of doc_id (the bound is a
parameter; the sample's features, not its texts, come to the driver). Rows with crc32(doc_id as text) mod 3 = 1 are
never trained on; lang, source and doc_id are never inputs. Weights are a dense float32 array of 2^BITS, whatever
the corpus. Null texts count as empty: no n-grams, the score is that of the bias. Null doc_ids are not held out.
With no labels every score is 0.5. Rows with equal ids are scored each for itself; further columns are not read.
A text of any length is hashed whole; it takes some 40 bytes a word. A score of exactly 0.5 predicts 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, labelled_sample, table

BITS = 18
SCALE = 20.0
MAX_ROWS = 8_000
PASSES = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
MEMO_ENTRIES = 400_000

_CAPITALS, _SMALL = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A]+")
_memo = Memo(MEMO_ENTRIES)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def shape(word: str) -> str:
    s = re.sub(r"\d+", "9", word)
    s = _CAPITALS.sub(lambda m: "A" if len(m[0]) == 1 else "AA", s)
    return re.sub(r"A{3,}", "AA", _SMALL.sub("a", s))


def _hashes(word: str) -> int:
    """crc32 of the lower-cased word and of its shape, side by side."""
    return zlib.crc32(word.lower().encode()) | zlib.crc32(b"\0" + shape(word).encode()) << 32


def ngram_columns(text: str) -> np.ndarray:
    """The hash column of every n-gram occurrence."""
    words = text.split()
    if not words:
        return np.empty(0, dtype=np.int64)
    if len(_memo) > _memo.most:
        _memo.clear()
    _memo.new.clear()
    got = list(map(_memo.__getitem__, words))
    if _memo.new:
        for w in _memo.new:
            _memo[w] = _hashes(w)
        got = [x if x.__class__ is int else _memo[x] for x in got]
    both = np.array(got, dtype=np.uint64)
    out = []
    for h in (both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)):
        out += [h * np.uint64(0x9E3779B97F4A7C15), (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9))]
    mixed = np.concatenate(out)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """FTRL-proximal, per coordinate. rows: (columns, values, label). Gives (weights, bias)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    for _ in range(passes):
        for columns, values, label in rows:
            i, x = np.append(columns, bias), np.append(values, 1.0)
            w = _weights(z[i], n[i])
            w[-1] = -z[bias] / ((BETA + np.sqrt(n[bias])) / ALPHA + L2)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    weights = _weights(z[:bias], n[:bias]).astype(np.float32)
    return weights, float(-z[bias] / ((BETA + np.sqrt(n[bias])) / ALPHA + L2))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit_quality(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, passes: int = PASSES) -> tuple[np.ndarray, float]:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, values = [], []
            for text in b.column(2).to_pylist():
                at, times = np.unique(ngram_columns(text), return_counts=True)
                columns.append(at.astype("<i4").tobytes())
                values.append((times * (SCALE / max(1, times.sum()))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(columns, pa.binary()), pa.array(values, pa.binary()), b.column(3)], ["doc_id", "text_hash", "columns", "values", "label"]
            )

    sample = labelled_sample(documents, labels, "quality", max_rows, ~held_out(F.col("_id")))
    sample = sample.select("doc_id", "text_hash", "text", "label")
    got = sample.mapInArrow(features, "doc_id long, text_hash long, columns binary, values binary, label int")
    got = got.withColumn("at", F.xxhash64("doc_id")).toPandas().sort_values(["at", "doc_id", "text_hash"], kind="stable")
    rows = [(np.frombuffer(c, "<i4"), np.frombuffer(v, "<f4"), int(y)) for c, v, y in zip(got["columns"], got["values"], got["label"])]
    return train_ftrl(rows, passes)


def quality_scores(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, held_out, score, predicted)"""
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # 2^BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            eta = np.full(len(texts), bias)
            for k, text in enumerate(texts):
                columns = ngram_columns(text)
                if len(columns):
                    eta[k] += SCALE * float(w[columns].mean(dtype=np.float64))
            score = 1 / (1 + np.exp(-np.clip(eta, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, *fit_quality(docs, table(spark, sf_dir, "labels")))
