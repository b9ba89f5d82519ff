"""Toxicity by cumulative-link ordinal regression (operator 1).

P(severity > k) = sigmoid(w.x - b_k) for k = 0 .. GRADES-2, with one weight vector w for all ordered thresholds
b_0 < b_1 < ...; the expected severity is the sum of these. x is sparse: how many per PER words of a text a marker term
is, with SMOOTH words added to each text, so that one word of a very short text is not a large share. Counts alone
would grow with a text's length, and a long clean text would pass for a toxic one.

Fitting (on at most `max_rows` labelled documents, those with the smallest hash of doc_id; a documented bound):
1. Terms are lower-case words of any length and word beginnings of 4 to 7 letters. Their shares in the documents are
   summed by label in Spark; the `max_terms` terms that speak most for the label become markers (ties: the smaller term).
2. The label is binary. Grade 0 is label 0; a toxic document's grade 1 .. GRADES-1 is the tercile of its share of
   markers among the toxic ones.
3. w and b are fitted by gradient steps on the sample's sparse shares, w held at 0 or above.

Scoring is one pass over the whole text of every document, however long: a text's memory is that of its words, its
sparse vector has at most `max_terms` entries. A document is toxic if P(severity > 0) >= 0.5.
Null and empty texts have no words and get the model's floor. With no labelled toxic document the model has no
markers and finds nothing toxic. Rows with null or repeated ids are scored each for itself. Further columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, table

GRADES = 4
MAX_ROWS = 8_000
MAX_TERMS = 1_024
SHORTEST, LONGEST = 4, 7  # letters of a word beginning
MIN_DOCUMENTS, MIN_PART = 3, 40  # a marker occurs in at least so many toxic documents, and in one of MIN_PART of them
PER, SMOOTH = 100, 100  # words
LIFT = 1.5  # log of the ratio of a marker's mean shares, at least
_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class SeverityModel:
    terms: dict[str, int]
    weights: np.ndarray
    bounds: np.ndarray

    def starts(self) -> frozenset[str]:
        """The first SHORTEST letters of the terms: a word that begins otherwise has none of them."""
        return frozenset(t[:SHORTEST].removesuffix("$") for t in self.terms)

    def shares(self, text: str, starts: frozenset[str]) -> dict[int, float]:
        """Of every marker in the text how many of PER words it is."""
        found: dict[int, int] = {}
        words = _WORDS.findall(text.lower())
        for word in [w for w in words if w[:SHORTEST] in starts]:
            for term in terms_of(word):
                if (i := self.terms.get(term)) is not None:
                    found[i] = found.get(i, 0) + 1
        return {i: PER * c / (len(words) + SMOOTH) for i, c in found.items()}

    def score(self, texts: list[str]) -> np.ndarray:
        """(texts, GRADES - 1): P(severity > k)."""
        starts = self.starts()
        eta = np.zeros(len(texts))
        for n, text in enumerate(texts):
            if found := self.shares(text, starts):
                eta[n] = sum(self.weights[i] * x for i, x in found.items())
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.bounds, -40, 40)))


def terms_of(word: str) -> set[str]:
    """The word, marked as whole, and its beginnings of SHORTEST to LONGEST letters (shorter words have none)."""
    return {f"{word}$", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))}


def _term_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each term its summed shares by label and the toxic documents that have it."""
    for b in batches:
        shares: tuple[dict, dict] = ({}, {})
        documents: Counter = Counter()
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = Counter(_WORDS.findall(text.lower()))
            own: Counter = Counter()
            for word, c in words.items():
                for term in terms_of(word):
                    own[term] += c
            n, into = words.total() + SMOOTH, shares[label > 0]
            for term, c in own.items():
                into[term] = into.get(term, 0.0) + PER * c / n
            if label > 0:
                documents.update(own.keys())
        terms = list({*shares[0], *shares[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *(pa.array([shares[y].get(t, 0.0) for t in terms], pa.float64()) for y in (1, 0)), pa.array([documents[t] for t in terms], pa.int64())],
            ["term", "toxic", "clean", "documents"],
        )


def fit_bounds_and_weights(rows: list[dict[int, float]], grades: np.ndarray, n_terms: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean negative log-likelihood of the cumulative-link model with a small L2 penalty."""
    x = np.zeros((len(rows), n_terms), dtype=np.float32)
    for n, row in enumerate(rows):
        for i, share in row.items():
            x[n, i] = share
    k = GRADES - 1
    # b_0 and the logs of the gaps between bounds, so that the bounds stay ordered.
    theta = np.concatenate([np.full(n_terms, 0.5), [2.0], np.zeros(k - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(rows)
    for t in range(1, steps + 1):
        w, gaps = theta[:n_terms], np.exp(theta[n_terms + 1 :])
        bounds = theta[n_terms] + np.concatenate([[0], np.cumsum(gaps)])
        above = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32))[:, None] - bounds, -30, 30)))
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = edge * (1 - edge)
        at = np.arange(n)
        p = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-9)
        up, down = slope[at, grades] / p, slope[at, grades + 1] / p
        d_eta = -(up - down) / n
        d_bound = np.zeros(k + 2)
        np.add.at(d_bound, grades, up / n)
        np.add.at(d_bound, grades + 1, -down / n)
        d_bound = d_bound[1:-1]
        tail = np.cumsum(d_bound[::-1])[::-1]
        grad = np.concatenate([x.T @ d_eta.astype(np.float32) + 1e-5 * w, [tail[0]], tail[1:] * gaps])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        theta[:n_terms] = np.maximum(theta[:n_terms], 0)
    return theta[:n_terms], theta[n_terms] + np.concatenate([[0], np.cumsum(np.exp(theta[n_terms + 1 :]))])


def fit_severity(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> SeverityModel:
    sample = labelled_sample(documents, labels, "toxic", max_rows).select("doc_id", "text_hash", "text", "label")
    toxic, rows = sample.agg(F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    none = SeverityModel({}, np.zeros(0), np.arange(GRADES - 1) + 6.0)
    if not toxic:
        return none
    clean = rows - toxic
    shares = sample.select("text", "label").mapInArrow(_term_shares, "term string, toxic double, clean double, documents long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("documents").alias("documents")
    )
    # Sums of floats may differ in their last digits with the order of rows; rounded, the choice does not.
    mean = [F.round((F.col(c) + PER / SMOOTH) / (n + 1.0), 9) for c, n in (("toxic", toxic), ("clean", clean))]
    chosen = (
        shares.where(F.col("documents") >= max(MIN_DOCUMENTS, -(-toxic // MIN_PART)))
        .withColumn("lift", F.log(mean[0] / mean[1]))
        .where(F.col("lift") > LIFT)
        .orderBy(F.desc(F.round(F.col("lift") * F.sqrt("toxic"), 6)), "term")
        .limit(max_terms)
    )
    terms = {r["term"]: i for i, r in enumerate(chosen.select("term").collect())}
    if not terms:
        return none
    draft = SeverityModel(terms, np.zeros(len(terms)), none.bounds)

    def share(texts: pd.Series) -> pd.Series:
        starts = draft.starts()
        return texts.map(lambda t: [float(x) for kv in draft.shares(t, starts).items() for x in kv])

    shared = F.pandas_udf(share, "array<double>")
    # At most max_rows rows of marker shares reach the driver; their order is fixed, so the sums are.
    got = sample.select("doc_id", "text_hash", shared("text").alias("c"), "label").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text_hash"]))
    x = [{int(i): v for i, v in zip(r["c"][::2], r["c"][1::2])} for r in got]
    label = np.array([r["label"] > 0 for r in got])
    mass = np.array([sum(r.values()) for r in x])
    cuts = np.quantile(mass[label], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(label, 1 + np.searchsorted(cuts, mass, side="left"), 0)
    weights, bounds = fit_bounds_and_weights(x, grades, len(terms))
    return SeverityModel(terms, weights, bounds)


def severity(documents: DataFrame, model: SeverityModel) -> DataFrame:
    """(doc_id, score, expected_severity, severity, toxic)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = model.score([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(above[:, 0]),
                    pa.array(above.sum(axis=1)),
                    pa.array((above >= 0.5).sum(axis=1).astype(np.int32)),
                    pa.array((above[:, 0] >= 0.5).astype(np.int32)),
                ],
                ["doc_id", "score", "expected_severity", "severity", "toxic"],
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, expected_severity double, severity int, toxic int")


def drop_toxic(documents: DataFrame, model: SeverityModel) -> DataFrame:
    """The documents whose P(severity > 0) is under 0.5, with all their columns."""

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([t or "" for t in texts.tolist()])[:, 0] < 0.5)

    return documents.where(F.pandas_udf(clean, "boolean")(F.col("text").cast("string")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit_severity(docs, table(spark, sf_dir, "labels")))
