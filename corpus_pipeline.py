"""A training corpus from raw documents, in stages. Each stage's rows are written and read again before the next.

Every stage keeps the columns it is given, whatever their names, but for the last, whose rows are pieces of documents.
Null and empty texts have no words: they pass the toxicity stage and fall to the quality rules. Rows with null or
repeated ids are judged each for itself; of rows alike in text, or in 0.8 of their shingles, the near-duplicates stage
keeps one, with the smallest id (nulls last; then the smallest hash of the text). Texts of any length are read whole. An
empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orebody.llm import near_copies as copies
from orebody.llm import packing, quality_rules, toxicity
from orebody.llm.common import materialize, table
from orebody.llm.tokens import vocabulary


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the severity model, fitted on `labels`, calls toxic; without labels nothing is."""
    return toxicity.drop_toxic(docs, toxicity.fit_severity(docs, table(spark, sf_dir, "labels")))


def rule_failures(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails a rule of the current policy, by its failure bits."""
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of texts alike in 0.8 of their five-word shingles."""
    return copies.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece of a document."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_documents),
    ("quality rules", rule_failures),
    ("near-duplicates", near_copies),
    ("packing", packed),
]

#: Tokenising and model fitting are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
