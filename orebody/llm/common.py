"""What the corpus operators share: scratch tables, the sum over partitions, labelled samples, bounded memos."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, wherever a contract speaks of words: a run without the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same white space for Java's regular expressions.
JAVA_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where none is set and all runs on this machine (tests), one of our own
    is set: other machines would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back. Lineage ends there: what comes
    after survives a lost executor without computing df again, and sees one version of it. options: of the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_ = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def running_base(counts: DataFrame, part: str, value: str, base: str) -> DataFrame:
    """(part, value) with one row per partition -> (part, base): the sum of value over smaller parts.
    One row per partition of a job is all that the one window task sees."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias(base))


HOT_SHARE = 1_000


def join_split(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left join right on a key that right has once, with right's column `weight`, the rows of left that have the key.
    Keys with over one HOT_SHARE-th of left's `total` rows, so at most HOT_SHARE of them, are joined by broadcast: none
    of them fills a task. All others are shuffled. left and right should be cheap to read twice."""
    hot = right.where(F.col(weight) * HOT_SHARE > total)
    cold = right.where(F.col(weight) * HOT_SHARE <= total)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def plain_names(df: DataFrame) -> tuple[DataFrame, str, str]:
    """df with its columns named c0, c1, ..., which clash with no column added on the way, and what doc_id and text
    are called there ('' where df has none)."""
    new = {c.lower(): f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), new.get("doc_id", ""), new.get("text", "")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, target: str, max_rows: int, only: Column | None = None
) -> DataFrame:
    """At most max_rows labelled texts as (doc_id, text_hash, text, label), in the shared folder: of the max_rows
    labelled ids with the smallest hash, the texts in the order of (hash of the id, id, hash of the text). Rows alike in
    id and text are one, so an id of any number of rows stays within the bound. Of several labels of an id the largest
    counts. Rows without a label, an id or a text are left out. What is broadcast has at most max_rows rows of keys."""
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("_label")).where(
        "_id is not null and _label is not null"
    )
    if only is not None:
        ids = ids.where(only)
    ids = ids.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    docs = documents.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = docs.join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    found = found.groupBy(F.col("_doc").alias("doc_id"), F.xxhash64("text").alias("text_hash")).agg(
        F.first("text").alias("text"), F.first("_label").alias("label")
    )
    found = materialize(found, "labelled")
    if found.count() <= max_rows:
        return found
    keys = found.select("doc_id", "text_hash").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(max_rows)
    return materialize(found.join(F.broadcast(keys), ["doc_id", "text_hash"], "left_semi"), "labelled")


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut where a string or binary column holds `most` bytes, but never within a row: what is made of a
    slice is bounded by that and by the longest row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(at, stop - at)
            at = stop


class Memo(dict):
    """A dict of at most about `most` entries: its user clears it once it is larger, so a worker's memory stays
    bounded, and what was forgotten is computed again. A key that it lacks is noted in `new` and given back."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.new: set = set()

    def __missing__(self, key):
        self.new.add(key)
        return key
