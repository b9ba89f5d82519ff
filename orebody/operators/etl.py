"""Extract, transform, load: a chain of DataFrame steps, and loads that append, replace or upsert."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import cast_lenient, right_closed, strip, whole_days
from ..functions.lineage import cut

log = logging.getLogger(__name__)

# Fixed values of the amount buckets.
AMOUNT_EDGES = (0.0, 100.0, 500.0, 1000.0, float("inf"))
AMOUNT_LABELS = ("low", "medium", "high", "premium")


def columns_of_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def normalize(df: DataFrame) -> DataFrame:
    """Column names stripped, lower-case, spaces to _; white space stripped from strings."""
    df = df.toDF(*(c.strip().lower().replace(" ", "_") for c in df.columns))
    return df.withColumns({c: strip(F.col(c)) for c in columns_of_type(df, T.StringType)})


def clean(df: DataFrame, required: list[str]) -> DataFrame:
    """One of each set of equal rows; none with a null in a required column that the table has."""
    present = [c for c in required if c in df.columns]
    df = df.dropDuplicates()
    return df.dropna(subset=present) if present else df


def cast_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns that the table lacks are skipped."""
    return df.withColumns({c: cast_lenient(F.col(c), k) for c, k in kinds.items() if c in df.columns})


def derive(df: DataFrame, now: Column | None = None, created: str = "signup_date", amount: str = "amount") -> DataFrame:
    now = F.current_timestamp() if now is None else now
    out = df.withColumn("etl_loaded_at", now)
    if created in df.columns:
        out = out.withColumn("account_age_days", whole_days(F.col("etl_loaded_at"), F.col(created).cast("timestamp")))
    if amount in df.columns:
        out = out.withColumn("amount_bucket", right_closed(F.col(amount), AMOUNT_EDGES, AMOUNT_LABELS))
    return out


def validate(df: DataFrame, email: str = "email", amount: str = "amount") -> DataFrame:
    """is_valid: an address contains @ (null does not); an amount is not negative (null is not)."""
    ok = F.lit(True)
    if email in df.columns:
        ok = ok & F.coalesce(F.contains(F.col(email), F.lit("@")), F.lit(False))
    if amount in df.columns:
        ok = ok & ~F.coalesce(F.col(amount) < 0, F.lit(False))
    return df.withColumn("is_valid", ok)


def transform(df: DataFrame, kinds: dict[str, str], required: list[str], now: Column | None = None, cleaned: Observation | None = None) -> DataFrame:
    """cleaned: counts, as `rows`, what is left after cleaning."""
    tidy = df.transform(normalize).transform(clean, required)
    return (
        (tidy.observe(cleaned, F.count("*").alias("rows")) if cleaned else tidy)
        .transform(cast_types, kinds)
        .transform(derive, now)
        .transform(validate)
    )


def upserted(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows whose key the source lacks, and all source rows (repeated keys in the source stay)."""
    if key not in target.columns or key not in source.columns:
        raise ValueError(f"no column {key!r}")
    return target.join(source.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(source)


def duplicate_count(df: DataFrame) -> DataFrame:
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("n_"))
    return rows.agg(F.coalesce(F.sum("n_") - F.count("*"), F.lit(0)).alias("n_duplicates"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, percent), one pass."""
    wide = df.agg(F.count("*").alias("n_"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns))
    return wide.select("n_", F.inline(rows)).select(
        "column", "nulls", F.round(F.try_divide(100.0 * F.col("nulls"), F.col("n_")), 4).alias("percent")
    )


BUCKET = "key_bucket"


def _recover(spark: SparkSession, name: str) -> None:
    """Makes good an upsert that stopped on its way. Merged buckets that were complete are put in place again. Without the
    target, __old is the target's last state and becomes it again. With it, the merged rows have already taken its place,
    and __old is not needed."""
    old, merged = f"{name}__old", f"{name}__merged"
    if spark.catalog.tableExists(merged):
        if spark.catalog.tableExists(name):
            _replace_buckets(spark, name)
        else:
            spark.sql(f"DROP TABLE {merged}")
    if not spark.catalog.tableExists(old):
        return
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE {old}")
    else:
        spark.sql(f"ALTER TABLE {old} RENAME TO {name}")


def _bucketing(spark: SparkSession, name: str) -> tuple[str, int] | None:
    """The key and the number of buckets of a table that was made with them."""
    if not spark.catalog.tableExists(name):
        return None
    held = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return (held["upsert.key"], int(held["upsert.buckets"])) if "upsert.buckets" in held else None


def _in_buckets(df: DataFrame, key: str, buckets: int, kind: str | None = None) -> DataFrame:
    """df with its bucket: of the key as the target holds it, so 2 of any type is in the bucket of 2."""
    held = F.col(key).cast(kind).cast("string") if kind else F.col(key).cast("string")
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(held), F.lit(buckets)).cast("int"))


def _replace_buckets(spark: SparkSession, name: str) -> None:
    """Puts the rows of __merged in the place of their buckets. Doing it twice changes nothing."""
    merged, conf = f"{name}__merged", "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "dynamic")
    try:
        rows = spark.table(merged).select(*spark.table(name).columns)
        rows.hint("rebalance", BUCKET).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(conf, before)
    spark.sql(f"DROP TABLE {merged}")


def _upsert_buckets(df: DataFrame, name: str, key: str, buckets: int) -> int:
    """Merges and rewrites the buckets that hold a key of df; files of other buckets are neither read nor written. The
    merged rows are complete, under a name of their own, before the target is touched."""
    spark = df.sparkSession
    target = spark.table(name)
    source = cut(_in_buckets(df, key, buckets, target.schema[key].dataType.simpleString()))
    touched = [r[BUCKET] for r in source.select(BUCKET).distinct().collect()]  # a row per bucket
    rows = source.count()
    if touched:
        staging, merged = f"{name}__staging", f"{name}__merged"
        upserted(target.where(F.col(BUCKET).isin(touched)), source, key).write.mode("overwrite").saveAsTable(staging)
        spark.sql(f"ALTER TABLE {staging} RENAME TO {merged}")
        _replace_buckets(spark, name)
    return rows


def load(df: DataFrame, name: str, mode: str = "append", key: str | None = None, buckets: int = 0) -> int:
    """Loads into a catalogue table and returns the rows loaded. append and replace are plain writes. upsert needs a
    key; it writes the merged rows once, to a staging table, and renames that to the target. A load that stopped
    between the two renames is made good by the next load of any mode.

    With a key and buckets, a table that is made anew (by replace, or since there is none) is partitioned by key_bucket, a
    hash of the key, and remembers both; an upsert by that key then rewrites the buckets that it touches and no others. A
    bucket should be some gigabytes. An upsert by another key rewrites the table whole and leaves it without buckets."""
    spark = df.sparkSession
    if mode not in ("append", "replace", "upsert"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "upsert" and (key is None or key not in df.columns):
        raise ValueError("upsert needs a key column")
    if buckets and (key is None or key not in df.columns):
        raise ValueError("buckets need a key column")
    if buckets and BUCKET in df.columns:
        raise ValueError(f"a column is named {BUCKET!r}")
    _recover(spark, name)
    held = _bucketing(spark, name)
    anew = mode == "replace" or not spark.catalog.tableExists(name)
    if mode == "upsert" and held and held[0] == key:
        return _upsert_buckets(df, name, *held)
    seen = Observation()
    counted = df.observe(seen, F.count("*").alias("rows"))
    if anew and buckets:
        rows = _in_buckets(counted, key, buckets).hint("rebalance", BUCKET)
        rows.write.mode("overwrite").partitionBy(BUCKET).saveAsTable(name)
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('upsert.key' = '{key}', 'upsert.buckets' = '{buckets}')")
    elif anew:
        counted.write.mode("overwrite").saveAsTable(name)
    elif mode == "append" and held:
        rows = _in_buckets(counted, *held, spark.table(name).schema[held[0]].dataType.simpleString())
        rows.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).saveAsTable(name)
    elif mode == "append":
        counted.write.mode("append").saveAsTable(name)
    else:
        staging, old = f"{name}__staging", f"{name}__old"
        rows = int(df.count())
        upserted(spark.table(name).drop(BUCKET) if held else spark.table(name), df, key).write.mode("overwrite").saveAsTable(staging)
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {staging} RENAME TO {name}")
        spark.sql(f"DROP TABLE {old}")
        return rows
    return int(seen.get["rows"])


@dataclass
class Pipeline:
    """Extract from a named kind of source, transform, load the valid rows, report counts."""

    spark: SparkSession
    readers: dict[str, Callable[..., DataFrame]]
    required: list[str] = field(default_factory=lambda: ["id", "email"])

    def run(
        self, kind: str, source: str, target: str, kinds: dict[str, str], mode: str = "append", key: str | None = None,
        query: str = "SELECT * FROM source", buckets: int = 0,
    ) -> dict[str, float]:
        if kind not in self.readers:
            raise ValueError(f"unknown source kind {kind!r}")
        began = time.monotonic()
        raw = self.readers[kind](self.spark, source, query) if kind == "db" else self.readers[kind](self.spark, source)
        # Counted while the rows are loaded: the source is read once, but for an upsert's own count and join.
        seen, tidy, judged = Observation(), Observation(), Observation()
        rows = transform(raw.observe(seen, F.count("*").alias("rows")), kinds, self.required, cleaned=tidy)
        rows = rows.observe(judged, F.count("*").alias("rows"), F.count_if(~F.col("is_valid")).alias("rejected"))
        loaded = load(rows.where("is_valid"), target, mode, key, buckets)
        stats = {
            "rows_extracted": seen.get["rows"], "rows_cleaned": tidy.get["rows"], "rows_transformed": judged.get["rows"], "rows_rejected": judged.get["rejected"],
            "rows_loaded": loaded, "duration_sec": round(time.monotonic() - began, 3),
        }
        for line in report(stats).splitlines():
            log.info(line)
        return stats


def report(stats: dict[str, float]) -> str:
    """A run's counts, a line for each stage."""
    return "\n".join(f"{name.replace('_', ' '):<18}{value:>14,}" for name, value in stats.items())
