"""Readers: CSV with every column as text, SQLite queries and JSON over HTTP as Python data sources."""

from __future__ import annotations

import json
import math
import sqlite3
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """With a header. Without a schema all columns are strings; types come from cast_types, not from guessing."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)


class _Rows(DataSourceReader):
    """Rows of a source that filters as far as it can: what is pushed lets through no fewer rows than Spark's own filters,
    which stay."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema, self.names = options, schema, schema.fieldNames()

    def push(self, one: Filter) -> None:
        raise NotImplementedError

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if len(one.attribute if hasattr(one, "attribute") else ()) == 1:
                self.push(one)
            yield one


_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _SqliteReader(_Rows):
    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.where: list[str] = []
        self.values: list = []

    def push(self, one: Filter) -> None:
        """Numbers are compared as Spark holds them. A column read as text may hold other types, which pass."""
        name = one.attribute[0]
        if name not in self.names:
            return
        column, kind = _quoted(name), self.schema[name].dataType.typeName()
        if isinstance(one, (IsNull, IsNotNull)):
            self.where.append(f"{column} IS {'NOT ' if isinstance(one, IsNotNull) else ''}NULL")
            return
        values = list(one.value) if isinstance(one, In) else [getattr(one, "value", None)]
        fits = {"long": int, "double": (int, float), "string": str}.get(kind)
        if not (isinstance(one, In) or type(one) in _COMPARED) or fits is None or not all(isinstance(v, fits) for v in values) or not 0 < len(values) <= 500:
            return
        if kind == "double" and any(v != v for v in values):  # SQLite has no NaN
            return
        column = {"long": column, "double": f"CAST({column} AS REAL)", "string": f"{column} COLLATE BINARY"}[kind]
        test = f"{column} IN ({', '.join('?' * len(values))})" if isinstance(one, In) else f"{column} {_COMPARED[type(one)]} ?"
        self.where.append(f"(typeof({_quoted(name)}) NOT IN ('text', 'null') OR {test})" if kind == "string" else test)
        self.values += values

    def partitions(self) -> list[InputPartition]:
        """Ranges of whole numbers of equal width; the first also takes what is not a whole number."""
        key, parts = self.options.get("key"), int(self.options.get("parts", "1"))
        if not key or parts < 2:
            return [InputPartition(("1", ()))]
        name = _quoted(key)
        with sqlite3.connect(self.options["path"]) as db:
            lo, hi = db.execute(f"SELECT min({name}), max({name}) FROM ({self.options['query']}) WHERE typeof({name}) = 'integer'").fetchone()
        if lo is None:
            return [InputPartition(("1", ()))]
        edges = sorted({lo + (hi - lo + 1) * i // parts for i in range(parts)})
        out = []
        for i, low in enumerate(edges):
            tests, values = [], []
            if i:
                tests, values = [f"{name} >= ?"], [low]
            if i + 1 < len(edges):
                tests, values = [*tests, f"{name} < ?"], [*values, edges[i + 1]]
            whole = " AND ".join([f"typeof({name}) = 'integer'", *tests])
            out.append(InputPartition((whole if i else f"({whole} OR typeof({name}) <> 'integer')", tuple(values))))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        share, bounds = partition.value
        as_text = [f.dataType.typeName() == "string" for f in self.schema.fields]
        query = f"SELECT * FROM ({self.options['query']}) WHERE {' AND '.join([share, *self.where])}"
        with sqlite3.connect(self.options["path"]) as db:
            for row in db.execute(query, (*bounds, *self.values)):
                yield tuple(x if x is None or not t else x.decode(errors="replace") if isinstance(x, bytes) else str(x) for x, t in zip(row, as_text))


class SqliteSource(DataSource):
    """A query's rows, typed by what its columns hold: integers, numbers, blobs, or else text. The file must be on a
    folder that the executors share. With `key`, a column of whole numbers, the rows are read in `parts` ranges of it; of a
    table's rowid a range is found without a scan. Comparisons, IN and tests for null are pushed into the query."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_query"

    def schema(self) -> StructType:
        out = StructType()
        with sqlite3.connect(self.options["path"]) as db:
            query = self.options["query"]
            for (name, *_) in db.execute(f"SELECT * FROM ({query}) LIMIT 0").description:
                quoted = _quoted(name)
                held = {r[0] for r in db.execute(f"SELECT DISTINCT typeof({quoted}) FROM ({query})")} - {"null"}
                kinds = (({"integer"}, "long"), ({"integer", "real"}, "double"), ({"blob"}, "binary"))
                out = out.add(name, next((kind for of, kind in kinds if held and held <= of), "string"))
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def json_records(body: str) -> list[dict]:
    """A list as it is, the list under "results", or one object."""
    data = json.loads(body)
    if isinstance(data, list):
        return data
    return data["results"] if isinstance(data, dict) and "results" in data else [data]


class _RestReader(_Rows):
    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.asked: dict[str, str] = {}

    def push(self, one: Filter) -> None:
        if isinstance(one, EqualTo) and isinstance(one.value, str) and one.attribute[0] in json.loads(self.options.get("filters", "[]")):
            self.asked[one.attribute[0]] = one.value

    def partitions(self) -> list[InputPartition]:
        first, pages = int(self.options.get("first_page", "1")), int(self.options.get("pages", "0"))
        return [InputPartition(first + n) for n in range(pages)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        params = json.loads(self.options.get("params", "{}")) | self.asked
        if partition.value is not None:
            params[self.options.get("page_param", "page")] = partition.value
        url = self.options["url"] + ("?" + urllib.parse.urlencode(params) if params else "")
        with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", "30"))) as answer:
            for record in json_records(answer.read().decode()):
                yield tuple(None if record.get(n) is None else str(record[n]) for n in self.names)


class RestSource(DataSource):
    """JSON over HTTP; the schema is the caller's. An HTTP error fails the read. With `pages`, each page is a partition of
    its own. Equality with a text, on a column named in `filters`, is asked of the server as well."""

    @classmethod
    def name(cls) -> str:
        return "rest_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RestReader(self.options, schema)


def _register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_sqlite(spark: SparkSession, path: str, query: str = "SELECT * FROM source", key: str | None = None, parts: int = 1) -> DataFrame:
    _register(spark, SqliteSource)
    reader = spark.read.format("sqlite_query").option("path", path).option("query", query).option("parts", parts)
    return (reader.option("key", key) if key else reader).load()


def read_rest(
    spark: SparkSession, url: str, schema: str, params: dict | None = None, pages: int = 0, page_param: str = "page", first_page: int = 1, filters: list[str] | None = None
) -> DataFrame:
    """filters: columns that the server takes as parameters of the same name."""
    _register(spark, RestSource)
    reader = spark.read.format("rest_json").schema(schema).option("url", url).option("params", json.dumps(params or {}))
    return reader.option("pages", pages).option("page_param", page_param).option("first_page", first_page).option("filters", json.dumps(filters or [])).load()


def weather(spark: SparkSession, hours: int = 1000, seed: int = 42, null_share: float = 0.08) -> DataFrame:
    """Synthetic hourly weather from 2023-01-01: temperature and humidity follow the month, rain falls in moist hours;
    about null_share of five columns is missing, 15, 10 and 8 values are spikes, and 20 random rows come twice. In order of time."""
    from pyspark.sql import functions as F

    # Drawn from hashes of the hour's number, so that a value does not depend on the partition it is made in.
    u = lambda k: F.shiftrightunsigned(F.xxhash64("id", F.lit(seed + k)), 11) / float(1 << 53)
    normal = lambda k: F.sqrt(-2 * F.log(1 - u(100 + k))) * F.cos(2 * math.pi * u(200 + k))
    picked = lambda k, n: base.select("id").orderBy(F.xxhash64("id", F.lit(seed + k))).limit(n)
    one_of = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(u(k) * len(v)) + 1).cast("int"))
    hour = F.expr("timestamp'2023-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))")
    base = spark.range(hours).select("id", hour.alias("timestamp"))
    month, share = F.month("timestamp"), u(6)
    # Fixed values of the data set: levels, spreads, shares of the conditions.
    rows = base.select(
        "id", "timestamp",
        (15 + 10 * F.sin((month - 3) * F.pi() / 6) + 4 * normal(0)).alias("temperature"),
        F.greatest(F.lit(10.0), F.least(F.lit(100.0), 60 + 15 * F.sin(month * F.pi() / 6) + 10 * normal(1))).alias("humidity"),
        (12 * F.sqrt(-F.log(1 - u(2)))).alias("wind_speed"),
        (1013 + 8 * normal(3)).alias("pressure"),
        (-3 * F.log(1 - u(4))).alias("rainfall"),
        F.greatest(F.lit(0.0), F.least(F.lit(20.0), 10 + 3 * normal(5))).alias("visibility"),
        share.alias("share"),
        F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "autumn"))), F.ceil(month / 3).cast("int")).alias("season"),
        one_of(7, "N", "NE", "E", "SE", "S", "SW", "W", "NW").alias("wind_direction"),
    )
    rows = rows.withColumn("rainfall", F.when(F.col("humidity") > 75, F.col("rainfall")).otherwise(0.0))
    kinds = (("sunny", 0.35), ("cloudy", 0.65), ("rainy", 0.85), ("foggy", 0.95))
    condition = F.lit("stormy")
    for name, upto in reversed(kinds):
        condition = F.when(F.col("share") < upto, name).otherwise(condition)
    rows = rows.withColumn("weather_condition", condition).drop("share")
    spikes = {"temperature": (15, one_of(30, 65.0, -50.0, 80.0)), "wind_speed": (10, 120 + 80 * u(31)), "humidity": (8, one_of(32, 110.0, 150.0, -5.0))}
    for k, c in enumerate(("temperature", "humidity", "wind_speed", "pressure", "visibility")):
        rows = rows.withColumn(c, F.when(u(10 + k) >= null_share, F.round(c, 1)))
        if c in spikes:
            n, value = spikes[c]
            rows = rows.join(F.broadcast(picked(k, n).withColumn("spike", value)), "id", "left")  # n rows
            rows = rows.withColumn(c, F.coalesce("spike", c)).drop("spike")
    rows = rows.withColumn("rainfall", F.round("rainfall", 1))
    names = ["timestamp", "temperature", "humidity", "wind_speed", "pressure", "rainfall", "visibility", "weather_condition", "season", "wind_direction"]
    return rows.unionByName(rows.join(F.broadcast(picked(99, 20)), "id", "left_semi")).select(*names).orderBy("timestamp")
