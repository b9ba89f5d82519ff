"""Sources in partitions, with filters pushed down."""

import http.server
import json
import sqlite3
import threading
import urllib.parse
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull
from pyspark.sql.types import StructType

from orebody.sources import readers


@pytest.fixture
def path(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE source (id INTEGER, x REAL, name TEXT COLLATE NOCASE, mixed)")
        rows = [(i, i / 4, "ab"[i % 2], i if i % 3 else str(i)) for i in range(-50, 150)]
        rows += [(None, 1.0, "A", None), (None, None, None, b"z"), (2**53 + 1, 2**53 + 1, "a", 1.5)]
        db.executemany("INSERT INTO source VALUES (?, ?, ?, ?)", rows)
    return path


def test_ranges(spark, path):
    whole = readers.read_sqlite(spark, path)
    dealt = readers.read_sqlite(spark, path, "SELECT rowid AS row, * FROM source", "row", 6)
    per_part = Counter(r["p"] for r in dealt.select(F.spark_partition_id().alias("p")).collect())
    assert len(per_part) == 6 and max(per_part.values()) - min(per_part.values()) <= 1
    assert Counter(map(tuple, dealt.drop("row").collect())) == Counter(map(tuple, whole.collect()))
    by_id = readers.read_sqlite(spark, path, key="id", parts=4)  # nulls go to the first range
    assert by_id.rdd.getNumPartitions() == 4 and Counter(map(tuple, by_id.collect())) == Counter(map(tuple, whole.collect()))
    assert readers.read_sqlite(spark, path, "SELECT * FROM source WHERE 0", "id", 4).count() == 0
    assert readers.read_sqlite(spark, path, "SELECT 7 AS id", "id", 4).collect()[0][0] == 7


@pytest.mark.parametrize("test", [
    "id = 7", "id > 100 and x < 30", "id in (1, 2, 500)", "id is null", "x is not null and x >= 30.25", "name = 'a'", "name > 'A'", "mixed = '4'",
    "mixed = '1.5'", "mixed in ('3', '4', 'z')", "id = 7 or x = 2", "not id = 7", "x = 9007199254740992", "mixed is null", "name like 'a%'", "id > 1.5",
])
def test_pushed_filters_change_no_rows(spark, path, test):
    rows = readers.read_sqlite(spark, path, key="id", parts=3)
    kept = spark.createDataFrame(rows.collect(), rows.schema).where(test)
    assert Counter(map(tuple, rows.where(test).collect())) == Counter(map(tuple, kept.collect()))


def test_filters_reach_sqlite(path):
    """The reader itself gives out only what passes."""
    schema = StructType().add("id", "long").add("x", "double").add("name", "string").add("mixed", "string")

    def read(*filters):
        reader = readers._SqliteReader({"path": path, "query": "SELECT * FROM source", "key": "id", "parts": "5"}, schema)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [row for part in reader.partitions() for row in reader.read(part)]

    assert len(read()) == 203 and [r[0] for r in read(EqualTo(("id",), 7))] == [7]
    assert {r[0] for r in read(In(("id",), (1, 2, 900)))} == {1, 2} and len(read(GreaterThan(("x",), 37.0))) == 2
    assert {r[2] for r in read(EqualTo(("name",), "a"))} == {"a"} and len(read(IsNotNull(("id",)))) == 201
    assert len(read(EqualTo(("other",), 1))) == 203 and len(read(EqualTo(("id",), "7"))) == 203


def test_pages(spark):
    seen = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            seen.append(asked)
            page = int(asked.get("page", 0))
            rows = [{"id": page * 10 + i, "kind": "ab"[i % 2], "other": "x"} for i in range(4)]
            body = json.dumps([r for r in rows if asked.get("kind", r["kind"]) == r["kind"]]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/rows"
    rows = readers.read_rest(spark, url, "id string, kind string, other string", {"k": "v"}, pages=3, filters=["kind"])
    assert rows.rdd.getNumPartitions() == 3
    assert sorted(int(r["id"]) for r in rows.collect()) == [p * 10 + i for p in (1, 2, 3) for i in range(4)]
    assert sorted(a["page"] for a in seen[-3:]) == ["1", "2", "3"] and all(a["k"] == "v" for a in seen)
    seen.clear()
    assert sorted(int(r["id"]) for r in rows.where("kind = 'b' and other = 'x'").collect()) == [11, 13, 21, 23, 31, 33]
    assert len(seen) == 3 and all(a["kind"] == "b" and "other" not in a for a in seen)
    server.shutdown()
