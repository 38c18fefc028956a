"""SQLite snapshots as a Spark data source: current and legacy schemas, several
databases at once."""

from __future__ import annotations

import sqlite3
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import text
from ..session import ship

RUNS = "run_id string, team string, suite_name string, build_no int, timestamp string, duration_s double, total int, passed int, failed int, pass_rate_pct double, environment string, executor string"
RESULTS = "result_id string, run_id string, team string, suite_name string, run_timestamp string, run_pass_rate double, test_name string, status string, duration_s double, failure_msg string, failure_kw string, tags string"

#: Fixed: projections of the two schemas onto the canonical columns.
SQL = {
    ("runs", "v2"): "SELECT run_id, team, suite_name, build_no, timestamp, COALESCE(duration_s, 0), total, passed, failed, pass_rate_pct, environment, executor FROM runs",
    ("runs", "v1"): "SELECT CAST(run_id AS TEXT), 'TeamAlpha', 'Suite_Regression_TeamAlpha', build_number, timestamp, 0.0, total_tests, passed, failed, pass_rate, environment, executor FROM runs",
    ("results", "v2"): "SELECT t.result_id, t.run_id, r.team, t.suite_name, r.timestamp, r.pass_rate_pct, t.test_name, t.status, COALESCE(t.duration_s, 0), t.failure_msg, t.failure_kw, t.tags FROM test_results t JOIN runs r ON t.run_id = r.run_id",
    ("results", "v1"): "SELECT CAST(t.test_id AS TEXT), CAST(t.run_id AS TEXT), 'TeamAlpha', 'Suite_Regression_TeamAlpha', r.timestamp, r.pass_rate, t.test_name, t.status, COALESCE(t.duration, 0), f.message, f.keyword_name, '[]' "
    "FROM tests t JOIN runs r ON t.run_id = r.run_id JOIN test_results x ON x.test_id = t.test_id LEFT JOIN failures f ON f.test_id = t.test_id",
}


#: Tables whose rows the queries above go through, by which they can be cut.
DRIVING = {("runs", "v2"): "runs", ("runs", "v1"): "runs", ("results", "v2"): "test_results t", ("results", "v1"): "tests t"}
#: Rows of a slice, about.
SLICE_ROWS = 250_000


class _Range(InputPartition):
    """Row ids from low up to high, all where there are none."""

    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """``format("pulsegrid_sqlite")`` with options path, query and, where the query
    is to be cut, from and slices: ``from`` names the table, with its alias, that
    the query goes through, and each slice asks for a range of its row ids, so no
    slice reads another's rows. The file must be readable by the executors; the
    query has no WHERE of its own then."""

    @classmethod
    def name(cls) -> str:
        return "pulsegrid_sqlite"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.query, self.types = options["path"], options["query"], [f.dataType.typeName() for f in schema]
        self.table, _, self.alias = options.get("from", "").partition(" ")
        self.slices = int(options.get("slices", "0"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        if not self.table:
            return [_Range(None, None)]
        with self._open() as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids
                return [_Range(None, None)]
        if low is None:
            return [_Range(None, None)]
        n = self.slices or -(-(high - low + 1) // SLICE_ROWS)
        cut = [low + (high + 1 - low) * k // n for k in range(n + 1)]
        return [_Range(a, z) for a, z in zip(cut, cut[1:]) if z > a]

    def read(self, partition: _Range):
        cast = {"string": str, "double": float, "integer": int, "long": int}
        makers = [cast.get(t, lambda v: v) for t in self.types]
        ranged, bounds = "", ()
        if partition.low is not None:
            row = f"{self.alias or self.table}.rowid"
            ranged, bounds = f" WHERE {row} >= ? AND {row} < ?", (partition.low, partition.high)
        with self._open() as db:
            for row in db.execute(self.query + ranged, bounds):
                yield tuple(None if v is None else f(v) for f, v in zip(makers, row, strict=True))


def scan(spark: SparkSession, path: str, query: str, schema: str, table: str = "", slices: int = 0) -> DataFrame:
    """``table`` names what the query goes through, with its alias; without it, one
    task reads all. ``slices`` of 0 makes as many as the table's size asks for."""
    ship(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("pulsegrid_sqlite").schema(schema).option("path", path).option("query", query).option("from", table).option("slices", slices).load()


def table_names(path: str) -> set[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def variant(path: str) -> str:
    """v1 has both a tests and a failures table."""
    return "v1" if {"tests", "failures"} <= table_names(path) else "v2"


def read_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Canonical (runs, results) of one database, NaN as null, labelled with the
    file's stem."""
    v, label = variant(path), F.lit(Path(path).stem)

    def of(kind: str, schema: str, *times: str) -> DataFrame:
        t = scan(spark, path, SQL[kind, v], schema, DRIVING[kind, v]).withColumn("_source_db", label)
        doubles = {f.name: F.nanvl(f.name, F.lit(None).cast("double")) for f in t.schema if f.dataType.typeName() == "double"}
        return t.withColumns(doubles | {c: text.parse_issue_time(c) for c in times})

    return of("runs", RUNS, "timestamp"), of("results", RESULTS, "run_timestamp")


def read_databases(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """All databases that can be read, one row per key and source, and the errors
    of those that cannot; missing files are skipped."""
    frames, errors = [], {}
    for p in paths:
        if not Path(p).exists():
            continue
        try:
            frames.append(read_database(spark, p))
        except (sqlite3.Error, KeyError) as e:
            errors[p] = str(e)
    if not frames:
        empty = spark.createDataFrame([], RUNS + ", _source_db string"), spark.createDataFrame([], RESULTS + ", _source_db string")
        return *empty, errors
    runs, results = (reduce(DataFrame.unionByName, f) for f in zip(*frames, strict=True))
    return runs.dropDuplicates(["run_id", "_source_db"]), results.dropDuplicates(["result_id", "_source_db"]), errors


#: Fixed: other names under which loose inputs carry canonical columns.
ALIASES = {"build_number": "build_no", "total_tests": "total", "pass_rate": "pass_rate_pct", "duration": "duration_s", "message": "failure_msg", "keyword_name": "failure_kw"}


def standard_names(frame: DataFrame) -> DataFrame:
    """Renames aliases where the canonical name is missing."""
    for old, new in ALIASES.items():
        if old in frame.columns and new not in frame.columns:
            frame = frame.withColumnRenamed(old, new)
    return frame


def with_run_columns(results: DataFrame, runs: DataFrame) -> DataFrame:
    """run_timestamp and build_no by run and source, so that equal run ids of two
    databases do not meet."""
    r = runs.select("run_id", "_source_db", F.col("timestamp").alias("run_timestamp"), "build_no").dropDuplicates(["run_id", "_source_db"])
    return results.drop("run_timestamp", "build_no").join(r, ["run_id", "_source_db"], "left")
