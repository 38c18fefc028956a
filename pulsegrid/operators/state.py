"""Upserts, logs and versioned table writes without a table format.

A table is a folder of immutable Parquet snapshots; a write stages the new
snapshot beside the old ones and then moves a pointer, so a table can be
rewritten from itself and a failed write leaves it as it was. Tables of a ledger
move together and grow by segments: one version file names those of all of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _one_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """``table`` and those ``rows`` whose key it lacks, one per key."""
    new = _one_per_key(rows, keys, order) if order else rows.dropDuplicates(keys)
    return table.unionByName(new.join(table.select(*keys).distinct(), keys, "left_anti"))


def insert_replace(table: DataFrame, rows: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """``rows`` and those of ``table`` whose key they lack."""
    new = _one_per_key(rows, keys, order) if order else rows.dropDuplicates(keys)
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def missing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


class Table:
    """A snapshot table at ``root`` in any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str]):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        at = self._Path(f"{self.root}/current")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self) -> DataFrame:
        """The latest snapshot, or no rows."""
        held = self._pointers()
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/data/{held[-1]}")

    def overwrite(self, rows: DataFrame) -> DataFrame:
        held = self._pointers()
        name = f"{len(held) and int(held[-1].split('-')[0]) + 1:010d}-{uuid.uuid4().hex[:8]}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.root}/data/{name}")
        self._fs.mkdirs(self._Path(f"{self.root}/current"))
        self._fs.create(self._Path(f"{self.root}/current/{name}"), False).close()
        for old in held[:-1]:  # the snapshot before stays for readers under way
            self._fs.delete(self._Path(f"{self.root}/current/{old}"), False)
            self._fs.delete(self._Path(f"{self.root}/data/{old}"), True)
        return self.read()

    def ignore(self, rows: DataFrame) -> dict[str, int]:
        """INSERT OR IGNORE; returns how many rows went in and how many not."""
        before = self.read()
        offered, had = rows.count(), before.count()
        now = self.overwrite(insert_ignore(before, rows.select(*self.schema.names), self.keys)).count()
        return {"inserted": now - had, "skipped": offered - (now - had)}

    def replace(self, rows: DataFrame) -> DataFrame:
        """INSERT OR REPLACE."""
        return self.overwrite(insert_replace(self.read(), rows.select(*self.schema.names), self.keys))

    def clear(self) -> DataFrame:
        return self.overwrite(self.spark.createDataFrame([], self.schema))


#: Segments of a table before small ones at its end are merged, how often a
#: change is computed anew when other writers come first, and versions that stay
#: for readers under way.
SEGMENTS, ATTEMPTS, VERSIONS = 8, 8, 3
#: A segment is merged with those behind it that together have a share of its rows.
TIER = 4


class Conflict(RuntimeError):
    """Another writer changed what this change was computed from."""


@dataclass(frozen=True)
class Snapshot:
    """A version of a ledger: its number, 0 before the first, and the segments of
    every table, oldest first. A segment names a folder of rows, their number and
    the folders of keys, each with its columns, whose rows in older segments it
    takes back."""

    number: int
    tables: dict[str, list[dict]]

    def segments(self, table: str) -> list[dict]:
        return self.tables.get(table, [])


class Ledger:
    """Tables below one root, in any Hadoop file system whose rename fails where
    the target exists. A version is a small file that names the segments of every
    table; a change of several tables is one version, so readers see all of it or
    nothing.

    A change appends segments and writes no more than itself; :meth:`compact`
    merges segments at the end of a table so that each is larger than a share of
    what follows, which rewrites a row a logarithmic number of times.

    A change is computed from a snapshot and committed with it: where one of its
    tables, or of the tables it read, has changed since, it is refused as a
    :class:`Conflict`; where others have, it is put on top of them."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _numbers(self) -> list[int]:
        at = self._path("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The latest version, or the one of that number."""
        if number is None:
            number = max(self._numbers(), default=0)
        if not number:
            return Snapshot(0, {})
        text = self.spark.read.text(f"{self.root}/versions/{number:010d}.json", wholetext=True).first()[0]
        return Snapshot(number, json.loads(text))

    def read(self, table: str, at: Snapshot | None = None) -> DataFrame:
        """The rows of a table in the latest version, or in a given one."""
        return self._merged(table, (at or self.snapshot()).segments(table))

    def _merged(self, table: str, segments: list[dict]) -> DataFrame:
        schema = self.schemas[table]
        if not segments:
            return self.spark.createDataFrame([], schema)

        def folder(path: str, kind: StructType) -> DataFrame:
            return self.spark.read.schema(kind).parquet(f"{self.root}/{path}")

        taken: dict[tuple[str, ...], list[DataFrame]] = {}
        for k, s in enumerate(segments):
            for path, on in s["keys"] if k else ():
                taken.setdefault(tuple(on), []).append(folder(path, StructType([schema[c] for c in on])).withColumn("_last", F.lit(k)))
        if not taken:
            return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['rows']}" for s in segments])
        rows = reduce(DataFrame.unionByName, [folder(s["rows"], schema).withColumn("_seq", F.lit(k)) for k, s in enumerate(segments)])
        for on, found in taken.items():
            last = reduce(DataFrame.unionByName, found).groupBy(*on).agg(F.max("_last").alias("_last"))
            rows = rows.join(last, list(on), "left").filter("_last is null or _seq >= _last").drop("_last")
        return rows.select(*schema.names)

    def stage(self, table: str, rows: DataFrame, names: list[str] | None = None) -> str:
        """Writes rows, or the given columns of them, beside the table."""
        path = f"{table}/{uuid.uuid4().hex[:12]}"
        fields = [f for f in self.schemas[table] if names is None or f.name in names]
        rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(f"{self.root}/{path}")
        return path

    def segment(self, table: str, rows: DataFrame) -> dict:
        """A staged segment that takes nothing back."""
        path = self.stage(table, rows)
        return {"rows": path, "n": self.spark.read.parquet(f"{self.root}/{path}").count(), "keys": []}

    def taking_back(self, table: str, segment: dict, keys: DataFrame, on: list[str]) -> dict:
        """The segment, taking back older rows of the given keys, if there are any."""
        return segment if keys.isEmpty() else segment | {"keys": [[self.stage(table, keys, on), on]]}

    def commit(self, base: Snapshot, changes: dict[str, list[dict]], reads: Iterable[str] = ()) -> Snapshot:
        """Makes the given segments those of their tables, all at once; they were
        computed from ``base``. Refused where any of these tables or of ``reads``
        is another than in ``base``."""
        while True:
            now = self.snapshot()
            for table in {*changes, *reads}:
                if now.segments(table) != base.segments(table):
                    raise Conflict(f"{table} changed between versions {base.number} and {now.number}")
            new = Snapshot(now.number + 1, now.tables | changes)
            if self._published(new):
                self._forget()
                return new

    def _published(self, new: Snapshot) -> bool:
        """Whether the version is there by this writer's doing."""
        aside, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{new.number:010d}.json")
        self._fs.mkdirs(self._path("versions"))
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(new.tables).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, final, none)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True

    def _forget(self) -> None:
        """Drops versions beyond the last few and the folders that only they name.
        What is staged and not committed is in no version, so it stays."""
        numbers = self._numbers()
        old, kept = numbers[:-VERSIONS], numbers[-VERSIONS:]

        def folders(number: int) -> set[str]:
            held = [s for t in self.snapshot(number).tables.values() for s in t]
            return {s["rows"] for s in held} | {k for s in held for k, _ in s["keys"]}

        live = set().union(*map(folders, kept)) if old else set()
        for number in old:
            for path in folders(number) - live:
                self._fs.delete(self._path(path), True)
            self._fs.delete(self._path(f"versions/{number:010d}.json"), False)

    def changed(self, make: Callable[[Snapshot], dict[str, list[dict]]], reads: Iterable[str] = ()) -> Snapshot:
        """Commits what ``make`` computes from the latest version, computing it anew
        where another writer came first."""
        for last in range(ATTEMPTS):
            base = self.snapshot()
            try:
                return self.commit(base, make(base), reads)
            except Conflict:
                if last == ATTEMPTS - 1:
                    raise
        raise AssertionError

    def compact(self, table: str) -> bool:
        """Merges segments at the end of a table that has many; whether it did. A
        change that comes meanwhile goes before: the merge is then left to the
        next time."""
        base = self.snapshot()
        held = base.segments(table)
        first, total = len(held) - 1, held[-1]["n"] if held else 0
        while first > 0 and held[first - 1]["n"] <= TIER * total:
            first -= 1
            total += held[first]["n"]
        if len(held) < SEGMENTS or len(held) - first < 2:
            return False
        merged = self.segment(table, self._merged(table, held[first:]))
        if first:
            merged["keys"] = [k for s in held[first:] for k in s["keys"]]
        try:
            self.commit(base, {table: [*held[:first], merged]})
        except Conflict:
            return False
        return True


class LedgerTable(Table):
    """A table of a ledger, changed by itself. Every change is computed from the
    version it is committed on, so two writers lose nothing to each other."""

    def __init__(self, ledger: Ledger, name: str, keys: list[str]):
        self.ledger, self.name, self.keys = ledger, name, keys
        self.spark, self.schema = ledger.spark, ledger.schemas[name]

    def read(self) -> DataFrame:
        return self.ledger.read(self.name)

    def overwrite(self, rows: DataFrame, base: Snapshot | None = None) -> DataFrame:
        """``rows`` instead of the table; refused if they were computed from ``base``
        and the table has changed since."""
        made = [self.ledger.segment(self.name, rows)]
        if base is not None:
            self.ledger.commit(base, {self.name: made})
        else:
            self.ledger.changed(lambda now: {self.name: made})
        return self.read()

    def ignore(self, rows: DataFrame) -> dict[str, int]:
        """INSERT OR IGNORE; returns how many rows went in and how many not."""
        offered = rows.select(*self.schema.names).dropDuplicates(self.keys).persist()
        put = {}

        def made(now: Snapshot) -> dict[str, list[dict]]:
            put["segment"] = self.ledger.segment(self.name, missing(offered, self.ledger.read(self.name, now), self.keys))
            return {self.name: [*now.segments(self.name), put["segment"]]}

        self.ledger.changed(made)
        offered.unpersist()
        self.ledger.compact(self.name)
        return {"inserted": put["segment"]["n"], "skipped": rows.count() - put["segment"]["n"]}

    def replace(self, rows: DataFrame) -> DataFrame:
        """INSERT OR REPLACE."""
        made = self.ledger.segment(self.name, rows.dropDuplicates(self.keys))
        new = self.spark.read.schema(self.schema).parquet(f"{self.ledger.root}/{made['rows']}").select(*self.keys)

        def changes(now: Snapshot) -> dict[str, list[dict]]:
            held = new.join(self.ledger.read(self.name, now).select(*self.keys), self.keys, "left_semi")
            return {self.name: [*now.segments(self.name), self.ledger.taking_back(self.name, made, held, self.keys)]}

        self.ledger.changed(changes)
        self.ledger.compact(self.name)
        return self.read()
