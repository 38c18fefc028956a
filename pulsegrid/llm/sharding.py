"""Shards with size-tiered compaction and an atomically versioned manifest.

An arrival is appended as a run: a folder of small immutable Parquet shards.
Compaction puts runs into tiers by the logarithm of their shards' size; a tier
with at least FANOUT shards is merged into one run of target-sized files. Every
change is a new manifest version that is written aside and renamed into place,
and the rename fails if another writer got there first, so readers see whole
versions only; a writer that comes second puts its change on top of the other's.
Merging never shuffles: files of a tier are read side by side and coalesced.

A manifest has one entry for each run, whatever number of shards it holds, and
runs are read as folders, so the driver keeps nothing for each shard. Atomic
versions need a file system whose rename fails where the target exists, as HDFS
and local ones do; on an object store, a commit service must stand in for it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import drop, new_path

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Versions that a vacuum leaves, for readers under way.
KEEP = 2
#: Changes of other writers that one commit is put on top of before it gives up.
RETRIES = 20
_SMALLEST = 1 << 16


@dataclass(frozen=True)
class Run:
    path: str  # below the store's root
    shards: int
    rows: int
    bytes: int


class StaleVersion(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """A folder of runs and manifests, in any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    # --- manifest ---------------------------------------------------------

    def version(self) -> int:
        """The latest committed version, 0 before the first."""
        at = self._path("manifests")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> tuple[int, StructType | None, list[Run]]:
        v = self.version() if version is None else version
        if not v:
            return 0, None, []
        text = self.spark.read.text(f"{self.root}/manifests/v{v:010d}.json", wholetext=True).first()[0]
        held = json.loads(text)
        return v, StructType.fromJson(held["schema"]), [Run(**s) for s in held["runs"]]

    def _commit(self, base: int, schema: StructType, runs: list[Run]) -> int:
        aside, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{base + 1:010d}.json")
        body = json.dumps({"version": base + 1, "schema": schema.jsonValue(), "runs": [asdict(r) for r in sorted(runs, key=lambda r: r.path)]})
        self._fs.mkdirs(self._path("manifests"))
        out = self._fs.create(aside, True)
        out.write(bytearray(body.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, final, none)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                raise StaleVersion(f"version {base + 1} is there already") from e
            raise
        return base + 1

    def _change(self, schema: StructType, change: Callable[[list[Run]], list[Run] | None]) -> int:
        """Commits what ``change`` makes of the latest runs, again where another
        writer came first; 0 if it makes nothing of them."""
        for _ in range(RETRIES):
            base, known, runs = self.manifest()
            if known is not None and known != schema:
                raise ValueError("an arrival must have the columns of the store")
            new = change(runs)
            if new is None:
                return 0
            try:
                return self._commit(base, schema, new)
            except StaleVersion:
                continue
        raise StaleVersion(f"other writers came first {RETRIES} times")

    # --- runs -------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str, rows_per_file: int = 0) -> Run:
        folder = f"{kind}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{self.root}/{folder}")
        name, size = F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")
        files = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").select(name, size).groupBy("f", "s").agg(F.count("*").alias("n"))
        shards, rows, held = files.agg(F.count("*"), F.sum("n"), F.sum("s")).first()
        return Run(folder, shards, rows or 0, held or 0)

    def append(self, df: DataFrame, rows_per_file: int = 0) -> int:
        """Adds an arrival as a run of shards, one or more for each of its
        partitions; returns the new version."""
        v, schema, _ = self.manifest()
        if schema is not None and schema != df.schema:
            raise ValueError("an arrival must have the columns of the store")
        run = self._write(df, f"v{v + 1:07d}-arrival", rows_per_file)
        return self._change(df.schema, lambda runs: [*runs, run])

    def tier(self, run: Run) -> int:
        return int(math.log(max(run.bytes / max(run.shards, 1), _SMALLEST) / _SMALLEST, self.fanout) + 1e-9)

    def full(self, run: Run) -> bool:
        return run.bytes >= run.shards * self.target / 2

    def plan(self, runs: list[Run]) -> list[list[Run]]:
        """Runs of similarly sized shards that are due: every tier that holds at
        least ``fanout`` shards below half of the target."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            if r.shards and not self.full(r):
                tiers.setdefault(self.tier(r), []).append(r)
        return [sorted(t, key=lambda r: r.path) for _, t in sorted(tiers.items()) if sum(r.shards for r in t) >= self.fanout]

    def compact(self) -> int:
        """Merges until no tier is due; old runs stay until :meth:`vacuum`."""
        while True:
            base, schema, runs = self.manifest()
            due = self.plan(runs)
            if not due:
                return base
            for some in due:
                files = max(1, round(sum(r.bytes for r in some) / self.target))
                merged = self.spark.read.schema(schema).parquet(*[f"{self.root}/{r.path}" for r in some]).coalesce(files)
                new = self._write(merged, f"v{base + 1:07d}-tier{self.tier(some[0])}")
                if new.rows != sum(r.rows for r in some):
                    raise RuntimeError("a merge must keep every row")

                def swap(now: list[Run], some=some, new=new) -> list[Run] | None:
                    return [r for r in now if r not in some] + [new] if set(some) <= set(now) else None

                if not self._change(schema, swap):  # another writer has merged them
                    drop(self.spark, f"{self.root}/{new.path}")

    def vacuum(self, keep: int = KEEP, least_age_s: float = 0.0) -> None:
        """Deletes manifests beyond the last ``keep`` that are at least that old, and
        the folders that only they name. A folder that no manifest names may be an
        arrival that is not yet committed, so it stays."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("manifests")))
        versions = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
        now = time.time()

        def age(v: int) -> float:
            return now - self._fs.getFileStatus(self._path(f"manifests/v{v:010d}.json")).getModificationTime() / 1000

        old = [v for v in versions[:-keep] if age(v) >= least_age_s]
        live = {r.path for v in versions if v not in set(old) for r in self.manifest(v)[2]} if old else set()
        for v in old:
            for path in {r.path for r in self.manifest(v)[2]} - live:
                drop(self.spark, f"{self.root}/{path}")
            self._fs.delete(self._path(f"manifests/v{v:010d}.json"), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with columns shard and shard_row added."""
        v, schema, runs = self.manifest(version)
        if schema is None:
            raise ValueError("the store is empty")
        keep = [n for n in schema.names if n not in ("shard", "shard_row")]
        if not any(r.shards for r in runs):
            return self.spark.createDataFrame([], schema).select(*keep, F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_row"))
        # folder without its random end, number of the writing task, number of its file
        shard = F.regexp_replace("_metadata.file_path", r"^.*/([^/]+)-[0-9a-f]{12}/part-(\d+)-.*-c(\d+)\..*$", "$1/$2-$3")
        return (
            self.spark.read.schema(schema)
            .parquet(*[f"{self.root}/{r.path}" for r in runs if r.shards])
            .select(*keep, shard.alias("shard"), F.col("_metadata.row_index").alias("shard_row"))
        )


def sharded(docs: DataFrame, target_bytes: int = TARGET_BYTES, destination: str | None = None, arrivals: int = 1) -> DataFrame:
    """Appends ``docs`` to a store, compacts it and reads the committed version
    back: its rows with shard and shard_row. The store is the one at
    ``destination``, which is made where there is none and keeps what arrived
    before; without one, it is new and lasts as long as the session. With several
    ``arrivals``, the rows come in that many, each half as large as the one
    before it and compacted as it comes.

    Every row is kept as it is, nulls, empty and long texts and repeated rows
    included; a column that is itself called shard or shard_row gives way to the
    placement; an empty table makes a store of no rows.
    """
    store = ShardStore(docs.sparkSession, destination or new_path(docs.sparkSession, "shards"), target_bytes)
    # leading zero bits of a row's hash: half of the rows have none, a quarter one
    h = F.xxhash64(docs["doc_id"], docs["text"]).bitwiseAND(F.lit((1 << (arrivals - 1)) - 1))
    for k in range(arrivals):
        low, high = (1 << (arrivals - 1)) >> (k + 1), (1 << (arrivals - 1)) >> k
        store.append(docs if arrivals == 1 else docs.filter((h >= low) & (h < high) if low else h == 0))
        store.compact()
    # nobody else reads a store that is this session's own
    store.vacuum(KEEP if destination else 1)
    return store.read()
