"""Incremental ingestion of run folders: batch with a log, or a file stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import Ledger, LedgerTable, Snapshot
from ..schemas import RULES, SCHEMAS
from ..sources import run_folders


@dataclass
class Store:
    """The canonical tables below one folder."""

    spark: SparkSession
    root: str

    def __post_init__(self):
        self.ledger = Ledger(self.spark, self.root, SCHEMAS)

    def table(self, name: str) -> LedgerTable:
        return LedgerTable(self.ledger, name, list(RULES[name].key))


def load(store: Store, parsed: run_folders.ParsedRuns) -> dict[str, int]:
    """Loads whole runs: a run's rows replace its former ones, and the log says
    success or error. All three tables change in one version. Written are the
    rows of these runs and, of those that had been loaded before, the ids, by which
    readers pass over the former rows; what is stored is read for the log's ids
    alone. Where another writer comes first, the ids are looked up again."""
    runs, results, errors = (t.persist() for t in (parsed.runs, parsed.results, parsed.errors))
    log = runs.select("run_id", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_msg")).unionByName(errors.select("run_id", F.lit("error").alias("status"), "error_msg"))
    log = log.withColumn("ingested_at", F.current_timestamp())
    ledger, on = store.ledger, ["run_id"]
    staged = {name: ledger.segment(name, rows) for name, rows in (("runs", runs), ("test_results", results), ("ingestion_log", log))}
    loaded = {name: log.select(*on) if name == "ingestion_log" else runs.select(*on) for name in staged}

    def changes(now: Snapshot) -> dict[str, list[dict]]:
        known = ledger.read("ingestion_log", now).select(*on)
        again = {name: ids.join(known, on, "left_semi") for name, ids in loaded.items()}
        return {name: [*now.segments(name), ledger.taking_back(name, staged[name], again[name], on)] for name in staged}

    ledger.changed(changes)
    for name in staged:
        ledger.compact(name)
    for t in (runs, results, errors):
        t.unpersist()
    return {"runs": staged["runs"]["n"], "results": staged["test_results"]["n"], "errors": staged["ingestion_log"]["n"] - staged["runs"]["n"]}


def ingest(store: Store, root: str, force: bool = False) -> dict[str, int]:
    """All folders that the log does not call a success; all of them with force."""
    if force:
        return load(store, run_folders.parse(store.spark, root)) | {"skipped": 0}
    done = store.table("ingestion_log").read().filter("status = 'success'").select("run_id")
    found = run_folders.discovered(store.spark, root)
    todo = [r[0] for r in found.join(done, "run_id", "left_anti").collect()]  # folder names of one load
    if not todo:
        return {"runs": 0, "results": 0, "errors": 0, "skipped": found.count()}
    return load(store, run_folders.parse(store.spark, root, todo)) | {"skipped": found.count() - len(todo)}


def stream(store: Store, root: str, checkpoint: str, files_per_batch: int = 50) -> StreamingQuery:
    """A stream over metadata files; each batch loads its runs and the query ends
    when all files at hand are loaded. The checkpoint remembers the files."""
    source = store.spark.readStream.schema(run_folders.METADATA).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch)
    new = source.json(f"{root}/{run_folders.FOLDERS}/ci_metadata.json").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id"))

    def each(batch: DataFrame, _: int) -> None:
        only = [r[0] for r in batch.distinct().collect()]  # at most files_per_batch
        if only:
            load(store, run_folders.parse(store.spark, root, only))

    return new.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Extension: event counts per time window and type under a watermark."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(at, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Extension: sessions of a user under a watermark."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
