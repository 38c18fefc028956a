"""Ledgers under several writers, growing histories and compaction."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import state
from pulsegrid.schemas import SCHEMAS
from pulsegrid.sources import run_folders, synth
from pulsegrid.streaming import ingest

LOG = SCHEMAS["ingestion_log"]


def log_rows(spark, ids, status="success"):
    return spark.createDataFrame([(str(k),) for k in ids], "run_id string").select("run_id", F.lit(None).cast("timestamp").alias("ingested_at"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("error_msg"))


def ids(table):
    return sorted(int(r.run_id) for r in table.read().collect())


def store_at(spark, path):
    return ingest.Store(spark, str(path))


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_two_writers_of_one_version_lose_nothing(spark, tmp_path):
    a, b = (store_at(spark, tmp_path).table("ingestion_log") for _ in range(2))
    a.replace(log_rows(spark, [0]))
    base = a.ledger.snapshot()
    mine, theirs = (t.ledger.segment(t.name, log_rows(spark, k)) for t, k in ((a, [10, 11]), (b, [20, 21])))
    a.ledger.commit(base, {a.name: [*base.segments(a.name), mine]})
    with pytest.raises(state.Conflict):  # computed from a version that is gone
        b.ledger.commit(base, {b.name: [*base.segments(b.name), theirs]})
    b.ledger.changed(lambda now: {b.name: [*now.segments(b.name), theirs]})
    assert ids(a) == [0, 10, 11, 20, 21]
    with pytest.raises(state.Conflict):
        b.overwrite(log_rows(spark, [5]), base)
    assert ids(a) == [0, 10, 11, 20, 21]


@pytest.mark.parametrize("way", ["ignore", "replace", "overwrite", "load"])
def test_a_writer_that_comes_second_computes_anew(spark, tmp_path, monkeypatch, way):
    """Another writer commits between this one's snapshot and its commit."""
    a, b = store_at(spark, tmp_path / "store"), store_at(spark, tmp_path / "store")
    a.table("ingestion_log").replace(log_rows(spark, [0]))
    commit, done = state.Ledger.commit, []

    def late(self, base, changes, reads=()):
        if self is a.ledger and not done:
            done.append(1)
            b.table("ingestion_log").replace(log_rows(spark, [1, 7], "error"))
        return commit(self, base, changes, reads)

    monkeypatch.setattr(state.Ledger, "commit", late)
    table = a.table("ingestion_log")
    if way == "load":
        synth.write_folders(str(tmp_path / "runs"), synth.Plan(runs=2))
        ingest.ingest(a, str(tmp_path / "runs"))
        assert sorted(r.run_id for r in table.read().collect()) == ["0", "1", "7", "alpha_build_001", "beta_build_002"] or table.read().count() == 5
        return
    if way == "ignore":
        assert table.ignore(log_rows(spark, [1, 2])) == {"inserted": 1, "skipped": 1}
    else:
        getattr(table, way)(log_rows(spark, [1, 2]))
    assert ids(table) == ([1, 2] if way == "overwrite" else [0, 1, 2, 7])
    held = {int(r.run_id): r.status for r in table.read().collect()}
    assert held[1] == ("error" if way == "ignore" else "success")


def test_changes_of_other_tables_are_put_on_top(spark, tmp_path):
    store = store_at(spark, tmp_path)
    base = store.ledger.snapshot()
    store.table("ingestion_log").replace(log_rows(spark, [1]))
    made = store.ledger.segment("jira_sync_log", spark.createDataFrame([], SCHEMAS["jira_sync_log"]))
    with pytest.raises(state.Conflict):  # it read what has changed
        store.ledger.commit(base, {"jira_sync_log": [made]}, ["ingestion_log"])
    assert store.ledger.commit(base, {"jira_sync_log": [made]}).number == 2
    assert ids(store.table("ingestion_log")) == [1]


def test_staged_rows_outlive_other_commits(spark, tmp_path):
    store = store_at(spark, tmp_path)
    table = store.table("ingestion_log")
    pending = store.ledger.segment(table.name, log_rows(spark, [99]))
    for k in range(state.VERSIONS + 3):
        table.overwrite(log_rows(spark, [k]))
    assert len(list((tmp_path / "versions").glob("0*.json"))) == state.VERSIONS
    assert len([p for p in (tmp_path / "ingestion_log").iterdir()]) == state.VERSIONS + 1  # of versions that are left, and the pending one
    store.ledger.changed(lambda now: {table.name: [*now.segments(table.name), pending]})
    assert ids(table) == [state.VERSIONS + 2, 99]


def test_compaction_keeps_the_rows_and_few_segments(spark, tmp_path):
    store = store_at(spark, tmp_path)
    table, want, written = store.table("ingestion_log"), {}, 0
    for k in range(24):
        rows = [k, k + 1, 3 * k]
        status = "success" if k % 2 else "error"
        table.replace(log_rows(spark, rows, status))
        want |= dict.fromkeys(rows, status)
    assert {int(r.run_id): r.status for r in table.read().collect()} == want
    assert len(store.ledger.snapshot().segments(table.name)) < state.SEGMENTS + 2


def test_a_run_is_loaded_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = tmp_path / "runs"
    last = synth.write_folders(str(root), synth.Plan(runs=5))[-1]
    (root / last).rename(tmp_path / last)
    store = store_at(spark, tmp_path / "store")
    ingest.ingest(store, str(root))
    before = store.ledger.snapshot()
    (tmp_path / last).rename(root / last)
    commit = state.Ledger.commit
    monkeypatch.setattr(state.Ledger, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # all is staged, nothing is committed
        ingest.ingest(store, str(root))
    assert store.ledger.snapshot() == before and store.table("test_results").read().count() == 80
    monkeypatch.setattr(state.Ledger, "commit", commit)
    assert ingest.ingest(store, str(root))["runs"] == 1
    assert store.ledger.snapshot().number == before.number + 1
    for _ in range(2):  # a forced load takes the former rows back
        assert ingest.ingest(store, str(root), force=True)["runs"] == 5
    assert store.table("test_results").read().groupBy("run_id").count().filter("count = 20").count() == 5
    assert store.table("runs").read().count() == store.table("ingestion_log").read().count() == 5


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    """The same runs cost the same bytes, whatever is stored already."""
    names = synth.write_folders(str(tmp_path / "runs"), synth.Plan(runs=12))
    store, grown = store_at(spark, tmp_path / "store"), []
    parts = [names[:3], names[3:9], names[9:]]
    for some in parts:
        before = size(tmp_path / "store")
        ingest.load(store, run_folders.parse(spark, str(tmp_path / "runs"), some))
        grown.append((size(tmp_path / "store") - before) / len(some))
    assert grown[2] < 1.5 * grown[0] and store.table("runs").read().count() == 12
