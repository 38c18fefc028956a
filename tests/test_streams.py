"""Streams over split input against their batch forms."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import mapping, runs
from pulsegrid.streaming import monitors

RUN = "team string, _source_db string, run_id string, build_no int, pass_rate_pct double"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(monitors.PROVIDER, None)
    spark.conf.set(monitors.PROVIDER, monitors.ROCKSDB)
    yield
    spark.conf.set(monitors.PROVIDER, before) if before else spark.conf.unset(monitors.PROVIDER)


def batches(spark, path, parts, schema):
    """One file for each part, in order of their times."""
    for k, rows in enumerate(parts):
        made = str(path / f"made-{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(made)
        (path / "in").mkdir(exist_ok=True)
        file = next(p for p in (path / f"made-{k}").iterdir() if p.suffix == ".parquet")
        target = path / "in" / f"{k}.parquet"
        file.rename(target)
        os.utime(target, (1_700_000_000 + 10 * k,) * 2)
    return str(path / "in")


def drained(df, path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, df.sparkSession.table(name)


def test_rolling_z_over_batches(spark, rocksdb, tmp_path):
    rows = [(t, "s", f"{t}_{k:03d}", k, None if k == 9 else 95.0 - (k * 7 % 5) - (40 if k == 23 else 0)) for t in ("a", "b") for k in range(1, 31)]
    parts = [[r for r in rows if r[3] <= 11], [r for r in rows if 11 < r[3] <= 24], [r for r in rows if r[3] > 24] + [("a", "s", "a_002x", 2, 50.0)]]
    _, got = drained(monitors.rolling_z(monitors.files(spark, batches(spark, tmp_path, parts, RUN), RUN)), tmp_path, "z")
    kept = ["run_id", "roll_mean", "roll_std", "z_score", "anomaly"]

    def plain(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*kept).collect()), key=str)

    want = runs.with_rolling_z(spark.createDataFrame(rows, RUN))
    assert plain(got.filter("not late")) == plain(want)
    assert [r.run_id for r in got.filter("late").collect()] == ["a_002x"]
    assert {r.run_id for r in got.filter("anomaly").collect()} == {"a_023", "b_023"}


def test_rolling_z_of_the_events(spark, rocksdb, sf, tmp_path):
    """All runs of the tables, in three batches."""
    from pulsegrid.sources import adapter

    run = adapter.frames(spark, sf).runs.select(*[c.split(" ")[0] for c in RUN.split(", ")])
    rows = sorted(map(tuple, run.collect()), key=lambda r: r[3])
    third = -(-len(rows) // 3)
    parts = [rows[k : k + third] for k in range(0, len(rows), third)]
    _, got = drained(monitors.rolling_z(monitors.files(spark, batches(spark, tmp_path, parts, RUN), RUN)), tmp_path, "zz")
    want = runs.with_rolling_z(run)
    pick = [F.col("run_id"), F.round("z_score", 6).alias("z"), F.col("anomaly")]
    assert sorted(map(str, got.select(*pick).collect())) == sorted(map(str, want.select(*pick).collect()))


def test_rolling_z_needs_its_state_store(spark):
    with pytest.raises(RuntimeError):
        monitors.rolling_z(spark.createDataFrame([], RUN))


def test_interval_join_over_batches(spark, tmp_path):
    day = [f"2024-01-{d:02d} {h:02d}:00:00" for d in range(1, 31) for h in (0, 12)]
    defects = [(f"D{k}", at) for k, at in enumerate(day[::5])]
    fails = [(f"R{k}", at) for k, at in enumerate(day)]
    d_schema, r_schema = "defect_id string, created string", "result_id string, run_timestamp string"

    def timed(df, c):
        return df.withColumn(c, F.to_timestamp(c))

    (tmp_path / "d").mkdir(), (tmp_path / "r").mkdir()
    # defects and failures of the same days come at unlike times; one failure is far behind
    d_in = batches(spark, tmp_path / "d", [defects[:5], defects[5:9], defects[9:]], d_schema)
    r_in = batches(spark, tmp_path / "r", [fails[:20], fails[20:], [("late", day[0])]], r_schema)
    d, r = timed(monitors.files(spark, d_in, d_schema), "created"), timed(monitors.files(spark, r_in, r_schema), "run_timestamp")
    q, got = drained(monitors.interval_join(d, r, 7.0, "5 days"), tmp_path, "pairs")
    want = mapping.band_join(timed(spark.createDataFrame(defects, d_schema), "created"), timed(spark.createDataFrame(fails, r_schema), "run_timestamp"), F.col("created"), F.col("run_timestamp"), 7.0)
    pick = ["defect_id", "result_id", "date_diff_days"]
    assert sorted(map(str, got.select(*pick).collect())) == sorted(map(str, want.select(*pick).collect()))
    assert monitors.late_rows(q) == 1
