"""Stateful streams: the rolling z-score of runs, and defects joined to failures
as either arrives."""

from __future__ import annotations

import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text
from ..operators.mapping import BAND_PARTS, DAY_US
from ..operators.runs import LEAST_HISTORY, ROLLING, RUN_KEYS, SIGMA
from ..session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Z_SCHEMA = "team string, _source_db string, run_id string, build_no int, pass_rate_pct double, roll_mean double, roll_std double, z_score double, anomaly boolean, late boolean"


class RollingZ(StatefulProcessor):
    """Keeps, for a team and source, the builds and rates of the last ROLLING runs.
    Runs of a batch are taken by build, then id. A run behind one that has been
    reported is late: it is reported without a score and is not kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("rates", "build_no int, run_id string, rate double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [(b, r, None if x is None or x != x else x) for b, r, x in self.held.get()] if self.held.exists() else []
        batch = pd.concat(list(rows)).sort_values(["build_no", "run_id"], kind="stable")
        out = []
        for build, run, rate in zip(batch["build_no"].tolist(), batch["run_id"].tolist(), batch["pass_rate_pct"].tolist(), strict=True):
            rate = None if rate is None or rate != rate else rate
            if held and (build, run) <= held[-1][:2]:
                out.append((*key, run, build, rate, None, None, None, False, True))
                continue
            known = [x for _, _, x in held if x is not None]
            mean = statistics.fmean(known) if len(known) >= LEAST_HISTORY else None
            std = statistics.stdev(known) if len(known) >= LEAST_HISTORY else 5.0
            z = None if mean is None or rate is None else (mean - rate) / max(std, 1.0)
            out.append((*key, run, build, rate, mean, std, z, z is not None and z >= SIGMA, False))
            held = [*held, (build, run, rate)][-ROLLING:]
        self.held.put(held)
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in Z_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def rolling_z(runs: DataFrame) -> DataFrame:
    """:func:`..operators.runs.with_rolling_z` of a stream of runs: team, source, run,
    rate, the rolling mean and deviation, z, whether it is an anomaly, and whether
    the run came late. State is ten rates for a team and source, however long
    the history; the session's state store must be RocksDB."""
    spark = runs.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise RuntimeError(f"set {PROVIDER} to {ROCKSDB}: the state is in columns of its own")
    ship(spark)
    some = runs.select(*RUN_KEYS, "run_id", F.col("build_no").cast("int"), F.col("pass_rate_pct").cast("double"))
    return some.groupBy(*RUN_KEYS).transformWithStateInPandas(RollingZ(), Z_SCHEMA, "Append", "None")


def interval_join(defects: DataFrame, failures: DataFrame, days: float = 7.0, late: str = "1 day") -> DataFrame:
    """Pairs of a defect (created) and a failure (run_timestamp) of two streams at
    most ``days`` apart, with date_diff_days. Either may come first. Rows wait in
    the state until the other side's watermark, ``late`` behind its latest time,
    has passed their window, and are then dropped; rows behind their own side's
    watermark are dropped on arrival and counted (:func:`late_rows`).

    As a stream's join needs equal keys, times fall into buckets as in the batch
    band join; rows without a time meet nothing."""
    width = max(1, -(-int(days * DAY_US) // BAND_PARTS))

    def bucket(c: str):
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(width))

    d = defects.filter("created is not null").withWatermark("created", late)
    d = d.withColumn("_at", F.explode(F.sequence(bucket("created") - BAND_PARTS - 1, bucket("created") + BAND_PARTS + 1)))
    r = failures.filter("run_timestamp is not null").withWatermark("run_timestamp", late).withColumn("_bucket", bucket("run_timestamp"))
    span = F.expr(f"INTERVAL '{int(days * 86_400)}' SECOND")
    near = (F.col("run_timestamp") >= F.col("created") - span) & (F.col("run_timestamp") <= F.col("created") + span)
    met = d.join(r, (F.col("_at") == F.col("_bucket")) & near)
    return met.withColumn("date_diff_days", text.days_between(F.col("created"), F.col("run_timestamp"))).drop("_at", "_bucket")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermarks have dropped, over the progress that the query
    still holds."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in (p if isinstance(p, dict) else p.jsonValue)["stateOperators"])


def files(spark: SparkSession, path: str, schema: StructType | str, per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files, ``per_batch`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
