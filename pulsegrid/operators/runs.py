"""Run-level operators: anomalies, features, weekly health and BI measures.

Windows run over builds of one team and source, so they are split by those keys
and hold one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

RUN_KEYS = ("team", "_source_db")
ROLLING, LEAST_HISTORY, SIGMA = 10, 3, 2.0


def by_build(*keys: str) -> Window:
    return Window.partitionBy(*(keys or RUN_KEYS)).orderBy("build_no", "run_id")


def runs_of_team(runs: DataFrame, team: str) -> DataFrame:
    return runs.filter(F.col("team") == team).select("run_id", "timestamp", "pass_rate_pct")


def from_source(frame: DataFrame, source: str = "All") -> DataFrame:
    return frame if source == "All" else frame.filter(F.col("_source_db") == source)


def with_rolling_z(runs: DataFrame, keys: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    """z of a run's pass rate against up to ten runs before it; at least three
    are needed. A missing deviation counts as 5 points, a small one as 1."""
    before = by_build(*keys).rowsBetween(-ROLLING, -1)
    enough = F.count("pass_rate_pct").over(before) >= LEAST_HISTORY
    mean = F.when(enough, F.avg("pass_rate_pct").over(before))
    std = F.coalesce(F.when(enough, F.stddev_samp("pass_rate_pct").over(before)), F.lit(5.0))
    z = (F.col("roll_mean") - F.col("pass_rate_pct")) / F.greatest("roll_std", F.lit(1.0))
    out = runs.withColumn("roll_mean", mean).withColumn("roll_std", std).withColumn("z_score", z)
    return out.withColumn("anomaly", F.coalesce(F.col("z_score") >= SIGMA, F.lit(False)))


def run_features(runs: DataFrame, results: DataFrame, keys: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    """Per run: change of the pass rate, failure rate of the run before,
    deviation from the rolling mean, mean test duration."""
    w = by_build(*keys)
    durations = results.groupBy("run_id").agg(F.avg("duration_s").alias("avg_duration_s"))
    out = with_rolling_z(runs, keys).withColumns(
        {
            "pass_rate_change": F.coalesce(F.col("pass_rate_pct") - F.lag("pass_rate_pct").over(w), F.lit(0.0)),
            "fail_rate_prev": F.coalesce(F.lag(F.col("failed") / F.greatest("total", F.lit(1))).over(w), F.lit(0.0)),
            "deviation": F.coalesce("roll_mean", "pass_rate_pct") - F.col("pass_rate_pct"),
            "duration_change": F.col("duration_s") / F.nullif(F.lag("duration_s").over(w), F.lit(0.0)),
        }
    )
    return out.join(durations, "run_id", "left").withColumn("avg_duration_s", F.coalesce("avg_duration_s", F.lit(0.0)))


def run_features_notebook(runs: DataFrame, keys: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    """The notebook's variants: the deviation is from a mean that includes the
    run itself, and nothing is filled."""
    w = by_build(*keys)
    here = w.rowsBetween(1 - ROLLING, 0)
    mean = F.when(F.count("pass_rate_pct").over(here) >= LEAST_HISTORY, F.avg("pass_rate_pct").over(here))
    return runs.withColumns(
        {
            "pass_rate_change": F.col("pass_rate_pct") - F.lag("pass_rate_pct").over(w),
            "fail_rate_prev": F.lag(F.col("failed") / F.nullif("total", F.lit(0))).over(w),
            "deviation": mean - F.col("pass_rate_pct"),
        }
    )


def weekly_health(runs: DataFrame) -> DataFrame:
    """Per week of seven builds: average, best and worst pass rate, the latest
    run and its band."""
    out = runs.withColumn("week", rules.build_week(F.col("build_no"))).groupBy("week").agg(
        F.avg("pass_rate_pct").alias("avg_rate"),
        F.max("pass_rate_pct").alias("best_rate"),
        F.min("pass_rate_pct").alias("worst_rate"),
        F.max_by(F.struct("run_id", "pass_rate_pct"), F.struct("build_no", "run_id")).alias("latest"),
    )
    rate = F.col("latest.pass_rate_pct")
    return out.select("week", "avg_rate", "best_rate", "worst_rate", F.col("latest.run_id").alias("latest_run"), rate.alias("latest_rate"), rules.health_band(rate).alias("band"))


def week_on_week(runs: DataFrame, results: DataFrame) -> DataFrame:
    """For every week: change of the mean pass rate, tests that began to fail and
    tests that were mended against the week before; zeros where that is missing.
    A test without results counts as passing."""
    week = runs.select("run_id", rules.build_week(F.col("build_no")).alias("week"), "pass_rate_pct")
    rate = week.groupBy("week").agg(F.avg("pass_rate_pct").alias("this_avg"))
    status = results.join(week.select("run_id", "week"), "run_id").groupBy("week", "test_name").agg(F.max((F.col("status") == "FAIL").cast("int")).alias("bad"))
    ahead = status.select((F.col("week") + 1).alias("week"), "test_name", F.col("bad").alias("was"))
    moved = status.join(ahead, ["week", "test_name"], "full_outer").groupBy("week").agg(
        F.count_if((F.coalesce("was", F.lit(0)) == 0) & (F.coalesce("bad", F.lit(0)) == 1)).alias("new_failures"),
        F.count_if((F.coalesce("was", F.lit(0)) == 1) & (F.coalesce("bad", F.lit(0)) == 0)).alias("tests_fixed"),
    )
    last = rate.select((F.col("week") + 1).alias("week"), F.col("this_avg").alias("last_avg"))
    both = F.col("last_avg").isNotNull()
    zero = F.lit(0.0)
    return (
        rate.join(last, "week", "left")
        .join(moved, "week", "left")
        .select(
            "week",
            F.when(both, F.col("this_avg") - F.col("last_avg")).otherwise(zero).alias("pass_rate_delta"),
            F.when(both, F.col("this_avg")).otherwise(zero).alias("this_avg"),
            F.when(both, F.col("last_avg")).otherwise(zero).alias("last_avg"),
            F.when(both, F.col("new_failures")).otherwise(0).cast("long").alias("new_failures"),
            F.when(both, F.col("tests_fixed")).otherwise(0).cast("long").alias("tests_fixed"),
        )
        .withColumn("direction", rules.delta_band(F.col("pass_rate_delta")))
    )


def bi_measures(runs: DataFrame, results: DataFrame) -> DataFrame:
    """One row: pass rate, failure rate, mean run duration, flaky tests."""
    flaky = results.groupBy("test_name").agg(F.countDistinct("status").alias("n")).filter("n > 1").agg(F.count("*").alias("flaky_tests"))
    rates = runs.agg(
        F.try_divide(F.sum("passed"), F.sum("total")).alias("pass_rate"),
        F.try_divide(F.sum("failed"), F.sum("total")).alias("failure_rate"),
        F.avg("duration_s").alias("avg_duration_s"),
    )
    return rates.crossJoin(flaky)  # one row each


def executor_performance(runs: DataFrame) -> DataFrame:
    return runs.groupBy("executor").agg(F.count("*").alias("n_runs"), F.avg("pass_rate_pct").alias("avg_rate"), F.avg("duration_s").alias("avg_duration_s"))


def pass_fail_per_run(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "timestamp", "passed", "failed", "pass_rate_pct", "duration_s")


def sliced(frame: DataFrame, suite: str | None = None, team: str | None = None, status: str | None = None, executor: str | None = None, since: str | None = None, until: str | None = None, time: str = "timestamp") -> DataFrame:
    """Report slicers; those not given do not filter."""
    for c, v in (("suite_name", suite), ("team", team), ("status", status), ("executor", executor)):
        if v is not None:
            frame = frame.filter(F.col(c) == v)
    if since is not None:
        frame = frame.filter(F.col(time) >= F.lit(since).cast("timestamp"))
    return frame if until is None else frame.filter(F.col(time) < F.lit(until).cast("timestamp"))


def dashboard_header(runs: DataFrame) -> DataFrame:
    """One row: the latest run by build number, the programs, the runs."""
    return runs.agg(
        F.max_by("run_id", F.struct("build_no", "run_id")).alias("latest_run"),
        F.array_join(F.sort_array(F.collect_set(rules.program(F.col("suite_name")))), ",").alias("programs"),
        F.count("*").alias("n_runs"),
    )


def run_verdicts(runs_with_z: DataFrame, forest: DataFrame) -> DataFrame:
    """Joins z scores to isolation-forest flags (run_id, if_anomaly,
    anomaly_score) and labels method and severity."""
    flags = forest.select("run_id", "if_anomaly", "anomaly_score")
    out = runs_with_z.join(flags, "run_id", "left").withColumn("if_anomaly", F.coalesce("if_anomaly", F.lit(False)))
    z, iso = F.col("anomaly"), F.col("if_anomaly")
    return out.withColumns(
        {
            "flagged_by_both": z & iso,
            "is_anomalous": z | iso,
            "detection_method": rules.detection(z, iso),
            "severity": rules.severity(z, iso, F.coalesce("z_score", F.lit(0.0))),
        }
    )


def anomaly_table(verdicts: DataFrame) -> DataFrame:
    """The flagged runs as the dashboard lists them, flags as Yes or No, the lowest
    pass rate first."""
    def said(c: str) -> Column:
        return F.when(F.col(c), "Yes").otherwise("No")

    shown = verdicts.filter("is_anomalous").select(
        "run_id", "build_no", "pass_rate_pct", "detection_method", "severity",
        said("anomaly").alias("z_score_flag"), said("if_anomaly").alias("forest_flag"), said("flagged_by_both").alias("both"),
    )
    return shown.orderBy("pass_rate_pct", "build_no", "run_id")


def expectations(runs: DataFrame, results: DataFrame, per_run: int) -> DataFrame:
    """Load counts and whether they are as expected."""
    a = runs.agg(F.count("*").alias("n_runs"), F.countDistinct("run_id").alias("distinct_runs"), F.min("timestamp").alias("first_run"), F.max("timestamp").alias("last_run"))
    b = results.agg(F.count("*").alias("n_results"), F.countDistinct("test_name").alias("n_tests"))
    return a.crossJoin(b).withColumn("enough_results", F.col("n_results") >= F.col("n_runs") * per_run)  # one row each


def time_split(frame: DataFrame, build: str = "build_no") -> DataFrame:
    """Adds split: train up to the 75th percentile of the distinct builds,
    validation up to the 90th, test beyond."""
    cut = frame.select(build).distinct().agg(F.percentile(build, F.lit(0.75)).alias("p75"), F.percentile(build, F.lit(0.90)).alias("p90"))
    split: Column = F.when(F.col(build) <= F.col("p75"), "train").when(F.col(build) <= F.col("p90"), "validation").otherwise("test")
    return frame.crossJoin(F.broadcast(cut)).withColumn("split", split).drop("p75", "p90")  # cut is one row
