"""Per-test operators: flakiness, drift, forecasts, features and ranking.

All are windows over one test of one source (GROUP); none needs Python code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from . import stats

GROUP = ("_source_db", "test_name")
HISTORY, WINDOW = 10, 20
DRIFT_BASELINE, DRIFT_SIGMA, DRIFT_FLAGS, DRIFT_PERCENT = 15, 2.0, 3, 15.0


def _order(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("build_no", "run_id")


def _fail() -> Column:
    return (F.col("status") == "FAIL").cast("int")


def top_failing(results: DataFrame, runs: DataFrame, team: str, n: int = 5) -> DataFrame:
    joined = results.join(runs.filter(F.col("team") == team).select("run_id"), "run_id")
    fails = F.sum(_fail())
    out = joined.groupBy("test_name").agg(
        F.count("*").alias("total_runs"), fails.alias("fail_count"), F.round(fails * F.lit(100.0) / F.count("*"), 1).alias("fail_rate_pct")
    )
    return out.orderBy(F.desc("fail_count"), "test_name").limit(n)


def flaky_scores(results: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Pipeline scores: status changes minus the first row, never below 0."""
    before = F.lag("status").over(_order(keys))
    t = results.withColumn("changed", F.coalesce(F.col("status") != before, F.lit(True)).cast("int"))
    fails = F.sum(_fail())
    return t.groupBy(*keys).agg(
        F.greatest(F.sum("changed") - 1, F.lit(0)).alias("flip_count"),
        fails.alias("fail_count"),
        F.count("*").alias("total_runs"),
        F.bround(fails * F.lit(100.0) / F.count("*"), 1).alias("failure_rate"),
    )


def flaky_scores_by_test(results: DataFrame) -> DataFrame:
    """Dashboard scores: flips within source and test, summed over sources."""
    before = F.lag("status").over(_order(GROUP))
    t = results.withColumn("flip", F.coalesce(F.col("status") != before, F.lit(False)).cast("int"))
    fails = F.sum(_fail())
    return t.groupBy("test_name").agg(
        F.sum("flip").alias("flip_count"), fails.alias("fail_count"), F.count("*").alias("total_runs"), F.bround(fails * F.lit(100.0) / F.count("*"), 1).alias("failure_rate")
    )


def recent_history(results: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """ML report columns: failure rate of the last 20 runs, flips with the first
    row counted, trend of the last five runs against the five before."""
    forward, back = _order(keys), Window.partitionBy(*keys).orderBy(F.desc("build_no"), F.desc("run_id"))
    t = results.withColumns(
        {
            "bad": _fail(),
            "changed": F.coalesce(F.col("status") != F.lag("status").over(forward), F.lit(True)).cast("int"),
            "rn": F.row_number().over(forward),
            "back": F.row_number().over(back),
            "n": F.count("*").over(Window.partitionBy(*keys)),
        }
    )
    prior = F.when(F.col("n") >= 10, F.col("back").between(6, 10)).otherwise(F.col("rn") <= 5)
    out = t.groupBy(*keys).agg(
        F.bround(F.avg(F.when(F.col("back") <= 20, F.col("bad"))) * 100, 1).alias("failure_rate_last20"),
        F.sum("changed").alias("flip_count"),
        F.avg(F.when(F.col("back") <= 5, F.col("bad"))).alias("recent_rate"),
        F.avg(F.when(prior, F.col("bad"))).alias("prior_rate"),
    )
    return out.withColumn("trend", rules.trend(F.col("recent_rate") - F.col("prior_rate"))).drop("recent_rate", "prior_rate")


def duration_series(results: DataFrame, test_name: str, least: int = 2) -> DataFrame:
    """One test's durations, numbered, with the rolling mean of five."""
    w = _order(GROUP)
    five = w.rowsBetween(-4, 0)
    t = results.filter(F.col("test_name") == test_name)
    return t.select("run_id", F.row_number().over(w).alias("run_num"), "status", "duration_s", F.when(F.count("duration_s").over(five) >= least, F.avg("duration_s").over(five)).alias("rolling_5"))


# --- features ---------------------------------------------------------------


def flakiness_rows(results: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """One row per run from the eleventh of a test on, from the window of up to
    20 runs that ends there; ``target`` says whether the next run fails, ``latest``
    whether there is none. A missing gap is 1 day; mean durations may be missing."""
    w = _order(keys)
    window = w.rowsBetween(1 - WINDOW, 0)
    t = results.withColumns({"bad": _fail(), "rn": F.row_number().over(w), "previous": F.lag("status").over(w), "next_bad": F.lead(_fail()).over(w)})
    t = t.withColumns({"next_build": F.lead("build_no").over(w), "flip": F.coalesce(F.col("status") != F.col("previous"), F.lit(False)).cast("int")})
    size = F.count("*").over(window)
    streak = {s: F.coalesce(F.col("rn") - F.max(F.when(F.col("status") != s, F.col("rn"))).over(window), size) for s in ("FAIL", "PASS")}
    pairs = F.collect_list(F.struct("status", "duration_s")).over(window)

    def mean_of_five(s: str) -> Column:
        last = F.slice(F.reverse(F.filter(F.col("pairs"), lambda p: p["status"] == s)), 1, 5)
        n = F.size(F.filter(last, lambda p: p["duration_s"].isNotNull()))
        return F.aggregate(last, F.lit(0.0), lambda a, p: a + F.coalesce(p["duration_s"], F.lit(0.0))) / F.nullif(n, F.lit(0))

    flips = F.sum("flip").over(w.rowsBetween(2 - WINDOW, 0))
    t = t.withColumns(
        {
            **{f"fail_rate_last_{n}": F.avg("bad").over(w.rowsBetween(1 - n, 0)) for n in (5, 10, 20)},
            "flip_count_last_w": flips,
            "size": size,
            "consecutive_failures": streak["FAIL"],
            "consecutive_passes": streak["PASS"],
            "pairs": pairs,
            "gap": text.days_between(F.col("run_timestamp"), F.lag("run_timestamp").over(w)),
            "last": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rn"))),
        }
    )
    return t.filter(F.col("rn") > HISTORY).select(
        *keys,
        "run_id",
        F.coalesce("next_build", F.col("build_no") + 1).alias("build_no_target"),
        "fail_rate_last_5", "fail_rate_last_10", "fail_rate_last_20", "flip_count_last_w",
        (F.col("flip_count_last_w") / F.greatest(F.col("size") - 1, F.lit(1))).alias("flip_rate_last_w"),
        "consecutive_failures", "consecutive_passes",
        mean_of_five("PASS").alias("avg_dur_pass_5"), mean_of_five("FAIL").alias("avg_dur_fail_5"),
        F.col("duration_s").alias("duration_last"),
        F.coalesce("gap", F.lit(1.0)).alias("time_since_last"),
        *(["run_pass_rate"] if "run_pass_rate" in results.columns else []),
        text.tag_at("tags", 1).alias("feature_tag"), text.tag_at("tags", 2).alias("priority_tag"),
        F.col("next_bad").alias("target"),
        (F.col("last") == 1).alias("latest"),
    )


def typical_durations(rows: DataFrame) -> DataFrame:
    """One row: the medians (mp, mf) that missing mean durations take. Each passes
    over the rows twice."""
    return stats.quantiles(rows, "avg_dur_pass_5", {"mp": 0.5}).crossJoin(stats.quantiles(rows, "avg_dur_fail_5", {"mf": 0.5}))


def with_durations(rows: DataFrame, typical: DataFrame) -> DataFrame:
    filled = {"avg_dur_pass_5": F.coalesce("avg_dur_pass_5", "mp"), "avg_dur_fail_5": F.coalesce("avg_dur_fail_5", "mf")}
    return rows.crossJoin(F.broadcast(typical)).withColumns(filled).drop("mp", "mf")  # one row


def flakiness_features(results: DataFrame, keys: tuple[str, ...] = GROUP, labelled: bool = True) -> DataFrame:
    """:func:`flakiness_rows` whose target is known, or with ``labelled=False`` each
    test's last run; missing mean durations take the median of all these rows."""
    t = flakiness_rows(results, keys).filter("target is not null" if labelled else "latest").drop("latest")
    return with_durations(t, typical_durations(t))


def regression_features(results: DataFrame) -> DataFrame:
    """Duration history per test: expanding mean, rolling mean and deviation of
    five, previous value. All look back only, within the test."""
    w = _order(GROUP)
    five = w.rowsBetween(-5, -1)
    return results.filter("duration_s > 0").select(
        *GROUP, "run_id", "build_no", "duration_s", F.ln("duration_s").alias("log_duration"),
        F.avg("duration_s").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("expanding_mean"),
        F.avg("duration_s").over(five).alias("rolling_mean_5"), F.stddev_samp("duration_s").over(five).alias("rolling_std_5"),
        F.lag("duration_s").over(w).alias("prev_duration"),
    )


def duration_model_input(features: DataFrame, durations: DataFrame) -> DataFrame:
    """Test features with the duration features of the same test and build, one
    row of these each; missing ones take the column's median."""
    columns = ["expanding_mean", "rolling_mean_5", "rolling_std_5", "prev_duration"]
    w = Window.partitionBy(*GROUP, "build_no").orderBy("run_id")
    one = durations.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*GROUP, "build_no", *columns)
    out = features.join(one, [*GROUP, "build_no"], "left")
    for c in columns:
        out = out.crossJoin(F.broadcast(stats.quantiles(durations, c, {"_m": 0.5}))).withColumn(c, F.coalesce(c, "_m")).drop("_m")  # one row
    return out


# --- drift ------------------------------------------------------------------


def drift_flags(results: DataFrame, baseline: int = DRIFT_BASELINE, sigma: float = DRIFT_SIGMA, flags: int = DRIFT_FLAGS, sample_std: bool = False, least_extra: int = 5, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """``results`` with z_duration, drift_flagged and drift_confirmed. The
    baseline are a test's first passing runs; a flag is confirmed where at least
    ``flags`` of the last ten passing runs (five or more) have one. The notebook
    uses ``baseline=30, sample_std=True, least_extra=0``."""
    w = Window.partitionBy(*keys, "status").orderBy("build_no", "run_id")
    every = Window.partitionBy(*keys, "status")
    t = results.withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(every)})
    first = F.when(F.col("rn") <= baseline, F.col("duration_s"))
    std = (F.stddev_samp if sample_std else F.stddev_pop)(first).over(every)
    usable = (F.col("status") == "PASS") & (F.col("n") >= baseline + least_extra)
    t = t.withColumn("z_duration", F.when(usable, (F.col("duration_s") - F.avg(first).over(every)) / F.greatest(std, F.lit(0.01))))
    t = t.withColumn("drift_flagged", F.coalesce(F.col("z_duration") >= sigma, F.lit(False)))
    ten = w.rowsBetween(-9, 0)
    confirmed = usable & (F.count("*").over(ten) >= 5) & (F.sum(F.col("drift_flagged").cast("int")).over(ten) >= flags)
    return t.withColumn("drift_confirmed", F.coalesce(confirmed, F.lit(False))).drop("rn", "n")


def drift_report(results: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Tests whose median duration rose by DRIFT_PERCENT or more from the first
    confirmed build on."""
    t = drift_flags(results, keys=keys)
    every = Window.partitionBy(*keys)
    t = t.withColumn("first_drift", F.min(F.when(F.col("drift_confirmed"), F.col("build_no"))).over(every)).filter("first_drift is not null")
    after = F.col("build_no") >= F.col("first_drift")
    out = t.groupBy(*keys, "first_drift").agg(
        F.coalesce(F.median(F.when(~after, F.col("duration_s"))), F.median("duration_s")).alias("before"),
        F.median(F.when(after, F.col("duration_s"))).alias("recent"),
        F.max_by("duration_s", F.struct("build_no", "run_id")).alias("latest"),
    )
    out = out.withColumn("pct", F.when(F.col("before") != 0, (F.col("recent") / F.col("before") - 1) * 100).otherwise(0.0)).filter(F.col("pct") >= DRIFT_PERCENT)
    return out.select(
        *keys, F.bround("before", 2).alias("baseline_duration_s"), F.bround("latest", 2).alias("drifted_duration_s"), F.bround("pct", 1).alias("percent_increase"),
        F.col("first_drift").alias("first_drift_build"), F.bround(F.least(F.lit(1.0), F.lit(0.5) + F.col("pct") / 200), 2).alias("model_confidence"),
    )


def non_drifting(results: DataFrame, report: DataFrame) -> DataFrame:
    return results.select("test_name").distinct().join(report.select("test_name").distinct(), "test_name", "left_anti")


def duration_forecast(results: DataFrame, report: DataFrame) -> DataFrame:
    """Per test: mean of the last five passing runs, its 95 % band and the drift
    status; tests of fewer than five passing runs say so."""
    back = Window.partitionBy("test_name").orderBy(F.desc("build_no"), F.desc("run_id"))
    passing = results.filter("status = 'PASS'").withColumn("back", F.row_number().over(back))
    last = F.when(F.col("back") <= 5, F.col("duration_s"))
    t = passing.groupBy("test_name").agg(F.count("*").alias("n"), F.avg(last).alias("pred"), F.stddev_pop(last).alias("std"))
    tests = results.select("test_name").distinct().join(t, "test_name", "left")
    t = tests.join(report.select("test_name", "percent_increase"), "test_name", "left")
    enough = F.coalesce(F.col("n") >= 5, F.lit(False))
    state = F.when(~enough, "Insufficient data").when(F.col("percent_increase") > 25, "Drifting").when(F.col("percent_increase") > 15, "Watch").otherwise("Stable")
    band = F.lit(1.96) * F.col("std")

    def or_zero(c: Column) -> Column:
        return F.when(enough, F.bround(c, 2)).otherwise(0.0)

    return t.select(
        "test_name", or_zero(F.col("pred")).alias("predicted_duration_s"), or_zero(F.greatest(F.lit(0.0), F.col("pred") - band)).alias("ci_low_s"),
        or_zero(F.col("pred") + band).alias("ci_high_s"), state.alias("drift_status"),
    )


# --- ranking ----------------------------------------------------------------


def enriched_predictions(predictions: DataFrame) -> DataFrame:
    """confidence, risk and recommendation for rows of probability and trend."""
    p = F.col("failure_probability")
    level = F.regexp_replace(rules.risk(p), "Moderate", "Medium")
    advice = F.when(level == "High", F.when(F.col("trend") == "Increasing", "Execute Early").otherwise("Isolate")).when(level == "Medium", "Retry Automatically").otherwise("Monitor")
    return predictions.withColumns({"confidence": F.bround(F.greatest(p, 1 - p), 2), "risk": level, "recommendation": advice})


def prioritised(predictions: DataFrame, report: DataFrame, results: DataFrame, n: int = 25) -> DataFrame:
    """Tests ranked by .55 probability + .30 failure rate + .15 duration."""
    past = results.groupBy("test_name").agg(F.bround(F.avg(_fail()) * 100, 1).alias("hist"), F.bround(F.avg("duration_s"), 2).alias("dur"))
    t = (
        predictions.select("test_name", "failure_probability", "failure_rate_last20")
        .join(report.select("test_name", "drifted_duration_s"), "test_name", "full_outer")
        .join(past, "test_name", "left")
    )
    p, zero = F.coalesce("failure_probability", F.lit(0.0)), F.lit(0.0)
    duration, rate = F.coalesce("drifted_duration_s", "dur", zero), F.coalesce("failure_rate_last20", "hist", zero)
    score = F.bround(p * 0.55 + rate / 100 * 0.30 + F.least(duration / 60, F.lit(1.0)) * 0.15, 3)
    t = t.select("test_name", p.alias("p"), F.bround(duration, 2).alias("predicted_duration_s"), rate.alias("historical_failure_rate"), score.alias("priority_score"))
    advice = (
        F.when((F.col("p") >= 0.7) | (F.col("priority_score") >= 0.65), "Isolate")
        .when((F.col("p") >= 0.4) | (F.col("historical_failure_rate") >= 30), "Execute Early")
        .when(F.col("p") >= 0.25, "Retry Automatically")
        .otherwise("Monitor")
    )
    top = t.orderBy(F.desc("priority_score"), "test_name").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("priority_score"), "test_name"))  # n rows
    return top.select(
        rank.alias("priority_rank"), "test_name", F.bround(F.col("p") * 100, 1).alias("flakiness_probability"), "predicted_duration_s",
        "historical_failure_rate", "priority_score", advice.alias("recommendation"),
    )


def risk_scores(predictions: DataFrame, report: DataFrame, durations: DataFrame) -> DataFrame:
    """Notebook risk: probability times drift, per second of predicted duration
    (``durations``: test_name, predicted_duration_s); tiers by quartiles."""
    t = predictions.join(report.select("test_name", "percent_increase"), "test_name", "left").join(durations, "test_name", "left")
    t = t.withColumn("risk_score", F.col("failure_probability") * (1 + F.coalesce("percent_increase", F.lit(0.0)) / 100) / F.nullif("predicted_duration_s", F.lit(0.0)))
    cut = F.broadcast(stats.quantiles(t, "risk_score", {"hi": 0.75, "lo": 0.25}))
    tier = F.when(F.col("risk_score") >= F.col("hi"), "High").when(F.col("risk_score") >= F.col("lo"), "Medium").otherwise("Low")
    return t.crossJoin(cut).withColumn("tier", tier).select("test_name", "risk_score", "tier")  # cut is one row


def union_sources(frames: list[DataFrame], key: str, rank: tuple[str, ...] = ()) -> DataFrame:
    """All sources by name, one row per (key, _source_db)."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if not rank:
        return every.dropDuplicates([key, "_source_db"])
    w = Window.partitionBy(key, "_source_db").orderBy(*rank)
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
