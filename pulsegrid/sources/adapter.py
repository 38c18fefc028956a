"""Canonical CI frames rendered from the driver's event tables, in Spark and as
the equivalent DuckDB views.

Half-day runs, a test for each user, or a given number of tests over all users;
of the events of a run and test the last decides: ``error`` is FAIL and its value
the duration. Messages, keywords and tags follow from the build and test numbers
and cover all message vocabularies; every sign-up stands for a defect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed fixture texts, chosen by (build + test) modulo their number.
MESSAGES = (
    "Element 'loading-spinner' still visible after 30s timeout",
    "Element with locator 'id=submit-btn' not found after 5 retries",
    "Expected HTTP status '200' but got '500' — Internal Server Error",
    "CSV export contained 0 rows — expected at least 100 records",
    "Connection refused — test environment unreachable",
    "Timeout failure — waiting for 'overlay-modal' exceeded 15s",
    "Data validation failure — fixture data mismatch, found 1 rows instead of at least 50",
    "Network timeout: could not reach api.example.com after 30s",
    "Unable to launch browser — infrastructure error",
)
KEYWORDS = ("Wait_Until_Ready", "Click_Element", "Check_Status", "Export_Csv", "Environment_Setup")
FEATURES = ("login", "dashboard", "usermgmt")
PRIORITIES = ("high", "medium")
SUMMARIES = ("Failure in TC_User_{n} after timeout", "User regression {n} element issue", "Element not found after retries", "Quarterly invoice layout")
DESCRIPTIONS = ("Seen while tc_user_{n} and TC_Login_SSO_{m} ran", "", "spinner visible, export rows missing")
EMAILS = ("qa@example.com", "[Dev@Example.com](mailto:dev@example.com)", "", "  QA@example.com ")
STATUSES = ("Triage", "In Progress", "Closed - Fixed", "Lab Review", "Testing", "New")
HALF_DAY_US = 43_200_000_000
TESTER = "qa@example.com"


@dataclass
class Frames:
    runs: DataFrame
    results: DataFrame
    defects: DataFrame
    vectors: DataFrame  # (vec_id, vector)


def _pick(values: tuple[str, ...], k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


#: Tests over all users where defects are paired with failures: every defect meets
#: every failure of its days, so the pairs grow with the product of the two.
PAIR_TESTS = 20


def test_number(c: F.Column) -> F.Column:
    """Two digits at least."""
    digits = c.cast("string")
    return F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0"))


def with_vector_id(df: DataFrame, number: F.Column, vectors: DataFrame, name: str) -> DataFrame:
    """``df`` with the id of one of all vectors, dealt by ``number``."""
    return df.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("_n")))).withColumn(name, F.pmod(number, F.col("_n"))).drop("_n")


def frames(spark: SparkSession, sf_dir: str, grain_us: int = HALF_DAY_US, tests: int | None = None) -> Frames:
    """``grain_us`` sets how fine runs are cut, ``tests`` over how many tests the
    users are dealt, each having its own where there is none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    cells = events.select(
        (F.floor((us - start) / F.lit(grain_us)) + 1).cast("int").alias("build_no"),
        (F.pmod("user_id", F.lit(tests)) if tests else F.col("user_id")).cast("int").alias("idx"),
        F.struct(us.alias("us"), "event_id").alias("at"),
        F.struct("event_type", "value").alias("last"),
    )
    last = cells.groupBy("build_no", "idx").agg(F.max_by("last", "at").alias("last"))
    fail = F.col("last.event_type") == "error"
    k = F.col("build_no") + F.col("idx")
    run_id = F.concat(F.lit("alpha_build_"), F.lpad(F.col("build_no").cast("string"), 3, "0"))
    name = F.concat(F.lit("TC_User_"), test_number(F.col("idx")))
    results = last.select(
        F.concat_ws("_", run_id, name).alias("result_id"),
        run_id.alias("run_id"),
        "build_no",
        "idx",
        F.lit("TeamAlpha").alias("team"),
        F.lit("Suite_Regression_TeamAlpha").alias("suite_name"),
        name.alias("test_name"),
        F.when(fail, "FAIL").otherwise("PASS").alias("status"),
        F.col("last.value").alias("duration_s"),
        F.when(fail, _pick(MESSAGES, k)).alias("failure_msg"),
        F.when(fail, _pick(KEYWORDS, k)).alias("failure_kw"),
        F.concat(F.lit('["alpha_regression","feature_'), _pick(FEATURES, F.col("idx")), F.lit('","priority_'), _pick(PRIORITIES, F.col("idx")), F.lit('"]')).alias("tags"),
        F.timestamp_micros(start + (F.col("build_no") - 1) * F.lit(grain_us)).alias("run_timestamp"),
        F.lit("alpha").alias("_source_db"),
    )
    total = F.count("*").cast("int")
    runs = (
        results.groupBy("run_id", "build_no", "team", "suite_name", F.col("run_timestamp").alias("timestamp"), "_source_db")
        .agg(
            total.alias("total"),
            F.count_if(F.col("status") == "PASS").cast("int").alias("passed"),
            F.count_if(F.col("status") == "FAIL").cast("int").alias("failed"),
            F.round(F.sum("duration_s"), 3).alias("duration_s"),
        )
        .withColumn("pass_rate_pct", F.round(F.lit(100.0) * F.col("passed") / F.col("total"), 1))
        .withColumn("environment", F.when(F.col("build_no") % 2 == 0, "staging").otherwise("prod"))
        .withColumn("executor", F.concat(F.lit("jenkins-agent-0"), (F.col("build_no") % 3 + 1).cast("string")))
    )
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"), "label")
    n = test_number(F.pmod("user_id", F.lit(tests)) if tests else F.col("user_id"))
    d, m = F.col("event_id"), F.col("user_id").cast("string")

    def about(texts: tuple[str, ...]) -> F.Column:
        return F.replace(F.replace(_pick(texts, d), F.lit("{n}"), n), F.lit("{m}"), m)

    defects = events.filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("DEF-"), F.col("event_id").cast("string")).alias("defect_id"),
        F.concat(F.lit("P"), (F.col("event_id") % 3).cast("string")).alias("project"),
        about(SUMMARIES).alias("summary"),
        about(DESCRIPTIONS).alias("description"),
        _pick(EMAILS, F.floor(d / 4)).alias("reporter_raw"),
        _pick(STATUSES, d).alias("status"),
        F.when(d % 2 == 0, "High").otherwise("Low").alias("priority"),
        F.col("ts").cast("timestamp").alias("created"),
        "event_id",
    )
    defects = with_vector_id(defects, F.col("event_id"), vectors, "vec_id").drop("event_id")
    return Frames(runs, results, defects, vectors)


def _sql_pick(values: tuple[str, ...], k: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{quoted}], cast(({k}) % {len(values)} as integer) + 1)"


def duck_frames(tests: int | None = None) -> str:
    """The same frames as DuckDB common table expressions; oracles start with them."""
    idx = f"user_id % {tests}" if tests else "user_id"

    def number(x: str) -> str:
        return f"lpad(cast({x} as varchar), cast(greatest(2, length(cast({x} as varchar))) as integer), '0')"

    def about(texts: tuple[str, ...]) -> str:
        return f"replace(replace({_sql_pick(texts, 'event_id')}, '{{n}}', {number(idx)}), '{{m}}', cast(user_id as varchar))"

    return f"""cells AS (SELECT cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / {HALF_DAY_US}.0) + 1 as integer) AS build_no,
    cast({idx} as integer) AS idx, ts, event_id, event_type, value FROM events),
lasts AS (SELECT build_no, idx, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM cells GROUP BY 1, 2),
results AS (SELECT 'alpha_build_' || lpad(cast(build_no as varchar), 3, '0') || '_TC_User_' || {number("idx")} AS result_id,
    'alpha_build_' || lpad(cast(build_no as varchar), 3, '0') AS run_id, build_no, idx, 'TeamAlpha' AS team,
    'Suite_Regression_TeamAlpha' AS suite_name, 'TC_User_' || {number("idx")} AS test_name,
    CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS status, value AS duration_s,
    CASE WHEN event_type = 'error' THEN {_sql_pick(MESSAGES, "build_no + idx")} END AS failure_msg,
    CASE WHEN event_type = 'error' THEN {_sql_pick(KEYWORDS, "build_no + idx")} END AS failure_kw,
    '["alpha_regression","feature_' || {_sql_pick(FEATURES, "idx")} || '","priority_' || {_sql_pick(PRIORITIES, "idx")} || '"]' AS tags,
    timestamp '2024-01-01' + to_hours(12 * (build_no - 1)) AS run_timestamp, 'alpha' AS _source_db FROM lasts),
runs AS (SELECT *, round(100.0 * passed / total, 1) AS pass_rate_pct, CASE WHEN build_no % 2 = 0 THEN 'staging' ELSE 'prod' END AS environment,
    'jenkins-agent-0' || cast(build_no % 3 + 1 as varchar) AS executor FROM (
    SELECT run_id, build_no, team, suite_name, run_timestamp AS timestamp, _source_db, cast(count(*) as integer) AS total,
    cast(count(*) FILTER (status = 'PASS') as integer) AS passed, cast(count(*) FILTER (status = 'FAIL') as integer) AS failed,
    round(sum(duration_s), 3) AS duration_s FROM results GROUP BY ALL)),
defects AS (SELECT 'DEF-' || cast(event_id as varchar) AS defect_id, 'P' || cast(event_id % 3 as varchar) AS project,
    {about(SUMMARIES)} AS summary, {about(DESCRIPTIONS)} AS description,
    {_sql_pick(EMAILS, "event_id // 4")} AS reporter_raw, {_sql_pick(STATUSES, "event_id")} AS status,
    CASE WHEN event_id % 2 = 0 THEN 'High' ELSE 'Low' END AS priority, ts AS created, event_id % (SELECT count(*) FROM embeddings) AS vec_id
    FROM events WHERE event_type = 'signup')"""
