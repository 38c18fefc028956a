"""Run folders: ``{alpha,beta,gamma}_build_NNN`` with ci_metadata.json and
output.xml, read by Spark's own readers from any file system."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import SCHEMAS, valid

#: Fixed: prefixes of run folders and defaults of the metadata.
FOLDERS = "{alpha,beta,gamma}_build_*"
DEFAULTS = {"team": "TeamAlpha", "suite": "Suite_Regression_TeamAlpha", "environment": "staging", "executor": "jenkins-agent-01"}
METADATA = (
    "team string, suite string, program string, job_name string, build_no int, timestamp string, total int, passed int, failed int, "
    "pass_rate_pct double, pass_rate double, environment string, executor string, _corrupt_record string"
)
TEST = "_name string, tag array<string>, tags struct<tag:array<string>>, status struct<_VALUE:string,_status:string,_starttime:string,_endtime:string>, _broken string"
_SUITE_STATUS = r"(?s)<status\b([^>]*)>(?:[^<]*</status>)?\s*</suite>\s*(?:<statistics\b.*)?</robot>"


@dataclass
class ParsedRuns:
    runs: DataFrame
    results: DataFrame
    errors: DataFrame  # (run_id, error_msg)


def _run_id() -> F.Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def metadata(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """One row per folder with readable metadata."""
    paths = [f"{root}/{r}/ci_metadata.json" for r in only] if only is not None else [f"{root}/{FOLDERS}/ci_metadata.json"]
    raw = spark.read.schema(METADATA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    return raw.select(_run_id().alias("run_id"), *raw.columns)


def reports(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """(run_id, xml) of every folder."""
    paths = [f"{root}/{r}/output.xml" for r in only] if only is not None else [f"{root}/{FOLDERS}/output.xml"]
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(_run_id().alias("run_id"), F.col("value").alias("xml"))


def _attribute(attrs: str, name: str) -> F.Column:
    return F.nullif(F.regexp_extract(attrs, rf'\b{name}="([^"]*)"', 1), F.lit(""))


def test_rows(xml: DataFrame) -> DataFrame:
    """Every test element with a status, at any depth of suites. The failing
    keyword is the last in document order, at any depth; the message is the
    status text, else the first failing message. Elements that do not parse are
    marked broken."""
    t = xml.select("run_id", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<test\b.*?</test>"), F.lit(0))).alias("fragment"))
    parsed = F.from_xml("fragment", TEST, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    t = t.withColumn("t", parsed).withColumn("broken", F.col("t").isNull() | F.col("t._broken").isNotNull())
    ok = ~F.col("broken")

    def if_ok(c: F.Column) -> F.Column:
        return F.when(ok, c)

    message = F.nullif(F.trim(F.col("t.status._VALUE")), F.lit(""))
    nested = F.get(F.xpath("fragment", F.lit("//msg[@level='FAIL']/text()")), 0)
    keywords = F.xpath("fragment", F.lit("//kw[status/@status='FAIL']/@name"))
    tags = F.coalesce("t.tag", "t.tags.tag", F.array().cast("array<string>"))
    return t.filter(F.col("broken") | F.col("t.status").isNotNull()).select(
        "run_id",
        "broken",
        F.col("t._name").alias("test_name"),
        F.coalesce("t.status._status", F.lit("FAIL")).alias("status"),
        text.seconds_between(text.parse_report_time("t.status._starttime"), text.parse_report_time("t.status._endtime")).alias("duration_s"),
        F.coalesce(message, if_ok(F.nullif(F.trim(nested), F.lit("")))).alias("raw_msg"),
        if_ok(F.try_element_at(keywords, F.lit(-1))).alias("raw_kw"),
        F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != "").alias("tags"),
    )


def parse(spark: SparkSession, root: str, only: list[str] | None = None) -> ParsedRuns:
    """Canonical runs and results of the folders, and one error per run that
    cannot be loaded: no or broken metadata, no pass rate, a broken report, or a
    row that breaks the tables' rules. A pass rate of 0.0 is a pass rate."""
    xml = reports(spark, root, only)
    meta = metadata(spark, root, only)
    rows = test_rows(xml)
    head = F.regexp_extract("xml", _SUITE_STATUS, 1)
    suite = xml.select("run_id", head.alias("a")).select(
        "run_id", F.nullif(text.seconds_between(text.parse_report_time(_attribute("a", "starttime")), text.parse_report_time(_attribute("a", "endtime"))), F.lit(0.0)).alias("duration_s")
    )
    runs = suite.join(meta, "run_id", "left").select(
        "run_id",
        F.coalesce("team", F.lit(DEFAULTS["team"])).alias("team"),
        F.coalesce("suite", F.lit(DEFAULTS["suite"])).alias("suite_name"),
        "job_name",
        F.coalesce("build_no", F.lit(0)).alias("build_no"),
        text.parse_issue_time("timestamp").alias("timestamp"),
        "duration_s",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "passed", "failed")],
        F.coalesce("pass_rate_pct", "pass_rate").alias("pass_rate_pct"),
        F.coalesce("environment", F.lit(DEFAULTS["environment"])).alias("environment"),
        F.coalesce("executor", F.lit(DEFAULTS["executor"])).alias("executor"),
        (F.col("timestamp").isNotNull() | F.col("total").isNotNull() | F.col("pass_rate_pct").isNotNull()).alias("_has_meta"),
        F.col("_corrupt_record").isNotNull().alias("_bad_json"),
    )
    results = rows.join(runs.select("run_id", "suite_name"), "run_id").select(
        F.concat_ws("_", "run_id", "test_name").alias("result_id"), "run_id", "suite_name", "test_name", "status", "duration_s",
        F.when(F.col("status") == "FAIL", F.col("raw_msg")).alias("failure_msg"), F.when(F.col("status") == "FAIL", F.col("raw_kw")).alias("failure_kw"), "tags", "broken",
    )
    checked = results.groupBy("run_id").agg(F.count_if("broken").alias("broken"), F.count_if(~valid("test_results")).alias("bad"), (F.count("*") - F.countDistinct("result_id")).alias("twice"))
    state = runs.join(checked, "run_id", "left").select(
        "run_id",
        F.when(F.col("_bad_json"), "parse: ci_metadata.json does not parse")
        .when(~F.col("_has_meta"), "parse: no ci_metadata.json")
        .when(F.col("pass_rate_pct").isNull(), "parse: no pass rate")
        .when(F.coalesce("broken", F.lit(0)) > 0, "parse: output.xml does not parse")
        .when(~valid("runs"), "load: a run column is missing")
        .when(F.coalesce("bad", F.lit(0)) > 0, "load: a result breaks the table's rules")
        .when(F.coalesce("twice", F.lit(0)) > 0, "load: a test stands twice in the run")
        .alias("error_msg"),
    )
    good = state.filter("error_msg is null").select("run_id")
    return ParsedRuns(
        runs.join(good, "run_id", "left_semi").select(*SCHEMAS["runs"].names),
        results.join(good, "run_id", "left_semi").select(*SCHEMAS["test_results"].names),
        state.filter("error_msg is not null"),
    )


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """run_id of every folder with a report or metadata."""
    return reports(spark, root).select("run_id").union(metadata(spark, root).select("run_id")).distinct()
