"""Canonical tables: explicit schemas, keys and row rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

_DDL = {
    "runs": "run_id string, team string, suite_name string, job_name string, build_no int, timestamp timestamp, duration_s double, "
    "total int, passed int, failed int, pass_rate_pct double, environment string, executor string",
    "test_results": "result_id string, run_id string, suite_name string, test_name string, status string, duration_s double, "
    "failure_msg string, failure_kw string, tags array<string>",
    "ingestion_log": "run_id string, ingested_at timestamp, status string, error_msg string",
    "jira_defects": "defect_id string, project string, summary string, description string, reporter_name string, reporter_email string, "
    "status string, priority string, issue_type string, labels array<string>, components array<string>, created timestamp, "
    "raw_json string, ingested_at timestamp",
    "embeddings": "entity_id string, entity_type string, model_name string, vector array<float>, source_text string, created_at timestamp",
    "defect_test_mappings": "mapping_id string, defect_id string, result_id string, run_id string, test_name string, defect_project string, "
    "defect_summary string, defect_status string, defect_priority string, reporter_email string, run_timestamp timestamp, "
    "defect_created timestamp, date_diff_days double, confidence_score double, match_reason string, email_match int, "
    "date_within_window int, confirmed int, mapped_at timestamp",
    "jira_sync_log": "mapping_id string, defect_id string, run_id string, status string, error_msg string, dry_run int, written_at timestamp",
}
_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}
SCHEMAS = {table: StructType([StructField(*[f(x) for f, x in zip((str, _TYPES.get), c.split(" "), strict=True)]) for c in ddl.split(", ")]) for table, ddl in _DDL.items()}


@dataclass(frozen=True)
class Rules:
    key: tuple[str, ...]
    required: tuple[str, ...]
    allowed: dict[str, tuple]


RULES = {
    "runs": Rules(("run_id",), ("run_id", "team", "suite_name", "timestamp", "total", "passed", "failed"), {}),
    "test_results": Rules(("result_id",), ("result_id", "run_id", "suite_name", "test_name", "status"), {"status": ("PASS", "FAIL")}),
    "ingestion_log": Rules(("run_id",), ("run_id", "status"), {"status": ("success", "error")}),
    "jira_defects": Rules(("defect_id",), ("defect_id", "project", "summary", "created"), {}),
    "embeddings": Rules(("entity_id", "model_name"), ("entity_id", "entity_type", "model_name", "vector", "source_text"), {"entity_type": ("test_result", "jira_defect")}),
    "defect_test_mappings": Rules(
        ("mapping_id",),
        ("mapping_id", "defect_id", "result_id", "run_id", "test_name", "confidence_score", "match_reason"),
        {"email_match": (0, 1), "date_within_window": (0, 1), "confirmed": (0, 1)},
    ),
    "jira_sync_log": Rules(("mapping_id",), ("mapping_id", "defect_id", "run_id", "status"), {"status": ("success", "error", "skipped"), "dry_run": (0, 1)}),
}


def valid(table: str):
    """Column that is true for rows that keep the table's NOT NULL and CHECK
    rules; Spark enforces neither."""
    rules = RULES[table]
    ok = F.lit(True)
    for c in rules.required:
        ok &= F.col(c).isNotNull()
    for c, values in rules.allowed.items():
        ok &= F.coalesce(F.col(c).isin(*values), F.lit(False))
    return ok


def split_valid(table: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the rules, quarantined rows)."""
    return rows.filter(valid(table)), rows.filter(~valid(table))
