"""Writing confirmed mappings back to the issue tracker, idempotently."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.jira import Client
from . import mapping, state

#: Fixed: the mark and line by which a posted comment is known again.
MARK = "[automation-analytics]"


def comment_lines(dashboard_url: str | None = None) -> Column:
    lines = [
        F.lit(f"{MARK} Linked by pulsegrid"),
        F.concat(F.lit("CI Run     : "), "run_id"),
        F.concat(F.lit("Test       : "), "test_name"),
        F.format_string("Score      : %.3f", "confidence_score"),
        F.concat(F.lit("Reason     : "), "match_reason"),
        F.concat(F.lit("Run time   : "), F.date_format("run_timestamp", "yyyy-MM-dd'T'HH:mm:ss")),
    ]
    if dashboard_url:
        lines.append(F.lit(f"Dashboard  : {dashboard_url}"))
    return F.array(*lines)


def with_comment(maps: DataFrame, dashboard_url: str | None = None) -> DataFrame:
    """comment_json: a document of one paragraph per line."""
    paragraph = F.transform(comment_lines(dashboard_url), lambda t: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content")))
    return maps.withColumn("comment_json", F.to_json(F.struct(F.lit(1).alias("version"), F.lit("doc").alias("type"), paragraph.alias("content"))))


def with_posted(maps: DataFrame, comments: DataFrame) -> DataFrame:
    """already_posted: an existing comment has the mark and the run's line.
    ``comments`` is (defect_id, comments)."""
    t = maps.join(comments, "defect_id", "left")
    line = F.concat(F.lit("CI Run     : "), F.col("run_id"))
    found = F.exists(F.coalesce("comments", F.array().cast("array<string>")), lambda c: c.contains(MARK) & c.contains(line))
    return t.withColumn("already_posted", found).drop("comments")


def with_field(maps: DataFrame, kind: Column) -> DataFrame:
    """field_json: the run id in the shape that the field's type asks for."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    run = F.col("run_id")
    shape = F.when(k == "array", F.to_json(F.array(run))).when(k.isin("option", "select"), F.to_json(F.struct(run.alias("value")))).otherwise(F.concat(F.lit('"'), run, F.lit('"')))
    return maps.withColumn("field_json", shape)


#: (issue, comment_json, field_json) -> None, raising if it was not delivered.
Deliver = Callable[[str, str, str | None], None]


def to_tracker(transport: Callable[[], Callable], field: str = "") -> Callable[[], Deliver]:
    """A ``connect`` for :func:`deliver` over the tracker's REST interface;
    ``transport`` makes a transport in each task, ``field`` names the field that
    gets the run id, if any."""

    def connect() -> Deliver:
        client = Client(transport())

        def send(issue: str, comment: str, value: str | None) -> None:
            status = client.comment(issue, json.loads(comment))
            if status not in (200, 201):
                raise RuntimeError(f"comment: status {status}")
            if field and value is not None:
                status = client.set_field(issue, field, json.loads(value))
                if status not in (200, 204):
                    raise RuntimeError(f"field: status {status}")

        return send

    return connect


def deliver(payload: DataFrame, connect: Callable[[], Deliver], pause: float = 0.3) -> DataFrame:
    """Rows of jira_sync_log: one delivery per row, errors recorded as errors.
    ``connect`` is called once per task. A retried task delivers again, which the
    comment's mark makes harmless."""
    ship(payload.sparkSession)
    schema = "mapping_id string, defect_id string, run_id string, status string, error_msg string"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = connect()
        for b in it:
            status, errors = [], []
            for r in b.itertuples():
                if r.already_posted:
                    status.append("skipped")
                    errors.append(None)
                    continue
                try:
                    send(r.defect_id, r.comment_json, r.field_json)
                    status.append("success")
                    errors.append(None)
                except Exception as e:  # the log keeps what went wrong
                    status.append("error")
                    errors.append(str(e))
                time.sleep(pause)
            yield b[["mapping_id", "defect_id", "run_id"]].assign(status=status, error_msg=errors)

    return payload.mapInPandas(run, schema)


def write_back(maps: DataFrame, log: state.Table, comments: DataFrame, connect: Callable[[], Deliver], field_kind: str = "", dry_run: bool = False, force: bool = False, dashboard_url: str | None = None, pause: float = 0.3) -> DataFrame:
    """Delivers the pending mappings, best first, and logs them; a dry run returns
    the payload and writes nothing."""
    todo = mapping.pending_sync(maps, log.read(), force)
    payload = with_field(with_posted(with_comment(todo, dashboard_url), comments), F.lit(field_kind)).orderBy(F.desc("confidence_score"), "mapping_id")
    if dry_run:
        return payload
    done = deliver(payload, connect, pause).withColumns({"dry_run": F.lit(0), "written_at": F.current_timestamp()})
    log.replace(done)
    return log.read()
