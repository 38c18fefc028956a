"""Command line: ``python -m pulsegrid.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
from functools import partial

from pyspark.sql import functions as F

from .operators import mapping, models, tests, writeback
from .session import build
from .sources import issue_source, jira, synth
from .streaming.ingest import Store, ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pulsegrid")
    p.add_argument("--store", default="./pulsegrid-store", help="folder of the canonical tables")
    p.add_argument("--master", default=None)
    c = p.add_subparsers(dest="command", required=True)
    g = c.add_parser("generate", help="write synthetic run folders")
    g.add_argument("--out", required=True)
    g.add_argument("--runs", type=int, default=100)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--demo", action="store_true")
    i = c.add_parser("ingest", help="load run folders")
    i.add_argument("--runs-dir", required=True)
    i.add_argument("--force", action="store_true")
    d = c.add_parser("defects", help="load issue-tracker files")
    d.add_argument("--file", required=True)
    d.add_argument("--overwrite", action="store_true")
    m = c.add_parser("map", help="map defects to failing tests")
    m.add_argument("--tester-email", default=None)
    m.add_argument("--window-days", type=float, default=7.0)
    m.add_argument("--min-confidence", type=float, default=mapping.STORE_FROM)
    m.add_argument("--overwrite", action="store_true")
    u = c.add_parser("duplicates", help="list duplicate defects")
    u.add_argument("--window-days", type=float, default=14.0)
    u.add_argument("--threshold", type=float, default=0.90)
    f = c.add_parser("fetch", help="load issues over REST (JIRA_BASE_URL, JIRA_EMAIL, JIRA_TOKEN)")
    f.add_argument("--project", action="append", required=True)
    f.add_argument("--extra-jql", default=None)
    f.add_argument("--since-days", type=int, default=None)
    f.add_argument("--test-connection", action="store_true")
    w = c.add_parser("sync", help="write confirmed mappings back")
    w.add_argument("--dry-run", action="store_true")
    w.add_argument("--force", action="store_true")
    w.add_argument("--field", default="", help="field that gets the run id")
    w.add_argument("--field-kind", default="")
    w.add_argument("--dashboard-url", default=None)
    r = c.add_parser("report", help="print a report")
    r.add_argument("name", choices=["coverage", "anomalies", "flaky", "predictions", "drift", "clusters"])
    r.add_argument("--rows", type=int, default=20)
    return p


def _transport() -> jira.Transport:
    return jira.http_transport(os.environ["JIRA_BASE_URL"], os.environ["JIRA_EMAIL"], os.environ["JIRA_TOKEN"])


def _client(*address: str) -> jira.Client:
    return jira.Client(jira.http_transport(*address))


def frames(store: Store):
    """The stored tables in the shape that the operators take."""
    run = store.table("runs").read().withColumn("_source_db", F.lit("store"))
    head = run.select("run_id", "team", "build_no", F.col("timestamp").alias("run_timestamp"), F.col("pass_rate_pct").alias("run_pass_rate"), "_source_db")
    result = store.table("test_results").read().join(head, "run_id").withColumn("tags", F.to_json("tags"))
    return run, result


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "generate":
        print(len(synth.write_folders(a.out, synth.Plan(a.runs, a.seed, demo=a.demo))), "run folders")
        return 0
    spark = build(a.master)
    store = Store(spark, a.store)
    if a.command == "ingest":
        print(json.dumps(ingest(store, a.runs_dir, a.force)))
    elif a.command == "defects":
        rows = jira.read_files(spark, a.file).withColumn("ingested_at", F.current_timestamp())
        table = store.table("jira_defects")
        if a.overwrite:
            print(json.dumps({"stored": table.replace(rows).count()}))
        else:
            print(json.dumps(table.ignore(rows)))
    elif a.command == "fetch":
        client = jira.Client(_transport())
        if a.test_connection:
            return 0 if client.test_connection() else 1
        # the workers fetch the pages; they get the address and token, not the environment
        connect = partial(_client, os.environ["JIRA_BASE_URL"], os.environ["JIRA_EMAIL"], os.environ["JIRA_TOKEN"])
        rows = issue_source.read_issues(spark, connect, jira.jql(a.project, a.extra_jql, a.since_days)).withColumn("ingested_at", F.current_timestamp())
        print(json.dumps({"stored": store.table("jira_defects").replace(rows).count()}))
    elif a.command == "sync":
        maps = store.table("defect_test_mappings").read()
        comments = jira.comment_texts(store.table("jira_defects").read().select("raw_json"))
        out = writeback.write_back(
            maps, store.table("jira_sync_log"), comments, writeback.to_tracker(_transport, a.field), a.field_kind, a.dry_run, a.force, a.dashboard_url
        )
        (out if a.dry_run else mapping.sync_stats(out)).show(50, False)
    elif a.command == "map":
        _, result = frames(store)
        found = mapping.mappings(store.table("jira_defects").read(), result, a.tester_email, a.window_days, a.min_confidence).withColumn("mapped_at", F.current_timestamp())
        table = store.table("defect_test_mappings")
        if a.overwrite:
            table.overwrite(found)
        else:
            table.ignore(found)
        print(json.dumps({"mappings": table.read().count()}))
    elif a.command == "duplicates":
        mapping.duplicates(store.table("jira_defects").read(), a.window_days, a.threshold).orderBy(F.desc("similarity")).show(50, False)
    else:
        run, result = frames(store)
        made = {
            "coverage": lambda: mapping.coverage_kpis(store.table("jira_defects").read(), result, store.table("defect_test_mappings").read()),
            "anomalies": lambda: models.run_anomaly_report(run, result).filter("is_anomalous"),
            "flaky": lambda: tests.flaky_scores(result).orderBy(F.desc("flip_count"), "test_name"),
            "predictions": lambda: tests.enriched_predictions(models.flakiness_predictions(result)),
            "drift": lambda: tests.drift_report(result, ("test_name",)),
            "clusters": lambda: models.failure_clusters(result).groupBy("cluster_label", "cluster_category").count(),
        }
        made[a.name]().show(a.rows, False)
    return 0



if __name__ == "__main__":
    raise SystemExit(main())
