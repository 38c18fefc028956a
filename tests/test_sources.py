from __future__ import annotations

import json
import sqlite3

from pyspark.sql import functions as F

from pulsegrid.operators import mapping, models, runs, state, tests, writeback
from pulsegrid.schemas import SCHEMAS
from pulsegrid.sources import jira, run_folders, sqlite_db, synth
from pulsegrid.streaming import ingest

TEST = '<test id="t" name="{name}">{tags}{body}<status status="{status}" starttime="20260101 00:00:00.000" endtime="20260101 00:00:02.500">{msg}</status></test>'


def folder(root, run_id, xml_tests, meta):
    d = root / run_id
    d.mkdir(parents=True)
    span = 'starttime="20260101 00:00:00.000" endtime="20260101 00:01:00.000"'
    (d / "output.xml").write_text(f'<robot><suite id="s" name="S">{xml_tests}<status status="FAIL" {span}/></suite></robot>')
    if meta is not None:
        (d / "ci_metadata.json").write_text(json.dumps(meta))


META = {"build_no": 1, "timestamp": "2026-01-01T00:00:00", "total": 3, "passed": 1, "failed": 2, "pass_rate_pct": 33.3}


def test_run_folders(spark, tmp_path):
    kw = '<kw name="First"><status status="FAIL"/></kw><kw name="Outer"><kw name="Inner"><msg level="FAIL">deep</msg><status status="FAIL"/></kw><status status="PASS"/></kw>'
    good = (
        TEST.format(name="TC_A", tags="<tag> a </tag><tag> </tag>", body="", status="PASS", msg="")
        + TEST.format(name="TC_B", tags="", body=kw, status="FAIL", msg="")
        + TEST.format(name="TC_C", tags="", body="", status="FAIL", msg="text &amp; more")
        + '<test name="TC_None"></test>'
    )
    folder(tmp_path, "alpha_build_001", good, META)
    folder(tmp_path, "beta_build_002", TEST.format(name="TC_A", tags="", body="", status="SKIP", msg=""), META)
    folder(tmp_path, "gamma_build_003", TEST.format(name="TC_A", tags="", body="", status="PASS", msg=""), None)
    folder(tmp_path, "alpha_build_004", TEST.format(name="TC_A", tags="", body="", status="PASS", msg=""), META | {"pass_rate_pct": 0.0})
    folder(tmp_path, "alpha_build_005", '<test name="x"><broken></test>', META)
    folder(tmp_path, "other_006", "", META)
    p = run_folders.parse(spark, str(tmp_path))
    assert {r.run_id for r in p.runs.collect()} == {"alpha_build_001", "alpha_build_004"}
    rows = {r.test_name: r for r in p.results.filter("run_id = 'alpha_build_001'").collect()}
    assert set(rows) == {"TC_A", "TC_B", "TC_C"}
    assert rows["TC_A"].tags == ["a"] and rows["TC_A"].duration_s == 2.5
    assert (rows["TC_B"].failure_msg, rows["TC_B"].failure_kw) == ("deep", "Inner")
    assert rows["TC_C"].failure_msg == "text & more"
    errors = {r.run_id: r.error_msg for r in p.errors.collect()}
    assert set(errors) == {"beta_build_002", "gamma_build_003", "alpha_build_005"}
    assert "no ci_metadata" in errors["gamma_build_003"] and "rules" in errors["beta_build_002"]


def test_ingest_twice_stream_and_force(spark, tmp_path):
    root = tmp_path / "runs"
    synth.write_folders(str(root), synth.Plan(runs=4))
    store = ingest.Store(spark, str(tmp_path / "store"))
    assert ingest.ingest(store, str(root)) == {"runs": 4, "results": 80, "errors": 0, "skipped": 0}
    assert ingest.ingest(store, str(root))["skipped"] == 4
    assert ingest.ingest(store, str(root), force=True)["runs"] == 4
    assert store.table("test_results").read().count() == 80
    streamed = ingest.Store(spark, str(tmp_path / "streamed"))
    for _ in range(2):
        ingest.stream(streamed, str(root), str(tmp_path / "cp"), files_per_batch=3).awaitTermination()
    assert streamed.table("runs").read().count() == 4
    key = ["run_id", "test_name", "status", "duration_s", "failure_msg", "failure_kw"]
    want = synth.history(spark, synth.Plan(runs=4))[1].select(*key).collect()
    assert sorted(streamed.table("test_results").read().select(*key).collect(), key=str) == sorted(want, key=str)


def test_issue_shapes(spark, tmp_path):
    flat = {"key": "A-1", "summary": "s", "created": "2026-06-05T08:15:00.000+0000", "reporter_email": "[U@x.com](mailto:u@x.com)", "labels": ["l"], "components": [{"name": "c"}], "status": "Open"}
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "one"}, {"type": "hardBreak"}, {"type": "text", "text": "two"}]}]}
    nested = {
        "key": "B-2",
        "fields": {
            "summary": "n", "description": doc, "created": "2026-06-05T08:15:00.000+0530", "reporter": {"displayName": "N", "emailAddress": "N@X.com"},
            "status": {"name": "Triage"}, "project": {"key": "B"}, "components": [{"name": "k"}], "comment": {"comments": [{"body": "hello"}]},
        },
    }
    (tmp_path / "one.json").write_text(json.dumps(flat))
    (tmp_path / "list.json").write_text(json.dumps([nested, {"summary": "no key"}, {"key": "C-3", "created": "never"}]))
    (tmp_path / "issues.json").write_text(json.dumps({"issues": [flat | {"key": "D-4"}]}))
    (tmp_path / "map.json").write_text(json.dumps({"x": flat | {"key": "E-5"}}))
    got = {r.defect_id: r for r in jira.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"A-1", "B-2", "D-4", "E-5"}
    assert got["A-1"].reporter_email == "u@x.com" and got["A-1"].components == ["c"] and got["A-1"].labels == ["l"]
    b = got["B-2"]
    assert (b.description, b.status, b.project, b.reporter_email, b.components) == ("one\n\n\ntwo", "Triage", "B", "n@x.com", ["k"])
    assert str(b.created) == "2026-06-05 02:45:00"
    assert jira.from_list(spark, [nested]).count() == 1
    raw = spark.createDataFrame([(json.dumps(nested),)], "raw_json string")
    assert jira.comment_texts(raw).first().comments == ["hello"]


def test_rest_pages_and_retries(spark):
    calls, waits = [], []

    def transport(method, path, query, body):
        calls.append(query.get("startAt"))
        if len(calls) == 2:
            return 429, {}
        at = query["startAt"]
        return 200, {"total": 3, "issues": [{"key": f"K-{k}", "fields": {"summary": "s", "created": "2026-01-01T00:00:00.000+0000"}} for k in range(at, min(3, at + 2))]}

    client = jira.Client(transport, page=2, sleep=waits.append)
    assert jira.fetch(spark, client, jira.jql(["K"])).count() == 3
    assert calls == [0, 2, 2] and waits == [1.0, 1.0]
    assert jira.jql(["A", "B"], "x = 1") == 'project IN ("A", "B") AND issuetype = Bug AND (x = 1) ORDER BY created DESC'
    env = {"CONFIRM_THRESHOLD": "0.7", "AB_C_WINDOW_DAYS": "3"}
    assert jira.project_config("ab-c", env) == jira.ProjectConfig(0.7, "", 3)


def test_sqlite_variants(spark, tmp_path):
    v2, v1 = str(tmp_path / "new.db"), str(tmp_path / "old.db")
    with sqlite3.connect(v2) as c:
        c.executescript(
            "CREATE TABLE runs(run_id, team, suite_name, job_name, build_no, timestamp, duration_s, total, passed, failed, pass_rate_pct, environment, executor);"
            "CREATE TABLE test_results(result_id, run_id, suite_name, test_name, status, duration_s, failure_msg, failure_kw, tags);"
            "INSERT INTO runs VALUES('alpha_build_001','T','S',NULL,1,'2026-01-01T00:00:00',NULL,1,1,0,100.0,'e','x');"
            "INSERT INTO test_results VALUES('r1','alpha_build_001','S','TC','PASS',NULL,NULL,NULL,'[]');"
        )
    with sqlite3.connect(v1) as c:
        c.executescript(
            "CREATE TABLE runs(run_id, build_number, timestamp, total_tests, passed, failed, pass_rate, environment, executor);"
            "CREATE TABLE tests(test_id, run_id, test_name, status, duration); CREATE TABLE test_results(test_id); CREATE TABLE failures(test_id, message, keyword_name);"
            "INSERT INTO runs VALUES(7,7,'2026-01-02T00:00:00',1,0,1,0.0,'e','x'); INSERT INTO tests VALUES(1,7,'TC','FAIL',2.5);"
            "INSERT INTO test_results VALUES(1); INSERT INTO failures VALUES(1,'boom','KW');"
        )
    assert (sqlite_db.variant(v1), sqlite_db.variant(v2)) == ("v1", "v2")
    r, t, errors = sqlite_db.read_databases(spark, [v1, v2, str(tmp_path / "none.db")])
    assert not errors and {x._source_db for x in r.collect()} == {"new", "old"}
    rows = {x._source_db: x for x in t.collect()}
    assert rows["old"].failure_msg == "boom" and rows["new"].duration_s == 0.0
    assert sqlite_db.with_run_columns(t, r).filter("build_no is null").count() == 0


def test_write_back_is_idempotent(spark, tmp_path):
    maps = spark.sql(
        "SELECT 'D__R' mapping_id, 'D' defect_id, 'R' result_id, 'run_1' run_id, 'TC' test_name, 0.9D confidence_score, 'why' match_reason, timestamp'2026-01-01' run_timestamp, 1 confirmed"
        " UNION ALL SELECT 'E__R', 'E', 'R', 'run_1', 'TC', 0.8D, 'why', timestamp'2026-01-01', 1 UNION ALL SELECT 'F__R', 'F', 'R', 'run_1', 'TC', 0.8D, 'why', timestamp'2026-01-01', 0"
    )
    comments = spark.createDataFrame([("E", [f"{writeback.MARK} x\nCI Run     : run_1"])], "defect_id string, comments array<string>")
    log = state.Table(spark, str(tmp_path / "log"), SCHEMAS["jira_sync_log"], ["mapping_id"])
    out = str(tmp_path / "sent")

    def connect():
        def send(issue, comment, field):
            with open(out, "a") as f:
                f.write(json.dumps([issue, json.loads(comment)["content"][1]["content"][0]["text"], field]) + "\n")

        return send

    dry = writeback.write_back(maps, log, comments, connect, "array", dry_run=True)
    assert dry.count() == 2 and log.read().count() == 0
    got = {r.mapping_id: r.status for r in writeback.write_back(maps, log, comments, connect, "array", pause=0).collect()}
    assert got == {"D__R": "success", "E__R": "skipped"}
    with open(out) as f:
        assert [json.loads(x) for x in f] == [["D", "CI Run     : run_1", '["run_1"]']]
    assert mapping.pending_sync(maps, log.read()).count() == 1  # the skipped one is no success


def test_planted_effects_are_found(spark, tmp_path):
    run, result = (t.persist() for t in synth.history(spark))
    drift = {r.test_name for r in tests.drift_report(result).collect()}
    assert {"TC_Dashboard_ExportChart", "TC_User_BulkImport"} <= drift <= {"TC_Dashboard_ExportChart", "TC_User_BulkImport", "TC_Login_ValidCredentials"}
    one = run.withColumn("_source_db", F.lit("s"))
    odd = {r.build_no for r in runs.with_rolling_z(one).filter("anomaly").collect()}
    assert {36, 37} & odd
    forest = {r.build_no for r in models.run_anomaly_report(one, result).filter("if_anomaly").collect()}
    assert {36, 37} <= forest and len(forest) <= 6
    clusters = models.failure_clusters(result)
    from pulsegrid.functions import rules
    from pulsegrid.operators import stats

    t = clusters.select(rules.classify_labels(F.col("failure_msg")).alias("a"), F.col("cluster_label").alias("b"))
    assert stats.adjusted_rand(t, "a", "b").first().ari >= 0.9
    model = models.fit_clusters(result)
    path = str(tmp_path / "clusters")
    model.save(spark, path)
    assert models.ClusterModel.load(spark, path) == model
    new = spark.createDataFrame([("CSV export contained 5 rows — expected at least 100 records", "Export_Csv"), ("anything", "Environment_Setup")], "failure_msg string, failure_kw string")
    got = models.assign_clusters(new, model).orderBy("failure_kw").collect()
    assert [r.cluster_category for r in got] == ["environment", "data"] and got[0].confidence == 1.0
    scored = models.validated_forest(result)
    assert scored["test_auc"].first().auc > 0.75


def test_demo_history(spark):
    run, result = synth.history(spark, synth.DEMO)
    assert run.count() == 100 and result.count() == 2000 and result.filter("_source_db <> 'demo'").count() == 0
    rate = {r.build_no: r.pass_rate_pct for r in run.collect()}
    assert max(rate[36], rate[37]) < 50 and rate[90] > rate[36]
    assert result.filter("status = 'FAIL' and failure_msg is null and build_no not in (36, 37)").count() == 0
    assert result.filter("status = 'PASS' and failure_msg is not null").count() == 0


def test_command_line(tmp_path, spark, capsys):
    from pulsegrid import cli

    store, root = str(tmp_path / "s"), str(tmp_path / "r")
    cli.main(["--store", store, "generate", "--out", root, "--runs", "3"])
    (tmp_path / "d.json").write_text(json.dumps([{"key": "D-1", "summary": "TC_Login_OAuthCallback spinner timeout", "created": "2026-01-02T00:00:00.000+0000", "project": "P"}]))
    cli.main(["--store", store, "ingest", "--runs-dir", root])
    cli.main(["--store", store, "defects", "--file", str(tmp_path / "d.json")])
    cli.main(["--store", store, "map"])
    cli.main(["--store", store, "sync", "--dry-run"])
    cli.main(["--store", store, "report", "coverage"])
    out = capsys.readouterr().out
    assert '"runs": 3' in out and '"inserted": 1' in out and "total_defects" in out


def test_delivery_over_rest(monkeypatch):
    sent = []

    def transport():
        return lambda method, path, query, body: sent.append((method, path, body)) or (201 if method == "POST" else 500, {})

    monkeypatch.setattr("pulsegrid.sources.jira.time.sleep", lambda s: None)
    monkeypatch.setattr(writeback, "Client", lambda t: jira.Client(t, sleep=lambda s: None))
    send = writeback.to_tracker(transport, "customfield_1")()
    try:
        send("D-1", '{"a": 1}', '["run"]')
    except RuntimeError as e:
        assert "field" in str(e)
    assert sent[0] == ("POST", "/rest/api/3/issue/D-1/comment", {"body": {"a": 1}})
    assert sent[1] == ("PUT", "/rest/api/3/issue/D-1", {"fields": {"customfield_1": ["run"]}})


# --- embedding cache -------------------------------------------------------------


def test_only_missing_and_changed_texts_are_embedded(spark):
    import numpy as np

    from pulsegrid.operators import embeddings

    def encoder(texts):
        assert len(texts) <= 3
        if "bad" in texts:
            raise ValueError("cannot")
        return np.array([[len(t), 1.0] for t in texts])

    wanted = spark.createDataFrame([(f"e{k}", "jira_defect", "t" * k) for k in range(10)] + [("none", "test_result", None), ("bad", "test_result", "bad")], "entity_id string, entity_type string, source_text string").coalesce(1)
    empty = spark.createDataFrame([], SCHEMAS["embeddings"])
    cache = embeddings.refreshed(empty, wanted.filter("entity_id <> 'bad'"), "m", encoder, batch=3)
    first = {r.entity_id: r for r in cache.collect()}
    assert len(first) == 11 and all(list(r.vector) == [len(r.source_text), 1.0] for r in first.values())
    changed = wanted.withColumn("source_text", F.when(F.col("entity_id") == "e4", "other").otherwise(F.col("source_text")))
    todo = {r.entity_id for r in embeddings.pending(changed.fillna({"source_text": ""}), cache, "m").collect()}
    assert todo == {"e4", "bad"}
    assert embeddings.pending(wanted, cache, "another").count() == embeddings.pending(wanted, cache, "m", force=True).count() == 12
    again = {r.entity_id: list(r.vector) for r in embeddings.refreshed(cache, changed.filter("entity_id <> 'bad'"), "m", encoder, batch=3).collect()}
    assert again["e4"] == [5.0, 1.0] and "bad" not in again and len(again) == 11
    # one bad text costs its batch nothing, and its error is told
    tried = {r.entity_id: r for r in embeddings.attempted(wanted, encoder, 3).collect()}
    assert len(tried) == 12 and [k for k, r in tried.items() if r.vector is None] == ["bad"] and tried["bad"].error == "ValueError: cannot"


# --- the search as a data source ------------------------------------------------------


def test_pages_are_partitions_and_a_stream(spark, tmp_path):
    from pulsegrid.sources import issue_source

    def connect():
        def transport(method, path, query, body):
            at, n = query["startAt"], query["maxResults"]
            some = [{"key": f"K-{k}", "fields": {"summary": "s", "created": "2026-01-01T00:00:00.000+0000"}} for k in range(at, min(23, at + n))]
            return 200, {"total": 23, "issues": some}

        return jira.Client(transport, page=5, page_pause=0.0)

    want = sorted(f"K-{k}" for k in range(23))
    rows = issue_source.read_issues(spark, connect, "project = K")
    assert rows.rdd.getNumPartitions() == 5 and sorted(r.defect_id for r in rows.collect()) == want
    out = str(tmp_path / "out")
    q = issue_source.stream_issues(spark, connect, "project = K").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start(out)
    import time

    for _ in range(120):
        time.sleep(0.5)
        if q.exception() or any((tmp_path / "out").glob("*.parquet")) and spark.read.schema(SCHEMAS["jira_defects"]).parquet(out).count() == 23:
            break
    q.stop()
    assert not q.exception() and sorted(r.defect_id for r in spark.read.parquet(out).collect()) == want


def test_issues_created_during_a_search_are_neither_lost_nor_repeated(spark):
    """An issue arrives after each page, one goes, and minutes hold many issues."""
    from pulsegrid.sources import issue_source

    held = [{"key": f"K-{k}", "fields": {"created": f"2026-01-01T00:0{k // 8}:{k % 8:02d}.000+0000"}} for k in range(23)]
    asked, made = [], [22]

    def transport(method, path, query, body):
        asked.append(query["jql"])
        assert query["jql"].endswith("ORDER BY created ASC, key ASC") and "DESC" not in query["jql"]
        order = sorted(held, key=lambda i: (i["fields"]["created"], int(i["key"][2:])))
        at = query["startAt"]
        got = order[at : at + query["maxResults"]]
        if made[-1] < 29:
            made.append(made[-1] + 1)
            held.append({"key": f"K-{made[-1]}", "fields": {"created": "2026-01-02T00:00:00.000+0000"}})
        return 200, {"total": len(order), "issues": got}

    source = issue_source.issue_source(lambda: jira.Client(transport, page=5, page_pause=0.0), jira.jql(["K"]))
    reader = source({}).simpleStreamReader(None)
    at, seen = reader.initialOffset(), []
    while True:
        rows, end = reader.read(at)
        got = [json.loads(r[0])["key"] for r in rows]
        assert got == [json.loads(r[0])["key"] for r in reader.readBetweenOffsets(at, end)]  # as after a failure
        if not got:
            break
        if len(seen) == 10:
            held.pop(0)  # what is gone moves no other issue out of sight
        seen += got
        at = end
    assert seen == [f"K-{k}" for k in range(30)]
    assert any('created >= "2025-12-31 00:0' in q for q in asked)


def test_cursors_compare_times_of_any_zone():
    from pulsegrid.sources.issue_source import place

    a, b = ({"created": c, "key": k} for c, k in (("2026-01-01T10:00:00.000+0100", "K-10"), ("2026-01-01T09:00:00.000Z", "K-9")))
    assert place(b) < place(a) and place({"created": "", "key": ""}) < place(b)


def test_sqlite_slices_are_ranges_of_row_ids(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "many.db")
    with sqlite3.connect(path) as c:
        c.executescript("CREATE TABLE runs(run_id, team); CREATE TABLE bare(a PRIMARY KEY) WITHOUT ROWID; CREATE TABLE none(a);")
        c.executemany("INSERT INTO runs VALUES(?, ?)", [(str(k), "t") for k in range(1000)])
        c.execute("DELETE FROM runs WHERE run_id % 3 = 0")
        c.execute("INSERT INTO bare VALUES('x')")
    rows = sqlite_db.scan(spark, path, "SELECT r.run_id FROM runs r", "run_id string", "runs r", 7)
    assert rows.rdd.getNumPartitions() == 7
    sizes = rows.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(sizes) == rows.distinct().count() == 666 and max(sizes) <= 100
    assert sqlite_db.scan(spark, path, "SELECT a FROM bare", "a string", "bare", 4).count() == 1
    assert sqlite_db.scan(spark, path, "SELECT a FROM none", "a string", "none", 4).count() == 0
    # a slice asks the database for its range only
    asked, reader = [], sqlite_db.SqliteSource({"path": path, "query": "SELECT run_id FROM runs", "from": "runs", "slices": "4"}).reader(rows.schema)
    plain = sqlite3.connect

    def traced(*a, **k):
        db = plain(*a, **k)
        db.set_trace_callback(asked.append)
        return db

    monkeypatch.setattr(sqlite_db.sqlite3, "connect", traced)
    list(reader.read(reader.partitions()[1]))
    assert any("rowid >= 251 AND runs.rowid < 501" in q for q in asked)
