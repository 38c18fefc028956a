from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import rules, text
from pulsegrid.operators import mapping, runs, tests


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("msg", "want"),
    [
        ("Element 'progress-bar' still visible after 20s timeout", "element progressbar still visible after 20s timeout"),
        ("Element with locator 'id=submit-btn' not found after 5 retries", "element with locator idsubmitbtn not found after NUM retries"),
        (None, "_empty_"), ("", "_empty_"), ("   ", "_empty_"), ("!!!", "_empty_"), ("é é a — b", "_empty_"),
    ],
)
def test_preprocess(spark, msg, want):
    assert one(spark, text.preprocess_message(F.lit(msg).cast("string"))) == want


@pytest.mark.parametrize(
    ("msg", "want"),
    [
        ("Element 'loading-spinner' still visible after 30s timeout", "timeout"),
        ("Element with locator 'id=submit-btn' not found after 5 retries", "element"),
        ("Expected HTTP status '200' but got '500' — Internal Server Error", "assertion"),
        ("CSV export contained 0 rows — expected at least 100 records", "data"),
        ("Connection refused — test environment unreachable", "environment"),
        ("Unable to launch browser — infrastructure error", "environment"),
        ("Network timeout: could not reach api.example.com after 30s", "unknown"),
        (None, "unknown"),
    ],
)
def test_labels(spark, msg, want):
    assert one(spark, rules.classify_labels(F.lit(msg).cast("string"))) == want


def test_classifiers_disagree(spark):
    m = F.lit("Timeout failure — waiting for 'overlay-modal' exceeded 15s")
    assert one(spark, rules.classify_dashboard(m, F.lit(None).cast("string"))) == "timeout"
    assert one(spark, rules.classify_sankey(m)) == "unknown"


def test_email_time_tokens(spark):
    assert one(spark, text.normalise_email(F.lit("[User@x.com](mailto:user@x.com)"))) == "user@x.com"
    assert one(spark, text.normalise_email(F.lit(" Nobody "))) == "nobody"
    assert one(spark, text.normalise_email(F.lit(None).cast("string"))) == ""
    assert str(one(spark, text.parse_issue_time(F.lit("2026-06-05T08:15:00.000+0530")))) == "2026-06-05 02:45:00"
    assert one(spark, text.parse_issue_time(F.lit("never"))) is None
    assert set(one(spark, text.stem_tokens(F.lit("TC_User_BulkImport")))) == {"user", "bulkimport"}
    assert one(spark, text.tag_at(F.lit("not json"), 0)) is None
    assert one(spark, text.seconds_between(F.lit(None).cast("timestamp"), F.current_timestamp())) == 0.0
    assert one(spark, text.short_run(F.lit("alpha_build_007"))) == "7"
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, text.cosine(zero, F.array(F.lit(1.0), F.lit(0.0)))) == 0.0


def pair(spark, summary, msg, vector=None, other=None, reporter="qa@x.com"):
    d = [("D", "P", summary, None, reporter, "Open", "High", pd.Timestamp("2026-01-08").to_pydatetime(), vector)]
    r = [("R", "run_1", "TC_User_BulkImport", "FAIL", msg, None, pd.Timestamp("2026-01-01").to_pydatetime(), other)]
    ds = spark.createDataFrame(d, "defect_id string, project string, summary string, description string, reporter_email string, status string, priority string, created timestamp, vector array<double>")
    rs = spark.createDataFrame(r, "result_id string, run_id string, test_name string, status string, failure_msg string, failure_kw string, run_timestamp timestamp, vector array<double>")
    return ds, rs


@pytest.mark.parametrize(
    ("summary", "msg", "vectors", "tester", "score", "confirmed"),
    [
        ("tc_user_bulkimport broke", "spinner", (None, None), None, 0.60, 1),
        ("tc_user_bulkimport spinner", "spinner", (None, None), "qa@x.com", 0.75, 1),
        ("user page", "nothing", (None, None), None, 0.25, 0),
        ("tc_user_bulkimport spinner", "spinner", ([1.0, 0.0], [0.9, 0.4358898943540674]), "other@x.com", 0.825, 0),
        ("user page", "nothing", ([1.0, 0.0], [-0.4, 0.9]), None, None, None),
        ("spinner", "spinner", (None, None), None, None, None),
    ],
)
def test_scores(spark, summary, msg, vectors, tester, score, confirmed):
    got = mapping.mappings(*pair(spark, summary, msg, *vectors), tester).collect()
    if score is None:
        assert not got
    else:
        assert (got[0].confidence_score, got[0].confirmed) == (score, confirmed)
        assert got[0].date_diff_days == 7.0


def test_band_join_is_the_cross_join(spark):
    rng = np.random.default_rng(0)
    t = pd.to_datetime("2026-01-01") + pd.to_timedelta(rng.integers(0, 60 * 86400, 150), "s")
    a = spark.createDataFrame([(int(k), x.to_pydatetime()) for k, x in enumerate(t[:60])], "i long, a timestamp")
    b = spark.createDataFrame([(int(k), x.to_pydatetime()) for k, x in enumerate(t[60:])], "j long, b timestamp")
    got = {(r.i, r.j) for r in mapping.band_join(a, b, F.col("a"), F.col("b"), 3.5).collect()}
    assert got == {(i, j) for i, x in enumerate(t[:60]) for j, y in enumerate(t[60:]) if abs((x - y).total_seconds()) <= 3.5 * 86400}


def test_features_against_rows(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, n in (("A", 11), ("B", 12), ("C", 21), ("D", 40)):
        for k in range(n):
            rows.append((f"{name}{k}", f"r_{k + 1}", k + 1, name, "FAIL" if rng.random() < 0.4 else "PASS", float(rng.integers(1, 99)), pd.Timestamp("2026-01-01") + pd.Timedelta(days=k), "s", '["a","b"]'))
    df = spark.createDataFrame([(*r[:6], r[6].to_pydatetime(), *r[7:]) for r in rows], "result_id string, run_id string, build_no int, test_name string, status string, duration_s double, run_timestamp timestamp, _source_db string, tags string")
    got = {(r.test_name, r.run_id): r for r in tests.flakiness_features(df).collect()}
    p = pd.DataFrame(rows, columns=["result_id", "run_id", "build_no", "test_name", "status", "d", "ts", "s", "tags"])
    seen = 0
    for name, g in p.groupby("test_name"):
        s, d = (g.status == "FAIL").astype(int).tolist(), g.d.tolist()
        for k in range(10, len(g) - 1):
            w = s[max(0, k - 19) : k + 1]
            r = got[name, f"r_{k + 1}"]
            seen += 1
            run = next((j for j, x in enumerate(reversed(w)) if x != w[-1]), len(w))
            assert r.flip_count_last_w == sum(x != y for x, y in zip(w, w[1:], strict=False))
            assert (r.consecutive_failures, r.consecutive_passes) == ((run, 0) if w[-1] else (0, run))
            assert abs(r.fail_rate_last_5 - np.mean(w[-5:])) < 1e-12 and r.target == s[k + 1]
            ok = [x for x, y in zip(d[max(0, k - 19) : k + 1], w, strict=True) if not y][-5:]
            assert not ok or abs(r.avg_dur_pass_5 - np.mean(ok)) < 1e-9
    assert seen == len(got) == 0 + 1 + 10 + 29


def test_drift_fixture(spark):
    rows = [(f"r_{k + 1}", k + 1, "T", "PASS", 4.0 if k < 15 else 12.0, "s") for k in range(20)]
    df = spark.createDataFrame(rows, "run_id string, build_no int, test_name string, status string, duration_s double, _source_db string")
    t = tests.drift_flags(df).orderBy("build_no").collect()
    assert [r.drift_flagged for r in t] == [False] * 15 + [True] * 5
    assert [r.drift_confirmed for r in t] == [False] * 17 + [True] * 3
    assert tests.drift_flags(df.filter("build_no < 20")).filter("drift_flagged").count() == 0


def test_rolling_z_against_pandas(spark):
    x = np.round(np.random.default_rng(2).uniform(50, 100, 40), 1)
    df = spark.createDataFrame([(f"r_{k}", k, float(v), "t", "s") for k, v in enumerate(x)], "run_id string, build_no int, pass_rate_pct double, team string, _source_db string")
    got = [r.z_score for r in runs.with_rolling_z(df).orderBy("build_no").collect()]
    roll = pd.Series(x).rolling(10, min_periods=3)
    want = (roll.mean().shift(1) - x) / roll.std().shift(1).fillna(5.0).clip(lower=1.0)
    assert all((a is None and np.isnan(b)) or abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
