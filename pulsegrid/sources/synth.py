"""Seeded synthetic CI history with planted effects: flaky and failing tests,
dependency risk, failure waves, anomalous runs and three duration patterns.

Each run is drawn from its own generator, seeded by (seed, run number), so runs
are made in parallel and come out the same however they are dealt.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Fixed: the suite's tests as (name, feature, priority, category, failure
#: probability, first family, second family, share of the first).
TESTS = (
    ("TC_Login_ValidCredentials", "login", "high", "stable", 0.0, None, None, None),
    ("TC_Login_InvalidPassword", "login", "high", "stable", 0.0, None, None, None),
    ("TC_Login_SessionTimeout", "login", "high", "stable", 0.0, None, None, None),
    ("TC_Login_AccountLockout", "login", "medium", "stable", 0.0, None, None, None),
    ("TC_Login_MFAVerification", "login", "high", "flaky-mild", 0.30, "timeout", "assertion", 0.70),
    ("TC_Dashboard_FilterByDate", "dashboard", "medium", "stable", 0.0, None, None, None),
    ("TC_Dashboard_Pagination", "dashboard", "medium", "stable", 0.0, None, None, None),
    ("TC_Dashboard_ExportChart", "dashboard", "medium", "stable", 0.0, None, None, None),
    ("TC_Dashboard_SearchBar", "dashboard", "medium", "stable", 0.0, None, None, None),
    ("TC_User_CreateAccount", "usermgmt", "high", "stable", 0.0, None, None, None),
    ("TC_User_EditProfile", "usermgmt", "medium", "stable", 0.0, None, None, None),
    ("TC_User_DeleteAccount", "usermgmt", "high", "stable", 0.0, None, None, None),
    ("TC_User_PasswordReset", "usermgmt", "medium", "stable", 0.0, None, None, None),
    ("TC_Login_SSORedirect", "login", "high", "flaky-mild", 0.35, "timeout", "element", 0.70),
    ("TC_Dashboard_LoadWidget", "dashboard", "medium", "flaky-moderate", 0.50, "element", "timeout", 0.80),
    ("TC_Dashboard_RefreshData", "dashboard", "medium", "flaky-moderate", 0.55, "assertion", "data", 0.60),
    ("TC_User_BulkImport", "usermgmt", "medium", "flaky-heavy", 0.65, "data", "assertion", 0.70),
    ("TC_User_RoleAssignment", "usermgmt", "high", "consistently_failing", 0.80, "assertion", "data", 0.65),
    ("TC_User_BatchExport", "usermgmt", "medium", "consistently_failing", 0.75, "data", "element", 0.65),
    ("TC_Login_OAuthCallback", "login", "high", "consistently_failing", 0.70, "timeout", "element", 0.70),
)
#: Fixed: test -> (tests it depends on, weight).
DEPENDS = {
    "TC_Dashboard_FilterByDate": ("TC_Login_ValidCredentials", 0.4),
    "TC_Dashboard_Pagination": ("TC_Login_ValidCredentials", 0.4),
    "TC_Dashboard_ExportChart": ("TC_Dashboard_FilterByDate", 0.5),
    "TC_Dashboard_LoadWidget": ("TC_Login_ValidCredentials", 0.6),
    "TC_User_BulkImport": ("TC_User_CreateAccount", 0.5),
}
#: Fixed: failure waves as (first build, last build, family, strength, families
#: that a test must share).
WAVES = (
    (34, 37, "environment", 0.82, {"environment", "timeout"}),
    (22, 33, "element", 0.74, {"element", "timeout"}),
    (31, 44, "assertion", 0.68, {"assertion", "data"}),
    (33, 46, "timeout", 0.70, {"timeout", "environment"}),
    (50, 63, "data", 0.60, {"data", "assertion"}),
)
#: Fixed: target pass rates by last build, and duration ranges by pattern.
RATES = ((25, 0.70, 0.80), (35, 0.65, 0.72), (45, 0.60, 0.65), (75, 0.65, 0.80), (10**9, 0.82, 0.95))
DURATIONS = {
    "TC_Login_ValidCredentials": lambda n: (2.0, 3.5) if n % 2 == 0 else (4.5, 6.5),
    "TC_Dashboard_ExportChart": lambda n: (3.0, 5.0) if n <= 50 else (12.0, 15.0),
    "TC_User_BulkImport": lambda n: (10.0, 14.0) if n <= 40 else (18.0, 24.0) if n <= 65 else (28.0, 36.0),
}
ANOMALOUS, ANOMALOUS_RATE = (36, 37), 0.27
SHARES = (("alpha", 0.20), ("beta", 0.30), ("gamma", 0.50))
TEXTS = {
    "timeout": ("Element 'loading-spinner' still visible after {n}s timeout", "Wait_Until_Ready"),
    "element": ("Element with locator 'id=submit-btn' not found after {n} retries", "Click_Element"),
    "assertion": ("Expected HTTP status '200' but got '50{n}' — Internal Server Error", "Check_Status"),
    "data": ("CSV export contained {n} rows — expected at least 100 records", "Export_Csv"),
    "environment": ("Connection refused — test environment unreachable", "Environment_Setup"),
}


#: Fixed: the demo's messages as (form, choices, keyword), its pressure on flaky
#: tests by last build, and the least failure odds of its anomalous runs.
DEMO_TEXTS = {
    "timeout": ("Element '{}' still visible after {}s timeout", (("loading-spinner", "overlay-modal", "auth-redirect", "session-token"), (15, 20, 30, 45)), "Wait Until Element Is Visible"),
    "element": ("Element with locator '{}' not found after {} retries", (("id=widget-container", "id=submit-btn", "css=.data-grid", "id=modal-confirm"), (3, 5, 7)), "Click Element"),
    "assertion": ("Expected HTTP status {}", (("'200' but got '500' — Internal Server Error", "'200' but got '404' — Not Found", "'201' but got '400' — Bad Request"),), "Should Be Equal As Numbers"),
    "data": ("CSV export contained {} rows — expected at least {} records for {}", ((0, 1, 2), (50, 100, 200), ("Oct 2026", "last 30 days", "Q4 2026")), "Verify Row Count"),
}
DEMO_PRESSURE = ((25, 0.65), (35, 0.60), (45, 0.55), (75, 0.35), (10**9, 0.15))
DEMO_ANOMALY = 0.80


@dataclass(frozen=True)
class Plan:
    """``demo`` draws the demo data set: its own failure odds, messages and ids."""

    runs: int = 100
    seed: int = 42
    start: str = "2026-01-01"
    hours: int = 24
    demo: bool = False


DEMO = Plan(start="2026-10-01", demo=True)


def program(n: int, runs: int) -> str:
    """Runs fall to the programs in order, by share."""
    upto = 0
    for name, share in SHARES[:-1]:
        upto += max(1, round(runs * share))
        if n <= upto:
            return name
    return SHARES[-1][0]


def _family(test: tuple, n: int, rng: np.random.Generator) -> str:
    category, first, second, share = test[3], test[5], test[6], test[7]
    if category == "stable":
        return "environment"
    base = first if rng.random() < share else second
    if n in ANOMALOUS and rng.random() < 0.30:
        return str(rng.choice(["environment", "timeout"]))
    own = {first, second}
    for a, b, family, strength, shared in WAVES:
        if a <= n <= b and (family in own or own & shared) and rng.random() < strength:
            return family if family in own else str(rng.choice(sorted(own & shared)))
    return base


def _outcomes(n: int, rng: np.random.Generator) -> list[bool]:
    """Which tests pass: their own odds, raised by failed dependencies, then as
    few changes as meet the run's target."""
    odd = n in ANOMALOUS
    passed: dict[str, bool] = {}
    for name, _, _, category, p, *_ in TESTS:
        needs, weight = DEPENDS.get(name, (None, 0.0))
        if needs and passed.get(needs) is False:
            p = min(1 - (1 - p) * (1 - weight), 0.95)
        if odd:
            p = 0.80 if category == "stable" else min(p + (0.15 if category == "consistently_failing" else 0.30), 0.99 if category == "consistently_failing" else 0.95)
        elif category == "stable":
            p = 0.0
        passed[name] = rng.random() >= p
    lo, hi = next((a, b) for last, a, b in RATES if n <= last)
    target = ANOMALOUS_RATE if odd else rng.uniform(lo, hi)
    ok = list(passed.values())
    missing = round(len(TESTS) * (1 - target)) - ok.count(False)
    change = missing > 0
    pools = [[k for k, t in enumerate(TESTS) if ok[k] == change and (t[3] != "stable" if change else t[3].startswith(kind))] for kind in (("",) if change else ("flaky", "consistently"))]
    left = abs(missing)
    for pool in pools:
        for k in rng.permutation(pool)[:left].astype(int) if pool else []:
            ok[k] = not change
            left -= 1
    return ok


def _demo_outcomes(n: int, rng: np.random.Generator) -> list[bool]:
    pressure = next(x for last, x in DEMO_PRESSURE if n <= last)
    odds = [max(t[4], DEMO_ANOMALY) if n in ANOMALOUS else min(0.95, t[4] * (1 + pressure)) for t in TESTS]
    return [rng.random() >= p for p in odds]


def _message(test: tuple, n: int, plan: Plan, rng: np.random.Generator) -> tuple[str | None, str | None]:
    if not plan.demo:
        form, keyword = TEXTS[_family(test, n, rng)]
        return form.format(n=int(rng.integers(1, 10))), keyword
    if test[5] is None:
        return None, None
    form, choices, keyword = DEMO_TEXTS[test[5] if rng.random() < test[7] else test[6]]
    return form.format(*(c[int(rng.integers(len(c)))] for c in choices)), keyword


def run_rows(n: int, plan: Plan) -> dict:
    """One run with its results."""
    rng = np.random.default_rng([plan.seed, n])
    prefix = "TeamAlpha" if plan.demo else program(n, plan.runs)
    at = datetime.fromisoformat(plan.start) + timedelta(hours=plan.hours * (n - 1))
    results = []
    for test, ok in zip(TESTS, (_demo_outcomes if plan.demo else _outcomes)(n, rng), strict=True):
        name, feature, priority = test[:3]
        seconds = rng.uniform(*DURATIONS.get(name, lambda _: (1.2, 8.5))(n)) + (0.0 if ok else rng.uniform(5.0, 15.0))
        message, keyword = (None, None) if ok else _message(test, n, plan, rng)
        results.append(
            {
                "test_name": name, "status": "PASS" if ok else "FAIL", "duration_s": round(float(seconds), 3),
                "failure_msg": message, "failure_kw": keyword,
                "tags": ["alpha_regression" if plan.demo else f"{prefix}_regression", f"feature_{feature}", f"priority_{priority}"],
            }
        )
    bad = sum(r["status"] == "FAIL" for r in results)
    return {
        "run_id": f"{prefix}_build_{n:03d}", "team": "TeamAlpha", "suite_name": "Suite_Regression_TeamAlpha", "build_no": n, "timestamp": at,
        "duration_s": round(sum(r["duration_s"] for r in results), 3), "total": len(results), "passed": len(results) - bad, "failed": bad,
        "pass_rate_pct": round(100 * (len(results) - bad) / len(results), 1), "environment": "staging", "executor": f"jenkins-agent-{n % 3 + 1:02d}" if plan.demo else "jenkins-agent-01", "results": results,
    }


RUN = (
    "run_id string, team string, suite_name string, build_no int, timestamp timestamp, duration_s double, total int, passed int, failed int, pass_rate_pct double, "
    "environment string, executor string, results array<struct<test_name:string,status:string,duration_s:double,failure_msg:string,failure_kw:string,tags:array<string>>>"
)


def history(spark: SparkSession, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """Canonical (runs, results)."""
    ship(spark)

    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                yield pd.DataFrame([run_rows(int(n), plan) for n in b["id"]])

    every = spark.range(1, plan.runs + 1).mapInPandas(make, RUN).withColumn("_source_db", F.lit("demo" if plan.demo else "synthetic"))
    results = every.select(
        "run_id", "build_no", "team", "suite_name", "_source_db", F.col("timestamp").alias("run_timestamp"), F.col("pass_rate_pct").alias("run_pass_rate"), F.explode("results").alias("r")
    ).select("*", "r.*").drop("r").withColumn("result_id", F.concat_ws("_", "run_id", "test_name")).withColumn("tags", F.to_json("tags"))
    return every.drop("results"), results


def _stamp(t: datetime) -> str:
    return t.strftime("%Y%m%d %H:%M:%S.") + f"{t.microsecond // 1000:03d}"


def report_xml(run: dict) -> str:
    """The run as a test report."""
    at, parts = run["timestamp"], []
    for k, r in enumerate(run["results"]):
        end = at + timedelta(seconds=r["duration_s"])
        span = f'starttime="{_stamp(at)}" endtime="{_stamp(end)}"'
        tags = "".join(f"<tag>{escape(t)}</tag>" for t in r["tags"])
        message = escape(r["failure_msg"] or "")
        inner = f'<kw name={quoteattr(r["failure_kw"] or "Run_Steps")} library="Lib"><msg timestamp="{_stamp(end)}" level="{"FAIL" if message else "INFO"}">{message or "done"}</msg><status status="{r["status"]}" {span}/></kw>'
        parts.append(f'<test id="s1-t{k + 1}" name={quoteattr(r["test_name"])}>{tags}{inner}<status status="{r["status"]}" {span}>{message}</status></test>')
        at = end
    span = f'starttime="{_stamp(run["timestamp"])}" endtime="{_stamp(at)}"'
    verdict = "PASS" if not run["failed"] else "FAIL"
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<robot><suite id="s1" name={quoteattr(run["suite_name"])}>{"".join(parts)}<status status="{verdict}" {span}></status></suite></robot>\n'


def write_folders(root: str, plan: Plan = Plan()) -> list[str]:
    """Run folders on a local or mounted path."""
    from pathlib import Path

    out = []
    for n in range(1, plan.runs + 1):
        run = run_rows(n, plan)
        d = Path(root) / run["run_id"]
        d.mkdir(parents=True, exist_ok=True)
        meta = {"team": run["team"], "suite": run["suite_name"], "program": run["run_id"].split("_")[0]} | {k: run[k] for k in ("build_no", "total", "passed", "failed", "pass_rate_pct", "environment", "executor")}
        (d / "ci_metadata.json").write_text(json.dumps(meta | {"timestamp": run["timestamp"].isoformat()}))
        (d / "output.xml").write_text(report_xml(run))
        out.append(run["run_id"])
    return out
