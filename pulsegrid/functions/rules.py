"""Ordered rule tables: failure classifiers, bands and labels.

The five classifiers disagree by design and stay apart. Each is a fixed list of
(label, substrings) in the order in which they are tried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = tuple[tuple[str, tuple[str, ...]], ...]

#: The labels and substrings of the five classifiers.
SANKEY: Rules = (
    ("timeout", ("still visible after",)), ("element", ("not found after",)), ("assertion", ("expected http",)),
    ("data", ("csv export",)), ("environment", ("environment", "unreachable")),
)
DASHBOARD: Rules = (
    ("timeout", ("timeout", "timed out", "blocked completion", "exceeded", "wait until")),
    ("element", ("element", "not found", "click element", "widget-container", "page dom", "absent", "dom changed")),
    ("data", ("data validation", "csv export", "export/import", "records", "rows", "should not be empty")),
    ("assertion", ("assert", "assertion", "expected", "but got", "assertionerror")),
    ("environment", ("environment", "unreachable", "deployment", "network", "service unavailable", "connection")),
)
LABELS: Rules = (
    ("timeout", ("still visible",)), ("element", ("not found after",)), ("assertion", ("expected http status",)), ("data", ("csv export",)),
    ("environment", ("unreachable", "connection refused", "suite setup failed", "unable to launch browser", "infrastructure error", "environment health check", "application server")),
)
TERMS: Rules = (
    ("timeout", ("still visible", "visible", "timeout", "progressbar", "spinner")),
    ("element", ("not found", "locator", "retries", "widget", "submit", "modal", "nav")),
    ("assertion", ("expected http", "http status", "internal server", "bad request", "status num")),
    ("data", ("csv", "export", "rows", "records", "contained")),
    ("environment", ("connection", "refused", "unreachable", "environment", "unable", "browser", "infrastructure")),
)
TERMS_NOTEBOOK: Rules = (
    ("timeout", ("still visible", "visible", "timeout", "progressbar", "20s", "30s", "15s", "45s", "loadingspinner", "spinner")),
    ("element", ("not found", "locator", "retries", "widget", "submit", "modal", "nav", "cssdatagrid")),
    ("assertion", ("expected http", "http status", "internal server", "bad request", "status num", "service unavailable")),
    ("data", ("csv", "export", "rows", "records", "contained")),
    ("environment", ("connection", "refused", "unreachable", "environment", "unable", "browser", "infrastructure", "suite setup")),
)
ENVIRONMENT_KEYWORD = "Environment_Setup"


def first_match(text: Column, rules: Rules, otherwise: Column | str) -> Column:
    out: Column | None = None
    for label, parts in rules:
        test = F.lit(False)
        for p in parts:
            test |= text.contains(p)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def classify_sankey(msg: Column) -> Column:
    return first_match(F.lower(F.coalesce(msg, F.lit(""))), SANKEY, "unknown")


def classify_dashboard(msg: Column, kw: Column) -> Column:
    """Message and keyword, trimmed, joined and lower-cased."""
    part = [F.nullif(F.trim(c), F.lit("")) for c in (msg, kw)]
    return first_match(F.lower(F.concat_ws(" ", *part)), DASHBOARD, "unknown")


def classify_labels(msg: Column) -> Column:
    return first_match(F.lower(F.coalesce(msg, F.lit(""))), LABELS, "unknown")


def classify_terms(terms: Column, notebook: bool = False) -> Column:
    """Category of a list of top terms, joined by blanks."""
    joined = F.array_join(terms, " ")
    if notebook:
        return first_match(joined, TERMS_NOTEBOOK, F.concat(F.lit("cluster_"), F.get(terms, 0)))
    return first_match(joined, TERMS, "unknown")


def with_environment_override(category: Column, kw: Column) -> Column:
    return F.when(kw == ENVIRONMENT_KEYWORD, "environment").otherwise(category)


def health_band(rate: Column) -> Column:
    return F.when(rate >= 80, "HEALTHY").when(rate >= 60, "WARNING").otherwise("AT RISK")


def delta_band(delta: Column, width: float = 2.0) -> Column:
    return F.when(delta >= width, "up").when(delta <= -width, "down").otherwise("flat")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").when(score >= 0.25, "low").otherwise("none")


def defect_status_group(status: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(status, F.lit(""))), "[ -]", "")
    return (
        F.when(s == "triage", "triage")
        .when(s.isin("inprogress", "development", "testing"), "in_progress")
        .when(s == "labreview", "lab_review")
        .when(s.startswith("closed"), "closed")
        .otherwise("other")
    )


def program(suite: Column) -> Column:
    s = F.lower(suite)
    return F.when(s.contains("alpha"), "Alpha").when(s.contains("beta"), "Beta").when(s.contains("gamma"), "Gamma")


#: Fixed: upper build of each run phase and its label.
PHASES = ((25, "Phase 1 (1–25)"), (45, "Phase 2 (26–45)"), (75, "Phase 3 (46–75)"), (None, "Phase 4 (76–100)"))


def run_phase(build: Column, bare_fallback: bool = False) -> Column:
    """Phase of a build number; without one the last phase, whose label the
    failure flow writes bare (``bare_fallback``) and so leaves out."""
    out = F.when(build <= PHASES[0][0], PHASES[0][1])
    for upper, label in PHASES[1:-1]:
        out = out.when(build <= upper, label)
    if bare_fallback:
        out = out.when(build.isNull(), "Phase 4")
    return out.otherwise(PHASES[-1][1])


def build_week(build: Column) -> Column:
    """Weeks of seven builds."""
    return (F.floor((build - 1) / 7) + 1).cast("int")


def risk(p: Column) -> Column:
    return F.when(p >= 0.70, "High").when(p >= 0.40, "Moderate").otherwise("Low")


def trend(delta: Column) -> Column:
    return F.when(delta >= 0.10, "Increasing").when(delta <= -0.10, "Decreasing").otherwise("Stable")


def severity(z_flag: Column, forest_flag: Column, z: Column) -> Column:
    return F.when(z_flag & forest_flag, "Critical").when(z_flag | forest_flag, "High").when(z >= 1.5, "Medium").otherwise("Low")


def detection(z_flag: Column, forest_flag: Column) -> Column:
    return F.when(z_flag & forest_flag, "Both").when(z_flag, "Z-score").when(forest_flag, "Isolation Forest").otherwise("Normal")
