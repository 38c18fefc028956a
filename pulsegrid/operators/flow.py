"""Failure categories, heat maps, failure-flow graphs, cluster trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text

#: Fixed: node colours of the failure flow.
COLOURS = {
    "timeout": "#D29922", "element": "#58A6FF", "assertion": "#BC8CFF", "data": "#FFA657", "environment": "#39D353", "unknown": "#8B949E",
    "Phase 1 (1–25)": "#58A6FF44", "Phase 2 (26–45)": "#D2992244", "Phase 3 (46–75)": "#3FB95044", "Phase 4 (76–100)": "#BC8CFF44",
}
OTHER_COLOUR = "#30363D"
#: Fixed: what a peak of a category suggests.
HINTS = {
    "timeout": "Timeout failures spiked across builds %d–%d (%.1f× typical) — likely infrastructure or network degradation.",
    "environment": "Environment/setup failures concentrated in builds %d–%d (%.1f× typical) — check CI agents, staging health, or deploy gates.",
    "element": "'Element not found' errors clustered around builds %d–%d (%.1f× typical) — probable UI locator or DOM change from a sprint deploy.",
    "data": "Data validation failures peaked in builds %d–%d (%.1f× typical) — review export/import or fixture data changes.",
    "assertion": "HTTP assertion failures rose in builds %d–%d (%.1f× typical) — possible API contract or backend regression.",
}
NARROWEST, WIDEST, PEAK_RATIO, LEAST_FAILURES = 4, 14, 1.35, 3


def failures(results: DataFrame) -> DataFrame:
    return results.filter("status = 'FAIL'")


def with_message(results: DataFrame) -> DataFrame:
    return failures(results).filter("failure_msg is not null and trim(failure_msg) <> ''")


def failures_of_run(results: DataFrame, run_id: str) -> DataFrame:
    t = failures(results).filter(F.col("run_id") == run_id)
    return t.select(
        "test_name", "duration_s", "failure_msg", F.coalesce("failure_kw", F.lit("—")).alias("failure_kw"),
        rules.classify_dashboard(F.col("failure_msg"), F.col("failure_kw")).alias("category"),
    )


def category_counts(results: DataFrame) -> DataFrame:
    return failures(results).groupBy(rules.classify_dashboard(F.col("failure_msg"), F.col("failure_kw")).alias("category")).agg(F.count("*").alias("n"))


# --- matrices ---------------------------------------------------------------


def health_matrix(results: DataFrame) -> DataFrame:
    """Long form: status and duration of the first result of a test in a run."""
    first = F.min_by(F.struct("status", "duration_s"), "result_id")
    return results.groupBy("test_name", "run_id").agg(first.alias("x")).select("test_name", "run_id", "x.status", "x.duration_s")


def wide_matrix(results: DataFrame, run_ids: list[str], value: str = "status") -> DataFrame:
    """Tests by runs, columns in the order given."""
    long = health_matrix(results).filter(F.col("run_id").isin(run_ids))
    return long.groupBy("test_name").pivot("run_id", run_ids).agg(F.first(value))


def run_order(results: DataFrame) -> DataFrame:
    """The runs in order of time, then of the number that ends their id."""
    return in_order(results.select("run_id", "run_timestamp").distinct(), ["run_timestamp", "run_id"])


def in_order(frame: DataFrame, by: list[str]) -> DataFrame:
    """Sorted by the given columns; run ids go by the number that ends them, then
    by name. A column that the frame lacks gives way to timestamp, then run_id."""
    chosen: list[str] = []
    for c in by:
        given = next((x for x in (c, "timestamp", "run_id") if x in frame.columns and x not in chosen), None)
        if given:
            chosen.append(given)
    keys = [k for c in chosen for k in ([F.asc_nulls_last(text.build_suffix(c)), F.asc_nulls_last(c)] if c == "run_id" else [F.asc_nulls_last(c)])]
    return frame.orderBy(*keys) if keys else frame


def crosstab(frame: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    return frame.groupBy(rows).pivot(columns, values).count().na.fill(0)


def row_percent(table: DataFrame, columns: list[str]) -> DataFrame:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return table.select(*[c for c in table.columns if c not in columns], *[F.bround(F.col(c) * 100.0 / F.nullif(total, F.lit(0)), 1).alias(c) for c in columns])


# --- failure flow -----------------------------------------------------------


def _flow_rows(results: DataFrame, short_names: bool) -> DataFrame:
    build = text.build_suffix("run_id")
    name = F.regexp_replace("test_name", "TC_", "") if short_names else F.col("test_name")
    return failures(results).select(
        rules.classify_sankey(F.col("failure_msg")).alias("category"), name.alias("test"), rules.run_phase(build, bare_fallback=not short_names).alias("phase")
    )


def flow_nodes(results: DataFrame, short_names: bool = False) -> DataFrame:
    """Categories, tests and phases with dense indices from 0 and colours."""
    t = _flow_rows(results, short_names)
    known = [label for _, label in rules.PHASES]
    parts = [
        t.select(F.lit(0).alias("level"), F.col("category").alias("label")),
        t.select(F.lit(1).alias("level"), F.col("test").alias("label")),
        t.filter(F.col("phase").isin(known)).select(F.lit(2).alias("level"), F.col("phase").alias("label")),
    ]
    nodes = parts[0].union(parts[1]).union(parts[2]).distinct()
    index = F.row_number().over(Window.orderBy("level", "label")) - 1  # one row per node of the chart
    colour = F.lit(OTHER_COLOUR)
    for label, c in COLOURS.items():
        colour = F.when(F.col("label") == label, c).otherwise(colour)
    return nodes.select(index.alias("node"), "level", "label", colour.alias("colour"))


def flow_edges(results: DataFrame, short_names: bool = False) -> DataFrame:
    """(level, source, target, value): category to test, test to phase."""
    t = _flow_rows(results, short_names)
    known = [label for _, label in rules.PHASES]
    a = t.groupBy(F.col("category").alias("source"), F.col("test").alias("target")).count().withColumn("level", F.lit(0))
    b = t.filter(F.col("phase").isin(known)).groupBy(F.col("test").alias("source"), F.col("phase").alias("target")).count().withColumn("level", F.lit(1))
    return a.unionByName(b).select("level", "source", "target", F.col("count").alias("value"))


def indexed_edges(results: DataFrame, short_names: bool = False) -> DataFrame:
    nodes = flow_nodes(results, short_names)
    edges = flow_edges(results, short_names)
    s = nodes.select(F.col("level"), F.col("label").alias("source"), F.col("node").alias("source_node"))
    e = nodes.select((F.col("level") - 1).alias("level"), F.col("label").alias("target"), F.col("node").alias("target_node"))
    return edges.join(s, ["level", "source"]).join(e, ["level", "target"]).select("source_node", "target_node", "value")


# --- trends of categories or clusters ----------------------------------------


def cluster_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_label", "cluster_category").agg(F.count("*").alias("size"))


def with_build(clusters: DataFrame, results: DataFrame) -> DataFrame:
    """Build numbers by run: the first row of a run decides, else its id."""
    builds = results.groupBy("run_id").agg(F.min("build_no").alias("build_no"))
    t = clusters.drop("build_no").join(builds, "run_id", "left")
    return t.withColumn("build_no", F.coalesce("build_no", text.build_suffix("run_id"))).filter("build_no is not null")


def trends(rows: DataFrame, category: str = "category") -> DataFrame:
    """Long form of failures per build and category, zeros included."""
    counts = rows.groupBy("build_no", F.col(category).alias("category")).agg(F.count("*").alias("n"))
    grid = rows.select("build_no").distinct().crossJoin(rows.select(F.col(category).alias("category")).distinct())  # the table's own cells
    return grid.join(counts, ["build_no", "category"], "left").na.fill(0, ["n"])


def wide_trends(rows: DataFrame, categories: list[str], category: str = "category") -> DataFrame:
    return crosstab(rows, "build_no", category, categories)


def peak_windows(trend: DataFrame) -> DataFrame:
    """Per category the contiguous stretch of 4 to 14 builds with the largest sum
    among those whose mean is 1.35 times the overall mean; of equal ones the
    narrowest, then the earliest. (build_start, build_end, ratio)"""
    order = Window.partitionBy("category").orderBy("build_no")
    whole = Window.partitionBy("category")
    t = trend.withColumns({"mean": F.avg("n").over(whole), "rows": F.count("*").over(whole), "total": F.sum("n").over(whole)})
    spans = []
    for width in range(NARROWEST, WIDEST + 1):
        w = order.rowsBetween(0, width - 1)
        ok = F.count("*").over(w) == width
        spans.append(
            F.when(ok, F.struct(F.sum("n").over(w).alias("score"), F.lit(-width).alias("width"), (-F.col("build_no")).alias("start"), F.max("build_no").over(w).alias("end"), F.max("n").over(w).alias("top")))
        )
    t = t.withColumn("spans", F.array_compact(F.array(*spans)))
    t = t.select("category", "mean", "total", F.explode("spans").alias("s")).filter(
        (F.col("total") >= LEAST_FAILURES) & (F.col("mean") > 0) & (F.col("s.score") / -F.col("s.width") >= F.col("mean") * PEAK_RATIO)
    )
    best = t.groupBy("category").agg(F.max("s").alias("s"), F.first("mean").alias("mean"))
    return best.select("category", (-F.col("s.start")).alias("build_start"), F.col("s.end").alias("build_end"), (F.col("s.top") / F.col("mean")).alias("ratio"))


def root_cause_hints(trend: DataFrame) -> DataFrame:
    p = peak_windows(trend)
    args = (F.col("build_start").cast("long"), F.col("build_end").cast("long"), F.col("ratio"))
    hint: Column = F.concat(F.col("category"), F.format_string(" failures peaked in builds %d–%d (%.1f× typical).", *args))
    for category, form in HINTS.items():
        hint = F.when(F.col("category") == category, F.format_string(form, *args)).otherwise(hint)
    return p.select("category", "build_start", "build_end", hint.alias("hint"))
