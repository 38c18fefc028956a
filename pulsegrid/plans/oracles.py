"""DuckDB text of the registered queries."""

from __future__ import annotations

import re

from ..functions import rules, text
from ..operators import flow
from ..sources import adapter

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda t: len(t) >= 2 AND NOT list_contains({_STOP}, t)))"


def _case(x: str, table: rules.Rules, otherwise: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains({x}, '{p}')" for p in parts) + f" THEN '{label}'" for label, parts in table)
    return f"CASE {arms} ELSE {otherwise} END"


_MSG = "lower(coalesce(failure_msg, ''))"
_BOTH = "lower(concat_ws(' ', nullif(trim(failure_msg), ''), nullif(trim(failure_kw), '')))"
SANKEY, DASHBOARD, LABELS = _case(_MSG, rules.SANKEY, "'unknown'"), _case(_BOTH, rules.DASHBOARD, "'unknown'"), _case(_MSG, rules.LABELS, "'unknown'")
_EMAIL = r"lower(CASE WHEN regexp_extract(reporter_raw, '[\w._%+\-]+@[\w.\-]+\.[a-zA-Z]{2,}') <> '' THEN regexp_extract(reporter_raw, '[\w._%+\-]+@[\w.\-]+\.[a-zA-Z]{2,}') ELSE trim(reporter_raw) END)"
_PHASE = "CASE WHEN build_no <= 25 THEN 'Phase 1 (1–25)' WHEN build_no <= 45 THEN 'Phase 2 (26–45)' WHEN build_no <= 75 THEN 'Phase 3 (46–75)' ELSE 'Phase 4 (76–100)' END"

_EXTRA = {
    "failed": f"failed AS (SELECT *, {SANKEY} AS sankey, {DASHBOARD} AS dashboard, {LABELS} AS label FROM results WHERE status = 'FAIL')",
    "rolled": """rolled AS (SELECT *, (roll_mean - pass_rate_pct) / greatest(roll_std, 1.0) AS z_score FROM (SELECT *,
        CASE WHEN k >= 3 THEN m END AS roll_mean, coalesce(CASE WHEN k >= 3 THEN s END, 5.0) AS roll_std FROM (SELECT *,
        count(*) OVER w AS k, avg(pass_rate_pct) OVER w AS m, stddev_samp(pass_rate_pct) OVER w AS s FROM runs
        WINDOW w AS (PARTITION BY team, _source_db ORDER BY build_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))))""",
    "slow": "slow AS (SELECT * REPLACE (CASE WHEN idx % 4 = 0 AND build_no > 40 THEN duration_s * 3 ELSE duration_s END AS duration_s) FROM results)",
    "defects2": f"""defects2 AS MATERIALIZED (SELECT d.*, {_EMAIL} AS reporter_email, e.embedding AS vector, lower(trim(summary || ' ' || coalesce(description, ''))) AS low,
        {_tokens("trim(summary || ' ' || coalesce(description, ''))")} AS words FROM defects d LEFT JOIN embeddings e USING (vec_id))""",
    "results2": f"""results2 AS MATERIALIZED (SELECT r.*, e.embedding AS result_vector, {_tokens("array_to_string(list_filter(regexp_split_to_array(lower(test_name), '_+'), lambda t: t <> 'tc'), ' ')")} AS stems,
        {_tokens("trim(concat_ws(' ', failure_msg, failure_kw))")} AS hits
        FROM (SELECT *, (build_no * 20 + idx) % (SELECT count(*) FROM embeddings) AS vec_id FROM results WHERE status = 'FAIL') r LEFT JOIN embeddings e USING (vec_id))""",
    "pairs": """pairs AS (SELECT d.defect_id, d.project, d.summary, d.description, d.reporter_email, d.status AS defect_status, d.priority, d.vector, d.low, d.words,
        r.stems, r.hits, r.result_id, r.run_id, r.test_name, r.failure_msg, r.failure_kw, r.result_vector, r.run_timestamp, abs(epoch_us(d.created) - epoch_us(r.run_timestamp)) / 86400000000.0 AS date_diff_days
        FROM defects2 d JOIN results2 r ON abs(epoch_us(d.created) - epoch_us(r.run_timestamp)) / 86400000000.0 <= 7)""",
    "worded": "worded AS (SELECT *, contains(low, lower(test_name)) AS exact FROM pairs)",
    "ruled": """ruled AS (SELECT *, list_intersect(stems, words) AS stem, list_intersect(hits, words) AS hit,
        round_even(CASE WHEN exact THEN 0.60 WHEN len(list_intersect(stems, words)) > 0 THEN 0.25 ELSE 0.0 END + CASE WHEN len(list_intersect(hits, words)) > 0 THEN 0.15 ELSE 0.0 END, 4)::double AS rule_score FROM worded)""",
    "scored": """scored AS (SELECT *, CASE WHEN reporter_email = 'qa@example.com' THEN 1 ELSE 0 END AS email_match,
        CASE WHEN vector IS NOT NULL AND result_vector IS NOT NULL THEN greatest(0.0, list_cosine_similarity(vector::double[], result_vector::double[])) END AS sem FROM ruled)""",
    "maps": """maps AS MATERIALIZED (SELECT *, CASE WHEN confidence_score >= 0.5 AND (email_match = 1 OR reporter_email = '') THEN 1 ELSE 0 END AS confirmed, defect_id || '__' || result_id AS mapping_id
        FROM (SELECT *, CASE WHEN sem IS NULL THEN rule_score ELSE round_even(0.5 * rule_score + 0.5 * sem, 4) END AS confidence_score FROM scored) WHERE confidence_score >= 0.25)""",
    "rmaps": """rmaps AS MATERIALIZED (SELECT *, CASE WHEN confidence_score >= 0.5 AND (email_match = 1 OR reporter_email = '') THEN 1 ELSE 0 END AS confirmed, defect_id || '__' || result_id AS mapping_id
        FROM (SELECT *, rule_score AS confidence_score FROM scored) WHERE confidence_score >= 0.25)""",
    "synclog": """synclog AS (SELECT mapping_id, CASE WHEN right(test_name, 1) = '3' THEN 'error' ELSE 'success' END AS status, run_timestamp AS written_at FROM maps
        WHERE confirmed = 1 AND right(run_id, 1) IN ('1', '3', '5', '7', '9'))""",
    "trend": """trend AS (SELECT build_no, category, coalesce(n, 0) AS n FROM (SELECT DISTINCT build_no FROM failed) CROSS JOIN (SELECT DISTINCT dashboard AS category FROM failed)
        LEFT JOIN (SELECT build_no, dashboard AS category, count(*) AS n FROM failed GROUP BY ALL) USING (build_no, category))""",
    "history": """history AS (SELECT _source_db, test_name, round_even(avg(bad) FILTER (back <= 20) * 100, 1) AS failure_rate_last20, cast(sum(changed) AS bigint) AS flip_count,
        CASE WHEN avg(bad) FILTER (back <= 5) - avg(bad) FILTER (CASE WHEN n >= 10 THEN back BETWEEN 6 AND 10 ELSE rn <= 5 END) >= 0.10 THEN 'Increasing'
        WHEN avg(bad) FILTER (back <= 5) - avg(bad) FILTER (CASE WHEN n >= 10 THEN back BETWEEN 6 AND 10 ELSE rn <= 5 END) <= -0.10 THEN 'Decreasing' ELSE 'Stable' END AS trend
        FROM (SELECT *, CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END AS bad, CASE WHEN status IS DISTINCT FROM lag(status) OVER w THEN 1 ELSE 0 END AS changed,
        row_number() OVER w AS rn, row_number() OVER (PARTITION BY _source_db, test_name ORDER BY build_no DESC) AS back, count(*) OVER (PARTITION BY _source_db, test_name) AS n
        FROM results WINDOW w AS (PARTITION BY _source_db, test_name ORDER BY build_no)) GROUP BY 1, 2)""",
    "stand": """stand AS (SELECT test_name, failure_probability, failure_rate_last20, flip_count, trend FROM (SELECT test_name, round(avg(CASE WHEN status = 'FAIL' THEN 1.0 ELSE 0.0 END), 3) AS failure_probability FROM results GROUP BY 1) JOIN history USING (test_name))""",
    "featured": """featured AS (SELECT *, CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END AS target, ((build_no * 7 + idx * 3) % 10) / 10.0 + CASE WHEN status = 'FAIL' THEN 0.3 ELSE 0.0 END AS score FROM results)""",
    "oldnew": "old AS (SELECT run_id, build_no, pass_rate_pct, 'old' AS side FROM runs WHERE build_no <= 40), new AS (SELECT run_id, build_no, pass_rate_pct, 'new' AS side FROM runs WHERE build_no > 20)",
    "drifted": "",
}


def _drift(base: int, std: str, extra: int) -> str:
    return f"""drifted AS (SELECT *, coalesce(z >= 2.0, false) AS drift_flagged,
        coalesce(usable AND count(*) OVER t >= 5 AND sum(CASE WHEN coalesce(z >= 2.0, false) THEN 1 ELSE 0 END) OVER t >= 3, false) AS drift_confirmed FROM (
        SELECT *, status = 'PASS' AND n >= {base + extra} AS usable, CASE WHEN status = 'PASS' AND n >= {base + extra} THEN
        (duration_s - avg(CASE WHEN rn <= {base} THEN duration_s END) OVER e) / greatest({std}(CASE WHEN rn <= {base} THEN duration_s END) OVER e, 0.01) END AS z
        FROM (SELECT *, row_number() OVER (PARTITION BY _source_db, test_name, status ORDER BY build_no) AS rn, count(*) OVER (PARTITION BY _source_db, test_name, status) AS n FROM slow)
        WINDOW e AS (PARTITION BY _source_db, test_name, status)) WINDOW t AS (PARTITION BY _source_db, test_name, status ORDER BY build_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


_EXTRA["drifted"] = _drift(15, "stddev_pop", 5)
_EXTRA["report"] = """report AS (SELECT _source_db, test_name, round_even(before, 2) AS baseline_duration_s, round_even(latest, 2) AS drifted_duration_s, round_even(pct, 1) AS percent_increase,
    first_drift AS first_drift_build, round_even(least(1.0, 0.5 + pct / 200), 2) AS model_confidence FROM (SELECT *, CASE WHEN before <> 0 THEN (recent / before - 1) * 100 ELSE 0.0 END AS pct FROM (
    SELECT _source_db, test_name, first_drift, coalesce(median(duration_s) FILTER (build_no < first_drift), median(duration_s)) AS before, median(duration_s) FILTER (build_no >= first_drift) AS recent,
    arg_max(duration_s, build_no) AS latest FROM (SELECT *, min(CASE WHEN drift_confirmed THEN build_no END) OVER (PARTITION BY _source_db, test_name) AS first_drift FROM drifted)
    WHERE first_drift IS NOT NULL GROUP BY 1, 2, 3)) WHERE pct >= 15.0)"""

_MAPS = ("defects2", "results2", "pairs", "worded", "ruled", "scored", "maps")
_RMAPS = (*_MAPS[:-1], "rmaps")
_DRIFT = ("slow", "drifted", "report")
ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *extra: str, all_tests: bool = False) -> None:
    """``extra`` names further tables; those on defects and failures in pairs take
    the frames that pair_query takes, unless they are of ``all_tests``."""
    frames = adapter.duck_frames(adapter.PAIR_TESTS if "defects2" in extra and not all_tests else None)
    ORACLES[name] = "WITH " + ", ".join([frames, *(_EXTRA[e] for e in extra)]) + "\n" + sql


oracle("top_failing_tests", """SELECT test_name, count(*) AS total_runs, cast(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) AS bigint) AS fail_count,
    round(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) * 100.0 / count(*), 1) AS fail_rate_pct FROM results JOIN runs USING (run_id) WHERE runs.team = 'TeamAlpha'
    GROUP BY 1 ORDER BY fail_count DESC, test_name LIMIT 5""")
oracle("pass_rate_by_run", "SELECT run_id, timestamp, pass_rate_pct FROM runs WHERE team = 'TeamAlpha'")
oracle("run_anomaly_zscore", "SELECT run_id, pass_rate_pct, round(roll_mean, 9) AS roll_mean, round(roll_std, 9) AS roll_std, round(z_score, 9) AS z_score, coalesce(z_score >= 2, false) AS anomaly FROM rolled", "rolled")
oracle("run_features", """SELECT run_id, round(coalesce(pass_rate_pct - lag(pass_rate_pct) OVER w, 0.0), 9) AS pass_rate_change, round(coalesce(lag(failed / greatest(total, 1)) OVER w, 0.0), 9) AS fail_rate_prev,
    round(coalesce(roll_mean, pass_rate_pct) - pass_rate_pct, 9) AS deviation, round(duration_s / nullif(lag(duration_s) OVER w, 0), 9) AS duration_change, round(coalesce(avg_d, 0.0), 9) AS avg_duration_s
    FROM rolled LEFT JOIN (SELECT run_id, avg(duration_s) AS avg_d FROM results GROUP BY 1) USING (run_id) WINDOW w AS (PARTITION BY team, _source_db ORDER BY build_no)""", "rolled")
oracle("run_features_notebook", """SELECT run_id, round(pass_rate_pct - lag(pass_rate_pct) OVER w, 9) AS pass_rate_change, round(lag(failed / nullif(total, 0)) OVER w, 9) AS fail_rate_prev,
    round(CASE WHEN count(*) OVER t >= 3 THEN avg(pass_rate_pct) OVER t END - pass_rate_pct, 9) AS deviation FROM runs
    WINDOW w AS (PARTITION BY team, _source_db ORDER BY build_no), t AS (PARTITION BY team, _source_db ORDER BY build_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
oracle("week_on_week", """, wk AS (SELECT run_id, cast((build_no - 1) // 7 + 1 AS integer) AS week, pass_rate_pct FROM runs), rate AS (SELECT week, avg(pass_rate_pct) AS a FROM wk GROUP BY 1),
    st AS (SELECT week, test_name, max(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) AS bad FROM results JOIN wk USING (run_id) GROUP BY 1, 2),
    mv AS (SELECT coalesce(c.week, p.week + 1) AS week, count(*) FILTER (coalesce(p.bad, 0) = 0 AND coalesce(c.bad, 0) = 1) AS nf, count(*) FILTER (coalesce(p.bad, 0) = 1 AND coalesce(c.bad, 0) = 0) AS fx
    FROM st c FULL JOIN st p ON c.test_name = p.test_name AND c.week = p.week + 1 GROUP BY 1)
    SELECT *, CASE WHEN pass_rate_delta >= 2 THEN 'up' WHEN pass_rate_delta <= -2 THEN 'down' ELSE 'flat' END AS direction FROM (
    SELECT t.week, round(CASE WHEN l.a IS NULL THEN 0.0 ELSE t.a - l.a END, 9) AS pass_rate_delta, round(CASE WHEN l.a IS NULL THEN 0.0 ELSE t.a END, 9) AS this_avg, round(coalesce(l.a, 0.0), 9) AS last_avg,
    CASE WHEN l.a IS NULL THEN 0 ELSE nf END AS new_failures, CASE WHEN l.a IS NULL THEN 0 ELSE fx END AS tests_fixed FROM rate t LEFT JOIN rate l ON l.week + 1 = t.week LEFT JOIN mv ON mv.week = t.week)""")
oracle("weekly_health", """SELECT week, round(avg(pass_rate_pct), 9) AS avg_rate, max(pass_rate_pct) AS best_rate, min(pass_rate_pct) AS worst_rate, arg_max(run_id, build_no) AS latest_run, arg_max(pass_rate_pct, build_no) AS latest_rate,
    CASE WHEN arg_max(pass_rate_pct, build_no) >= 80 THEN 'HEALTHY' WHEN arg_max(pass_rate_pct, build_no) >= 60 THEN 'WARNING' ELSE 'AT RISK' END AS band
    FROM (SELECT *, cast((build_no - 1) // 7 + 1 AS integer) AS week FROM runs) GROUP BY 1""")
oracle("bi_measures", """SELECT round(sum(passed) / sum(total), 9) AS pass_rate, round(sum(failed) / sum(total), 9) AS failure_rate, round(avg(duration_s), 9) AS avg_duration_s,
    (SELECT count(*) FROM (SELECT test_name FROM results GROUP BY 1 HAVING count(DISTINCT status) > 1)) AS flaky_tests FROM runs""")
oracle("executor_performance", "SELECT executor, count(*) AS n_runs, round(avg(pass_rate_pct), 9) AS avg_rate, round(avg(duration_s), 9) AS avg_duration_s FROM runs GROUP BY 1")
oracle("pass_fail_per_run", "SELECT run_id, timestamp, passed, failed, pass_rate_pct, duration_s FROM runs WHERE timestamp >= '2024-01-05' AND timestamp < '2024-01-25'")
oracle("dashboard_header", "SELECT arg_max(run_id, build_no) AS latest_run, 'Alpha' AS programs, count(*) AS n_runs FROM runs")
oracle("load_expectations", """SELECT *, n_results >= n_runs * 20 AS enough_results FROM (SELECT count(*) AS n_runs, count(DISTINCT run_id) AS distinct_runs, min(timestamp) AS first_run, max(timestamp) AS last_run FROM runs),
    (SELECT count(*) AS n_results, count(DISTINCT test_name) AS n_tests FROM results)""")
oracle("time_split", """SELECT result_id, build_no, CASE WHEN build_no <= a THEN 'train' WHEN build_no <= b THEN 'validation' ELSE 'test' END AS split FROM results,
    (SELECT quantile_cont(build_no, 0.75) AS a, quantile_cont(build_no, 0.9) AS b FROM (SELECT DISTINCT build_no FROM results))""")
oracle("run_verdicts", """SELECT run_id, z OR i AS is_anomalous, z AND i AS flagged_by_both, CASE WHEN z AND i THEN 'Both' WHEN z THEN 'Z-score' WHEN i THEN 'Isolation Forest' ELSE 'Normal' END AS detection_method,
    CASE WHEN z AND i THEN 'Critical' WHEN z OR i THEN 'High' WHEN coalesce(z_score, 0) >= 1.5 THEN 'Medium' ELSE 'Low' END AS severity FROM (SELECT *, coalesce(z_score >= 2, false) AS z, build_no % 7 = 0 AS i FROM rolled)""", "rolled")
_FLAKY = """cast(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) AS bigint) AS fail_count, count(*) AS total_runs, round_even(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) * 100.0 / count(*), 1) AS failure_rate
    FROM (SELECT *, lag(status) OVER (PARTITION BY _source_db, test_name ORDER BY build_no) AS prev FROM results)"""
oracle("flaky_scores_pipeline", f"SELECT _source_db, test_name, cast(greatest(sum(CASE WHEN status IS DISTINCT FROM prev THEN 1 ELSE 0 END) - 1, 0) AS bigint) AS flip_count, {_FLAKY} GROUP BY 1, 2")
oracle("flaky_scores_dashboard", f"SELECT test_name, cast(sum(CASE WHEN status <> prev THEN 1 ELSE 0 END) AS bigint) AS flip_count, {_FLAKY} GROUP BY 1")
oracle("recent_history", "SELECT * FROM history", "history")
oracle("duration_series_roll5", """SELECT run_id, cast(row_number() OVER (ORDER BY build_no) AS integer) AS run_num, status, duration_s, round(CASE WHEN count(*) OVER f >= 2 THEN avg(duration_s) OVER f END, 9) AS rolling_5
    FROM results WHERE test_name = 'TC_User_07' WINDOW f AS (ORDER BY build_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
oracle("flakiness_features", """, base AS (SELECT r.*, u.pass_rate_pct AS run_pass_rate, CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END AS bad FROM results r JOIN runs u USING (run_id)),
    num AS (SELECT *, row_number() OVER w AS rn, lead(bad) OVER w AS target, lead(build_no) OVER w AS build_no_target, lag(run_timestamp) OVER w AS before, CASE WHEN status <> lag(status) OVER w THEN 1 ELSE 0 END AS flip
        FROM base WINDOW w AS (PARTITION BY test_name ORDER BY build_no)),
    win AS (SELECT *, avg(bad) OVER (PARTITION BY test_name ORDER BY build_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f5, avg(bad) OVER (PARTITION BY test_name ORDER BY build_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS f10,
        avg(bad) OVER v AS f20, count(*) OVER v AS n, sum(flip) OVER (PARTITION BY test_name ORDER BY build_no ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS flips,
        coalesce(rn - max(CASE WHEN status <> 'FAIL' THEN rn END) OVER v, count(*) OVER v) AS cf, coalesce(rn - max(CASE WHEN status <> 'PASS' THEN rn END) OVER v, count(*) OVER v) AS cp,
        list(CASE WHEN status = 'PASS' THEN duration_s END) OVER v AS lp, list(CASE WHEN status = 'FAIL' THEN duration_s END) OVER v AS lf
        FROM num WINDOW v AS (PARTITION BY test_name ORDER BY build_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    out AS (SELECT *, list_avg(list_filter(lp, lambda x: x IS NOT NULL)[-5:]) AS dp, list_avg(list_filter(lf, lambda x: x IS NOT NULL)[-5:]) AS df FROM win WHERE rn > 10 AND target IS NOT NULL)
    SELECT test_name, run_id, build_no_target, round(f5, 9) AS fail_rate_last_5, round(f10, 9) AS fail_rate_last_10, round(f20, 9) AS fail_rate_last_20, cast(flips AS bigint) AS flip_count_last_w, round(flips / greatest(n - 1, 1), 9) AS flip_rate_last_w,
    cast(cf AS bigint) AS consecutive_failures, cast(cp AS bigint) AS consecutive_passes, round(coalesce(dp, (SELECT median(dp) FROM out)), 9) AS avg_dur_pass_5, round(coalesce(df, (SELECT median(df) FROM out)), 9) AS avg_dur_fail_5,
    round(duration_s, 9) AS duration_last, round(coalesce((epoch_us(run_timestamp) - epoch_us(before)) / 86400000000.0, 1.0), 9) AS time_since_last, run_pass_rate,
    json_extract_string(tags, '$[1]') AS feature_tag, json_extract_string(tags, '$[2]') AS priority_tag, target FROM out""")
oracle("drift_flags", "SELECT result_id, round(z, 9) AS z_duration, drift_flagged, drift_confirmed FROM drifted", "slow", "drifted")
ORACLES["drift_flags_notebook"] = "WITH " + ", ".join([adapter.duck_frames(), _EXTRA["slow"], _drift(30, "stddev_samp", 0)]) + "\nSELECT result_id, round(z, 9) AS z_duration, drift_flagged, drift_confirmed FROM drifted"
oracle("drift_report", "SELECT * FROM report", *_DRIFT)
oracle("non_drifting_tests", "SELECT DISTINCT test_name FROM results WHERE test_name NOT IN (SELECT test_name FROM report)", *_DRIFT)
oracle("duration_forecast", """, p AS (SELECT test_name, count(*) AS n, avg(duration_s) FILTER (back <= 5) AS pred, stddev_pop(duration_s) FILTER (back <= 5) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY test_name ORDER BY build_no DESC) AS back FROM slow WHERE status = 'PASS') GROUP BY 1)
    SELECT t.test_name, CASE WHEN n >= 5 THEN round_even(pred, 2) ELSE 0.0 END AS predicted_duration_s, CASE WHEN n >= 5 THEN round_even(greatest(0.0, pred - 1.96 * sd), 2) ELSE 0.0 END AS ci_low_s, CASE WHEN n >= 5 THEN round_even(pred + 1.96 * sd, 2) ELSE 0.0 END AS ci_high_s,
    CASE WHEN n IS NULL OR n < 5 THEN 'Insufficient data' WHEN percent_increase > 25 THEN 'Drifting' WHEN percent_increase > 15 THEN 'Watch' ELSE 'Stable' END AS drift_status
    FROM (SELECT DISTINCT test_name FROM slow) t LEFT JOIN p USING (test_name) LEFT JOIN report USING (test_name)""", *_DRIFT)
oracle("regression_features", """SELECT test_name, run_id, round(ln(duration_s), 9) AS log_duration, round(avg(duration_s) OVER (PARTITION BY test_name ORDER BY build_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS expanding_mean,
    round(avg(duration_s) OVER f, 9) AS rolling_mean_5, round(stddev_samp(duration_s) OVER f, 9) AS rolling_std_5, round(lag(duration_s) OVER (PARTITION BY test_name ORDER BY build_no), 9) AS prev_duration
    FROM results WHERE duration_s > 0 WINDOW f AS (PARTITION BY test_name ORDER BY build_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
oracle("enriched_predictions", """SELECT test_name, failure_probability, trend, (k // 10 + CASE WHEN k % 10 > 5 OR (k % 10 = 5 AND (k // 10) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS confidence, risk,
    CASE WHEN risk = 'High' THEN CASE WHEN trend = 'Increasing' THEN 'Execute Early' ELSE 'Isolate' END WHEN risk = 'Medium' THEN 'Retry Automatically' ELSE 'Monitor' END AS recommendation
    FROM (SELECT *, cast(round(greatest(failure_probability, 1 - failure_probability) * 1000) AS bigint) AS k, CASE WHEN failure_probability >= 0.7 THEN 'High' WHEN failure_probability >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk FROM stand)""", "history", "stand")
oracle("prioritisation", """, s AS (SELECT test_name, coalesce(failure_probability, 0.0) AS p, coalesce(drifted_duration_s, dur, 0.0) AS d, coalesce(failure_rate_last20, hist, 0.0) AS fr FROM stand FULL JOIN report USING (test_name)
    LEFT JOIN (SELECT test_name, round_even(avg(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) * 100, 1) AS hist, round_even(avg(duration_s), 2) AS dur FROM slow GROUP BY 1) USING (test_name)),
    q AS (SELECT *, round_even(p * 0.55 + fr / 100 * 0.30 + least(d / 60, 1.0) * 0.15, 3) AS priority_score FROM s)
    SELECT cast(row_number() OVER (ORDER BY priority_score DESC, test_name) AS integer) AS priority_rank, test_name, round_even(p * 100, 1) AS flakiness_probability, round_even(d, 2) AS predicted_duration_s, fr AS historical_failure_rate, priority_score,
    CASE WHEN p >= 0.7 OR priority_score >= 0.65 THEN 'Isolate' WHEN p >= 0.4 OR fr >= 30 THEN 'Execute Early' WHEN p >= 0.25 THEN 'Retry Automatically' ELSE 'Monitor' END AS recommendation FROM q ORDER BY 1 LIMIT 25""", *_DRIFT, "history", "stand")
oracle("risk_scores", """, q AS (SELECT test_name, failure_probability * (1 + coalesce(percent_increase, 0.0) / 100) / nullif(d, 0) AS s FROM stand LEFT JOIN report USING (test_name)
    LEFT JOIN (SELECT test_name, round(avg(duration_s), 9) AS d FROM slow GROUP BY 1) USING (test_name)) SELECT test_name, round(s, 9) AS risk_score,
    CASE WHEN s >= (SELECT quantile_cont(s, 0.75) FROM q) THEN 'High' WHEN s >= (SELECT quantile_cont(s, 0.25) FROM q) THEN 'Medium' ELSE 'Low' END AS tier FROM q""", *_DRIFT, "history", "stand")
oracle("multi_source_union", "SELECT _source_db, status, count(*) AS n FROM (SELECT result_id, status, 'alpha' AS _source_db FROM results UNION ALL SELECT result_id, status, 'beta' FROM results WHERE build_no <= 10) GROUP BY ALL")
oracle("failure_category_counts", "SELECT dashboard AS category, count(*) AS n FROM failed GROUP BY 1", "failed")
oracle("failure_labels", f"""SELECT result_id, sankey, dashboard, label, CASE WHEN failure_kw = 'Environment_Setup' THEN 'environment' ELSE label END AS overridden, {_case('lower(failure_msg)', rules.TERMS, "'unknown'")} AS terms,
    {_case('lower(failure_msg)', rules.TERMS_NOTEBOOK, "'cluster_' || split_part(lower(failure_msg), ' ', 1)")} AS terms_notebook FROM failed WHERE trim(failure_msg) <> ''""", "failed")
oracle("failures_of_run", "SELECT test_name, duration_s, failure_msg, coalesce(failure_kw, '—') AS failure_kw, dashboard AS category FROM failed WHERE run_id = 'alpha_build_030'", "failed")
oracle("health_matrix_long", "SELECT test_name, run_id, arg_min(status, result_id) AS status, arg_min(duration_s, result_id) AS duration_s FROM results GROUP BY 1, 2")
for _name, _from, _value in (("heatmap_pivot", 1, "status"), ("heatmap_durations", 51, "duration_s")):
    _ids = [f"alpha_build_{k:03d}" for k in range(_from, _from + 10)]
    oracle(_name, "SELECT test_name, " + ", ".join(f"max({_value}) FILTER (run_id = '{i}') AS {i}" for i in _ids) + " FROM results WHERE run_id IN (" + ", ".join(f"'{i}'" for i in _ids) + ") GROUP BY 1")
_NODES = f"nodes AS (SELECT cast(row_number() OVER (ORDER BY level, label) - 1 AS integer) AS node, level, label FROM (SELECT DISTINCT 0 AS level, sankey AS label FROM failed UNION SELECT DISTINCT 1, test_name FROM failed UNION SELECT DISTINCT 2, {_PHASE} FROM failed))"
_EDGES = f"edges AS (SELECT 0 AS level, sankey AS source, test_name AS target, count(*) AS value FROM failed GROUP BY ALL UNION ALL SELECT 1, test_name, {_PHASE}, count(*) FROM failed GROUP BY ALL)"
oracle("sankey_nodes", ", " + _NODES + """ SELECT node, level, label, CASE label WHEN 'timeout' THEN '#D29922' WHEN 'element' THEN '#58A6FF' WHEN 'assertion' THEN '#BC8CFF' WHEN 'data' THEN '#FFA657' WHEN 'environment' THEN '#39D353' WHEN 'unknown' THEN '#8B949E'
    WHEN 'Phase 1 (1–25)' THEN '#58A6FF44' WHEN 'Phase 2 (26–45)' THEN '#D2992244' WHEN 'Phase 3 (46–75)' THEN '#3FB95044' WHEN 'Phase 4 (76–100)' THEN '#BC8CFF44' ELSE '#30363D' END AS colour FROM nodes""", "failed")
oracle("sankey_edges", f", {_NODES}, {_EDGES} SELECT a.node AS source_node, b.node AS target_node, value FROM edges JOIN nodes a ON a.level = edges.level AND a.label = source JOIN nodes b ON b.level = edges.level + 1 AND b.label = target", "failed")
oracle("sankey_edges_dashboard", f", {_EDGES} SELECT level, replace(source, 'TC_', '') AS source, replace(target, 'TC_', '') AS target, value FROM edges", "failed")
oracle("cluster_trends", "SELECT * FROM trend", "failed", "trend")
_SPANS = """, spans AS (SELECT a.category, w.width, a.build_no AS s, max(b.build_no) AS e, sum(b.n) AS score, max(b.n) AS top FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY build_no) AS k FROM trend) a
    CROSS JOIN range(4, 15) w(width) JOIN (SELECT *, row_number() OVER (PARTITION BY category ORDER BY build_no) AS k FROM trend) b ON a.category = b.category AND b.k BETWEEN a.k AND a.k + w.width - 1 GROUP BY ALL HAVING count(*) = w.width),
    st AS (SELECT category, avg(n) AS mean, sum(n) AS total FROM trend GROUP BY 1)"""
_PEAK_SQL = """SELECT category, s AS build_start, e AS build_end, round(top / mean, 9) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, width, s) AS k FROM spans JOIN st USING (category)
    WHERE total >= 3 AND mean > 0 AND score / width >= mean * 1.35) WHERE k = 1"""
oracle("peak_windows", _SPANS + "\n" + _PEAK_SQL, "failed", "trend")
_HINT = " ".join(f"WHEN category = '{c}' THEN format('{re.sub('%d|%.1f', lambda m: '{:d}' if m[0] == '%d' else '{:.1f}', form).replace(chr(39), chr(39) * 2)}', build_start, build_end, ratio)" for c, form in flow.HINTS.items())
oracle("root_cause_hints", _SPANS + ", peaks AS (" + _PEAK_SQL + """) SELECT category, build_start, build_end, CASE """ + _HINT + """ ELSE category || format(' failures peaked in builds {:d}–{:d} ({:.1f}× typical).', build_start, build_end, ratio) END AS hint FROM peaks""", "failed", "trend")
oracle("cluster_summary", "SELECT idx AS cluster_label, label AS cluster_category, count(*) AS size FROM failed GROUP BY 1, 2", "failed")
_CROSS = "SELECT test_name, count(*) FILTER (status = 'PASS') AS p, count(*) FILTER (status = 'FAIL') AS f FROM results GROUP BY 1"
oracle("crosstab_status", f"SELECT test_name, p AS PASS, f AS FAIL FROM ({_CROSS})")
oracle("crosstab_percent", f"SELECT test_name, round_even(p * 100.0 / (p + f), 1) AS PASS, round_even(f * 100.0 / (p + f), 1) AS FAIL FROM ({_CROSS})")
oracle("preprocess_messages", r"""SELECT DISTINCT failure_msg, CASE WHEN failure_msg IS NULL OR c = '' THEN '_empty_' ELSE c END AS clean FROM (SELECT failure_msg, trim(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(replace(replace(lower(failure_msg), '—', ' '), '–', ' '), '[!-/:-@\[-`{-~]', '', 'g'), '\b\d+\b', 'NUM', 'g'), '\b\w\b', '', 'g'), '\s+', ' ', 'g')) AS c FROM results)""")
oracle("email_normalise", f"SELECT defect_id, {_EMAIL} AS email FROM defects")
oracle("tag_extract", "SELECT DISTINCT test_name, json_extract_string(tags, '$[1]') AS feature_tag, json_extract_string(tags, '$[2]') AS priority_tag, json_extract_string(tags, '$[9]') AS none FROM results")
_NAMES = r"list_distinct(list_transform(regexp_extract_all(concat_ws(' ', summary, description), '(?i)\bTC_[A-Z][A-Za-z0-9_]+'), lambda t: lower(t)))"
oracle("test_case_names", f"SELECT defect_id, coalesce(array_to_string(list_sort({_NAMES}), ','), '') AS names FROM defects")
oracle("embed_texts", """SELECT defect_id AS id, concat_ws(chr(10) || chr(10), nullif(trim(summary), ''), nullif(trim(substr(description, 1, 512)), '')) AS source_text FROM defects
    UNION ALL SELECT result_id, concat_ws(' | ', test_name, 'keyword: ' || failure_kw, failure_msg) FROM results WHERE status = 'FAIL'""")
oracle("status_bands", """SELECT defect_id, CASE WHEN s = 'triage' THEN 'triage' WHEN s IN ('inprogress', 'development', 'testing') THEN 'in_progress' WHEN s = 'labreview' THEN 'lab_review' WHEN starts_with(s, 'closed') THEN 'closed' ELSE 'other' END AS status_group,
    'https://issues.example.com/browse/' || defect_id AS url FROM (SELECT *, regexp_replace(lower(status), '[ -]', '', 'g') AS s FROM defects)""")
ORACLES["tokenise_stats"] = f"SELECT source, cast(sum(n) AS bigint) AS distinct_tokens, cast(max(n) AS integer) AS most FROM (SELECT source, len({_tokens('text')}) AS n FROM documents) GROUP BY 1"
ORACLES["benchmark_token_counts"] = f"SELECT item_id, cast(len({_tokens('text')}) AS integer) AS n_tokens, cast(length(text) AS integer) AS n_chars FROM benchmark"
oracle("tfidf_top_terms", r""", d AS (SELECT result_id AS doc, label AS grp, regexp_extract_all(lower(CASE WHEN c = '' THEN '_empty_' ELSE c END), '\b\w\w+\b') AS w FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(replace(replace(lower(failure_msg), '—', ' '), '–', ' '), '[!-/:-@\[-`{-~]', '', 'g'), '\b\d+\b', 'NUM', 'g'), '\b\w\b', '', 'g'), '\s+', ' ', 'g')) AS c FROM failed WHERE trim(failure_msg) <> '')),
    t AS (SELECT doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d), tf AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 500),
    raw AS (SELECT doc, term, (1.0 + ln(tf)) * (ln(((SELECT count(DISTINCT doc) FROM d) + 1.0) / (df + 1.0)) + 1.0) AS raw FROM tf JOIN df USING (term)),
    wt AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS weight FROM raw),
    g AS (SELECT grp, term, sum(weight) / any_value(n) AS score FROM wt JOIN d USING (doc) JOIN (SELECT grp, count(*) AS n FROM d GROUP BY 1) USING (grp) GROUP BY 1, 2)
    SELECT grp, term, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, term) AS k FROM g WHERE score > 0) WHERE k <= 8""", "failed")
oracle("defect_candidates_band", "SELECT defect_id, result_id, round(date_diff_days, 9) AS date_diff_days FROM pairs", "defects2", "results2", "pairs")
_REASON = """array_to_string(list_filter([CASE WHEN exact THEN 'exact test name ''' || test_name || ''' in defect text' END,
    CASE WHEN NOT exact AND len(stem) > 0 THEN 'stem word overlap [''' || array_to_string(list_sort(stem), ''', ''') || ''']' END,
    CASE WHEN len(hit) > 0 THEN 'failure keyword overlap [''' || array_to_string(list_sort(hit), ''', ''') || ''']' END, 'semantic: model unavailable (rule-only)'], lambda x: x IS NOT NULL), '; ')"""
oracle("rule_mappings", f"""SELECT mapping_id, defect_id, result_id, run_id, test_name, project AS defect_project, summary AS defect_summary, defect_status, priority AS defect_priority, reporter_email, round_even(date_diff_days, 4) AS date_diff_days, confidence_score,
    {_REASON} AS match_reason, email_match, 1 AS date_within_window, confirmed FROM rmaps""", *_RMAPS)
oracle("hybrid_mappings", "SELECT mapping_id, confidence_score, email_match, confirmed FROM maps", *_MAPS)
oracle("indexed_rule_mappings", "SELECT mapping_id, confidence_score, email_match, confirmed FROM rmaps", *_RMAPS, all_tests=True)
oracle("indexed_hybrid_mappings", "SELECT mapping_id, confidence_score, email_match, confirmed FROM maps", *_MAPS, all_tests=True)
oracle("match_reasons", f"SELECT reason, count(*) AS n FROM (SELECT trim(unnest(string_split({_REASON}, ';'))) AS reason FROM rmaps) WHERE reason <> '' GROUP BY 1", *_RMAPS)
oracle("run_order", "SELECT DISTINCT run_id, run_timestamp FROM results ORDER BY run_timestamp, cast(regexp_extract(run_id, '([0-9]+)$', 1) AS bigint), run_id")
oracle("runs_by_number", "SELECT run_id, pass_rate_pct FROM runs ORDER BY pass_rate_pct, cast(regexp_extract(run_id, '([0-9]+)$', 1) AS bigint), run_id")
oracle("drift_ranking", "SELECT test_name, percent_increase, model_confidence FROM report ORDER BY percent_increase DESC, model_confidence DESC, test_name", *_DRIFT)
oracle("flakiness_ranking", "SELECT test_name, failure_probability, flip_count FROM stand ORDER BY failure_probability DESC, flip_count DESC, test_name", "history", "stand")
oracle("anomaly_table", """SELECT run_id, build_no, pass_rate_pct, CASE WHEN z AND i THEN 'Both' WHEN z THEN 'Z-score' ELSE 'Isolation Forest' END AS detection_method,
    CASE WHEN z AND i THEN 'Critical' ELSE 'High' END AS severity, CASE WHEN z THEN 'Yes' ELSE 'No' END AS z_score_flag, CASE WHEN i THEN 'Yes' ELSE 'No' END AS forest_flag, CASE WHEN z AND i THEN 'Yes' ELSE 'No' END AS both
    FROM (SELECT *, coalesce(z_score >= 2, false) AS z, build_no % 7 = 0 AS i FROM rolled) WHERE z OR i ORDER BY pass_rate_pct, build_no, run_id""", "rolled")
oracle("duration_model_input", """, h AS (SELECT test_name, build_no, avg(duration_s) OVER (PARTITION BY test_name ORDER BY build_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, avg(duration_s) OVER f AS r,
    stddev_samp(duration_s) OVER f AS s, lag(duration_s) OVER (PARTITION BY test_name ORDER BY build_no) AS p FROM results WHERE duration_s > 0 WINDOW f AS (PARTITION BY test_name ORDER BY build_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    m AS (SELECT median(e) AS me, median(r) AS mr, median(s) AS ms, median(p) AS mp FROM h)
    SELECT test_name, build_no, status, round(coalesce(e, me), 9) AS expanding_mean, round(coalesce(r, mr), 9) AS rolling_mean_5, round(coalesce(s, ms), 9) AS rolling_std_5, round(coalesce(p, mp), 9) AS prev_duration
    FROM results LEFT JOIN h USING (test_name, build_no), m""")
oracle("duration_quantiles", "SELECT " + ", ".join(f"round(quantile_cont(duration_s, {p}), 9) AS {n}" for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0))) + " FROM results")
oracle("wide_trends", "SELECT build_no, " + ", ".join(f"count(*) FILTER (dashboard = '{c}') AS {c}" for c, _ in rules.DASHBOARD) + " FROM failed GROUP BY 1", "failed")
oracle("clusters_with_build", "SELECT result_id, build_no FROM failed", "failed")
oracle("tag_lists", "SELECT DISTINCT test_name, array_to_string(json_extract_string(tags, '$[*]'), '|') AS tags, cast(json_array_length(tags) AS integer) AS n FROM results")
oracle("mapping_listing", "SELECT mapping_id, description AS defect_description, confidence_score, round_even(date_diff_days, 4) AS date_diff_days FROM rmaps WHERE project = 'P1' AND confirmed = 1", *_RMAPS)
oracle("filter_options", "SELECT DISTINCT test_name FROM rmaps", *_RMAPS)
oracle("coverage_distinct", """SELECT count(DISTINCT r.result_id) AS total_failures, count(DISTINCT m.result_id) AS failures_with_defect, round(count(DISTINCT m.result_id) * 100.0 / nullif(count(DISTINCT r.result_id), 0), 1) AS coverage_pct
    FROM results r LEFT JOIN maps m ON r.result_id = m.result_id AND m.confirmed = 1 WHERE r.status = 'FAIL'""", *_MAPS)
oracle("linkage_per_test", """SELECT r.test_name, count(*) AS total_failures, count(DISTINCT m.defect_id) AS linked_defects, round(cast(avg(m.confidence_score) AS decimal(18, 9)), 2)::double AS avg_confidence
    FROM results r LEFT JOIN maps m ON r.result_id = m.result_id AND m.confirmed = 1 WHERE r.status = 'FAIL' GROUP BY 1""", *_MAPS)
oracle("coverage_kpis", """SELECT (SELECT count(*) FROM defects) AS total_defects, count(*) AS confirmed_mappings, count(DISTINCT test_name) AS unique_tests_covered, count(DISTINCT run_id) AS unique_runs_covered, coalesce(round(cast(avg(confidence_score) AS decimal(18, 9)), 3)::double, 0.0) AS avg_confidence,
    round_even(count(*) * 100.0 / (SELECT count(*) FROM results WHERE status = 'FAIL'), 1) AS coverage_pct FROM maps WHERE confirmed = 1""", *_MAPS)
oracle("sync_pending", "SELECT mapping_id FROM maps WHERE confirmed = 1 AND NOT EXISTS (SELECT 1 FROM synclog s WHERE s.mapping_id = maps.mapping_id AND s.status = 'success')", *_MAPS, "synclog")
oracle("sync_counts", """SELECT (SELECT count(*) FROM maps WHERE confirmed = 1) AS total_confirmed,
    (SELECT count(*) FROM maps WHERE confirmed = 1 AND NOT EXISTS (SELECT 1 FROM synclog s WHERE s.mapping_id = maps.mapping_id AND s.status = 'success')) AS pending""", *_MAPS, "synclog")
oracle("sync_history", "SELECT mapping_id, status, written_at FROM synclog ORDER BY written_at DESC, mapping_id", *_MAPS, "synclog")
_SOURCES = """SELECT defect_id AS entity_id, 'jira_defect' AS entity_type, concat_ws(chr(10) || chr(10), nullif(trim(summary), ''), nullif(trim(substr(description, 1, 512)), '')) AS source_text FROM defects
    UNION ALL SELECT result_id, 'test_result', concat_ws(' | ', test_name, 'keyword: ' || failure_kw, failure_msg) FROM results WHERE status = 'FAIL'"""
_PENDING = f"""wanted AS (SELECT *, length(entity_id) * 7 + ascii(right(entity_id, 1)) AS k FROM ({_SOURCES})), todo AS (SELECT entity_id, entity_type, source_text FROM wanted WHERE k % 3 = 0 OR k % 5 = 0 OR k % 7 = 0)"""
oracle("embeddings_pending", f", {_PENDING} SELECT * FROM todo")
oracle("embeddings_encoded", f", {_PENDING} SELECT entity_type, 1.0::double AS length, count(*) AS n FROM todo GROUP BY 1")
oracle("defect_listing", "SELECT defect_id, summary, status, priority, created FROM defects ORDER BY created DESC, defect_id")
oracle("defects_per_project", "SELECT project, count(*) AS n_defects FROM defects GROUP BY 1 ORDER BY 2 DESC, 1")
oracle("confidence_bands", "SELECT test_name, CASE WHEN failure_probability >= 0.75 THEN 'high' WHEN failure_probability >= 0.5 THEN 'medium' WHEN failure_probability >= 0.25 THEN 'low' ELSE 'none' END AS band FROM stand", "history", "stand")
oracle("sync_stats", "SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'skipped') AS skipped FROM synclog", *_MAPS, "synclog")
_DUP = f"""t AS MATERIALIZED (SELECT defect_id, created, vector, words, {_NAMES} AS names FROM defects2), u AS (SELECT defect_id, created, unnest(names) AS name FROM t),
    ids AS (SELECT DISTINCT a.defect_id AS defect_a, b.defect_id AS defect_b, abs(epoch_us(a.created) - epoch_us(b.created)) / 86400000000.0 AS gap FROM u a JOIN u b ON a.name = b.name AND a.defect_id < b.defect_id
    WHERE abs(epoch_us(a.created) - epoch_us(b.created)) / 86400000000.0 <= 14),
    m AS (SELECT defect_a, defect_b, gap, list_intersect(a.names, b.names) AS shared, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS jac,
    list_cosine_similarity(a.vector::double[], b.vector::double[]) AS cos FROM ids JOIN t a ON a.defect_id = defect_a JOIN t b ON b.defect_id = defect_b)"""
oracle("duplicate_pairs_jaccard", f", {_DUP} SELECT defect_a, defect_b, round(jac, 3) AS similarity, round(round_even(gap, 2), 3) AS date_diff_days, array_to_string(list_sort(shared), ',') AS shared_test_names, 'jaccard' AS method FROM m WHERE jac >= 0.6", "defects2")
oracle("duplicate_pairs_cosine", f", {_DUP} SELECT defect_a, defect_b, round(round_even(coalesce(cos, jac), 4), 3) AS similarity, round(round_even(gap, 2), 3) AS date_diff_days FROM m WHERE coalesce(cos, jac) >= 0.2", "defects2")
ORACLES["embedding_max_similarity"] = """SELECT a.vec_id AS id, round(max(list_cosine_similarity(a.embedding::double[], q.embedding::double[])), 3) AS max_similarity FROM embeddings a, embeddings q WHERE q.vec_id % 20 = 0 AND a.vec_id <> q.vec_id GROUP BY 1"""
ORACLES["silhouette_of_labels"] = """WITH d AS (SELECT a.vec_id AS id, a.label AS own, b.label AS other, sum(list_distance(a.embedding::double[], b.embedding::double[])) AS total, count(*) AS n FROM embeddings a, embeddings b GROUP BY ALL),
    s AS (SELECT id, max(n) FILTER (own = other) AS n, max(total / nullif(n - 1, 0)) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b FROM d GROUP BY 1)
    SELECT round(avg(CASE WHEN n = 1 THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END), 6) AS silhouette FROM s"""
oracle("registry_link_class", "SELECT d.defect_id, any_value(d.project) AS project, CASE max(m.confirmed) WHEN 1 THEN 'confirmed' WHEN 0 THEN 'candidate' ELSE 'unmapped' END AS link_class FROM defects d LEFT JOIN rmaps m USING (defect_id) GROUP BY 1", *_RMAPS)
oracle("multi_test_defects", "SELECT defect_id, count(DISTINCT test_name) AS n_tests FROM rmaps GROUP BY 1 HAVING count(DISTINCT test_name) > 1", *_RMAPS)
_NUM = ("build_no", "duration_s", "run_pass_rate", "test_no")
oracle("correlation", ", c AS (SELECT r.build_no, r.duration_s, u.pass_rate_pct AS run_pass_rate, r.idx AS test_no FROM results r JOIN runs u USING (run_id)) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS r FROM c" for i, a in enumerate(_NUM) for b in _NUM[i:]))
oracle("percentiles", "SELECT test_name, " + ", ".join(f"round(quantile_cont(duration_s, {p}), 9) AS p{round(p * 100)}" for p in (0.5, 0.75, 0.9, 0.95)) + " FROM results GROUP BY 1")
oracle("histogram", "SELECT cast(least(floor((duration_s - lo) / (hi - lo) * 25), 24) AS integer) AS bin, count(*) AS n FROM results, (SELECT min(duration_s) AS lo, max(duration_s) AS hi FROM results) GROUP BY 1")
oracle("one_hot", "SELECT result_id, " + ", ".join(f"CASE WHEN json_extract_string(tags, '$[1]') = '{v}' THEN 1 ELSE 0 END AS tag_{v}" for v in ("feature_login", "feature_usermgmt")) + " FROM results")
oracle("standard_scaling", "SELECT run_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 9) AS {c}" for c in ("pass_rate_pct", "duration_s")) + " FROM runs")
oracle("class_balance", "SELECT count(*) AS n, cast(sum(target) AS bigint) AS positive, round(avg(target), 9) AS share FROM featured", "featured")
oracle("confusion_metrics", """SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy
    FROM (SELECT count(*) FILTER (s AND t) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (NOT s AND t) AS fn, count(*) FILTER (NOT s AND NOT t) AS tn FROM (SELECT score::double >= 0.75 AS s, target = 1 AS t FROM featured))""", "featured")
oracle("roc_auc", ", g AS (SELECT round(score, 3) AS s, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM featured GROUP BY 1) SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 9) AS auc FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)", "featured")
oracle("roc_curve", ", g AS (SELECT round(score::double, 1) AS s, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM featured GROUP BY 1) SELECT s AS threshold, round(sum(p) OVER (ORDER BY s DESC) / sum(p) OVER (), 9) AS tpr, round(sum(n) OVER (ORDER BY s DESC) / sum(n) OVER (), 9) AS fpr FROM g", "featured")
oracle("adjusted_rand_index", """, c AS (SELECT label AS a, dashboard AS b, count(*) AS n FROM failed WHERE trim(failure_msg) <> '' GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS ij, (SELECT sum(n) FROM c) AS t,
    (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS i, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS j)
    SELECT round((ij - i * j / (t * (t - 1) / 2.0)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2.0)), 9) AS ari FROM s""", "failed")
oracle("mode_by_test", "SELECT test_name, failure_kw AS mode FROM (SELECT test_name, failure_kw, row_number() OVER (PARTITION BY test_name ORDER BY count(*) DESC, failure_kw) AS k FROM failed GROUP BY 1, 2) WHERE k = 1", "failed")
oracle("duration_by_status", "SELECT status, round(avg(duration_s), 9) AS mean, round(min(duration_s), 9) AS min, round(max(duration_s), 9) AS max FROM results GROUP BY 1")
oracle("upsert_ignore", "SELECT * FROM old UNION ALL SELECT * FROM new WHERE run_id NOT IN (SELECT run_id FROM old)", "oldnew")
oracle("upsert_replace", "SELECT * FROM new UNION ALL SELECT * FROM old WHERE run_id NOT IN (SELECT run_id FROM new)", "oldnew")
oracle("not_ingested", "SELECT run_id FROM new WHERE run_id NOT IN (SELECT run_id FROM old)", "oldnew")
for _k in list(ORACLES):  # a query that goes on with common table expressions starts with a comma
    ORACLES[_k] = ORACLES[_k].replace("\n, ", ",\n")
