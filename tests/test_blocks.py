"""Pairs that are made in cells: against plain versions, and never shuffled."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.operators import blocks, mapping

AT = datetime.datetime(2024, 5, 1)


def shuffles_above_pairs(df) -> int:
    """Exchanges that rows pass after they come out of the cells."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.split("MapInArrow")[0].count("Exchange")


def named_defects(spark, with_vectors):
    rng = np.random.default_rng(7)
    texts = ["tc_user_1 timeout", "TC_User_1 and tc_login_x fail", "tc_login_x TC_User_1 page slow", "TC_Login_X", "tc_user_1 timeout element", "no name here"]
    rows = []
    for i in range(90):
        vector = None if i % 7 == 0 else [0.0] * 4 if i % 11 == 0 else [float(x) for x in rng.normal(size=4)]
        created = None if i % 13 == 0 else AT + datetime.timedelta(days=float(rng.integers(0, 60)), microseconds=int(rng.integers(0, 9)))
        rows.append((f"D{i}", texts[i % 6] if i % 17 else None, texts[(i * 5) % 6] if i % 2 else None, created, vector))
    df = spark.createDataFrame(rows, "defect_id string, summary string, description string, created timestamp, vector array<double>")
    return df if with_vectors else df.drop("vector"), rows


@pytest.mark.parametrize("with_vectors", (True, False))
@pytest.mark.parametrize("few", (3, 512))
def test_duplicates_are_those_of_all_pairs(spark, monkeypatch, with_vectors, few):
    monkeypatch.setattr(blocks, "HELD", 5)
    monkeypatch.setattr(mapping, "FEW", few)
    df, rows = named_defects(spark, with_vectors)
    import re

    want = {}
    made = []
    for i, s, d, t, v in rows:
        text = f"{s or ''} {d or ''}"
        made.append((i, set(re.findall(r"[a-z0-9]{2,}", text.lower())) - {"and"}, {x.lower() for x in re.findall(r"(?i)\bTC_[A-Z][A-Za-z0-9_]+", text)}, t, v if with_vectors else None))
    for i, wi, ni, ti, vi in made:
        for j, wj, nj, tj, vj in made:
            gap = None if ti is None or tj is None else abs((ti - tj).total_seconds()) / 86400
            if i < j and ni & nj and (gap is None or gap <= 14):
                both = vi is not None and vj is not None
                length = np.linalg.norm(vi) * np.linalg.norm(vj) if both else 1
                sim = (float(np.dot(vi, vj) / length) if length else 0.0) if both else len(wi & wj) / len(wi | wj)
                if sim >= 0.3:
                    want[i, j] = (round(sim, 3), None if gap is None else round(gap, 1), sorted(ni & nj), "cosine" if both else "jaccard")
    out = mapping.duplicates(df, 14, 0.3)
    got = out.collect()
    assert shuffles_above_pairs(out) == 0
    assert len(got) == len(want) > 100
    for r in got:
        sim, gap, names, method = want[r.defect_a, r.defect_b]
        assert abs(r.similarity - sim) < 2e-3 and r.shared_test_names == names and r.method == method
        assert (gap is None) == (r.date_diff_days is None) and (gap is None or abs(r.date_diff_days - gap) < 0.2)


def test_overlap_counts_frequent_and_rare_words():
    rng = np.random.default_rng(1)
    sides = [[[f"w{k}" for k in np.unique(rng.zipf(1.3, size=6)) if k < 900] if i % 9 else (None if i % 2 else []) for i in range(n)] for n in (700, 500)]
    a, b = (pa.array(s, pa.list_(pa.string())) for s in sides)
    found = blocks.Overlap(a, b)
    want = np.array([[len(set(x or ()) & set(y or ())) for y in sides[1]] for x in sides[0]])
    assert (found.times > 0).any() and found.a.shape[1] > 0
    got = np.vstack([found.block(s) for s in blocks.spans(700, 300)])
    assert (got == want).all()


def test_silhouette_and_nearest_query_compare_in_blocks(spark, monkeypatch):
    """No join compares the pairs of rows; the results are those of plain numpy."""
    from pulsegrid.operators import models

    monkeypatch.setattr(models, "POINTS", 20)
    monkeypatch.setattr(mapping, "SEARCHED", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 3)).round(1)
    x[5], x[6] = x[4], 0.0
    k = [None if i % 10 == 3 else i % 4 if i else 99 for i in range(70)]
    df = spark.createDataFrame([(i, [float(y) for y in x[i]], k[i]) for i in range(70)], "id long, vector array<double>, k int")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    scores = []
    for i in range(70):
        if k[i] is None or k.count(k[i]) == 1:
            scores.append(0.0)
            continue
        mean = {c: d[i, [j for j in range(70) if k[j] == c]].sum() for c in set(k) - {None}}
        a = mean[k[i]] / (k.count(k[i]) - 1)
        b = min(mean[c] / k.count(c) for c in mean if c != k[i])
        scores.append((b - a) / max(a, b))
    out = models.silhouette(df, "vector", "k")
    assert abs(out.first()[0] - np.mean(scores)) < 1e-9
    near = mapping.max_similarity(df.filter("id % 7 = 0"), df)
    for plan in (out, near):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(1)[:, None])
    dots = u @ u[::7].T
    dots[np.arange(0, 70, 7), np.arange(10)] = -2
    assert {r.id: round(r.max_similarity, 9) for r in near.collect()} == {i: round(float(m), 9) for i, m in enumerate(dots.max(1))}


@pytest.mark.parametrize("days", (7.0, None))
def test_mappings_give_the_reasons_of_all_pairs_and_shuffle_none(spark, monkeypatch, days):
    from test_mapping_index import sides

    monkeypatch.setattr(mapping, "MET", 10)
    d, r = (t.drop("vector") for t in sides(spark))
    plain = mapping.with_hybrid_score(mapping.with_rule_score(mapping.candidates(d, r, days))).filter("confidence_score >= 0.25")
    columns = ("defect_id", "result_id", "confidence_score", "match_reason", "date_diff_days")
    out = mapping.mappings(d, r, None, days)
    got = sorted(map(repr, out.select(*columns[:4]).collect()))
    assert got == sorted(map(repr, plain.select(*columns[:4]).collect())) and len(got) > 100
    out.collect()
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert shuffles_above_pairs(out) == 0


def test_scores_do_not_need_the_reasons(spark):
    from test_mapping_index import sides

    d, r = sides(spark)
    columns = ("mapping_id", "confidence_score", "email_match", "confirmed")
    bare, full = (sorted(map(repr, mapping.mappings(d, r, "qa@example.com", reasons=x).select(*columns).collect())) for x in (False, True))
    assert bare == full and len(bare) > 100
