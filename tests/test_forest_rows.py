"""The forest's feature rows are made once and stored for all that reads them."""

from __future__ import annotations

import pytest

from pulsegrid.operators import models, tests
from pulsegrid.sources import adapter


@pytest.mark.parametrize("report", ["feature_importances", "flakiness_predictions"])
def test_the_fit_reads_stored_rows(spark, sf, monkeypatch, report):
    results = adapter.frames(spark, sf).results
    plain = tests.flakiness_features(results)
    levels = models.tag_levels(plain)
    want, names = models.encoded_features(plain, levels)
    want = sorted(want.collect())
    seen = []

    def fit(features, columns, seed=42):
        seen.append((features.columns, columns, sorted(features.collect()), features._jdf.queryExecution().withCachedData().toString()))

    def again(*args, **kwargs):
        raise AssertionError("the features are made anew for each reader")

    monkeypatch.setattr(models, "fit_forest", fit)
    monkeypatch.setattr(tests, "flakiness_features", again)
    getattr(models, report)(results).collect()
    ((columns, given, rows, plan),) = seen
    assert "InMemoryRelation" in plan and "Window [" not in plan.split("InMemoryRelation")[0]
    assert set(given) == set(names) and len(rows) == len(want) > 0
    at = [plain.columns.index(c) for c in plain.columns]
    assert [[r[c] for c in plain.columns] for r in rows] == [[r[k] for k in at] for r in want]


def test_latest_rows_are_those_without_a_next_run(spark, sf):
    results = adapter.frames(spark, sf).results
    rows = tests.flakiness_rows(results)
    n = rows.count()
    assert n == tests.flakiness_features(results).count() + tests.flakiness_features(results, labelled=False).count()
    assert rows.filter("latest and target is not null").count() == 0
