"""Candidates by index and the range join of vectors against all pairs."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import mapping, vectors

AT = datetime.datetime(2024, 5, 1)
D_SCHEMA = "defect_id string, project string, summary string, description string, reporter_email string, status string, priority string, created timestamp, vector array<double>"
R_SCHEMA = "result_id string, run_id string, test_name string, failure_msg string, failure_kw string, run_timestamp timestamp, status string, vector array<double>"


def at(days: float | None):
    return None if days is None else AT + datetime.timedelta(days=days)


def sides(spark):
    rng = np.random.default_rng(3)

    def vec(i):
        return None if i % 7 == 0 else [0.0] * 6 if i % 11 == 0 else [float(x) for x in rng.normal(size=6).round(1)]

    texts = ["TC_Login_SSO_1 fails", "tc_login_sso_12: spinner", "login page slow", "", None, "Ab broke", "export rows missing", "TIMEOUT of the spinner overlay", "xtc_a_y"]
    names = ["TC_Login_SSO_1", "TC_Login_SSO_12", "Ab", "", None, "TC_Export_Rows", "x", "TC_A", "Zz_Page_Login"]
    d = [(f"D{i}", "P", texts[i % 9], texts[(i * 5) % 9] if i % 3 else None, "", "New", "High", at(None if i == 5 else i * 0.9), vec(i)) for i in range(45)]
    r = [(f"R{i}", "run", names[i % 9], "spinner still visible" if i % 2 else "rows missing", None, at(None if i == 8 else (i * 1.3) % 40), "FAIL" if i % 10 else "PASS", vec(i + 1)) for i in range(60)]
    return spark.createDataFrame(d, D_SCHEMA), spark.createDataFrame(r, R_SCHEMA)


@pytest.mark.parametrize("with_vectors", (True, False))
@pytest.mark.parametrize("days", (7.0, None))
def test_index_stores_what_all_pairs_store(spark, days, with_vectors):
    d, r = sides(spark)
    if not with_vectors:
        d, r = d.drop("vector"), r.drop("vector")
    want, got = (mapping.mappings(d, r, "qa@example.com", days, indexed=i).select("mapping_id", F.round("confidence_score", 3), "confirmed", "test_name").collect() for i in (False, True))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(got) > 100


def test_no_defects_or_no_failures(spark):
    d, r = sides(spark)
    assert mapping.mappings(d.limit(0), r, None, indexed=True).count() == 0
    assert mapping.mappings(d, r.limit(0), None, indexed=True).count() == 0


@pytest.mark.parametrize("least", (0.3, 0.8, 0.99))
def test_similar_vectors_are_those_of_all_pairs(spark, least):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    a, b = ([[float(x) for x in centres[i % 12] + rng.normal(size=16) * 0.15] for i in range(n)] for n in (300, 400))
    b[0], b[1], a[0] = a[1], a[1], [0.0] * 16
    left, right = (spark.createDataFrame([(f"{k}", v) for k, v in enumerate(x)] + [("none", None)], "key string, v array<double>") for x in (a, b))
    unit = [np.array(x) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (np.array(a), np.array(b))]
    dots = unit[0] @ unit[1].T
    want = {(str(i), str(j)) for i, j in zip(*np.nonzero(dots >= least), strict=True)}
    found = vectors.similar(left, right, least, pivots=24, block=50).collect()
    assert len(found) == len(want) and {(x.left_key, x.right_key) for x in found} == want
    compared = sum(m * n for m, n in vectors.cells(left, right, least, pivots=24).sizes.values()) / (len(a) * len(b))
    print(f"least {least}: {compared:.2f} of the pairs compared")
    assert compared < (0.3 if least >= 0.8 else 1.01)
