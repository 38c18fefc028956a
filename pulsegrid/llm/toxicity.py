"""Toxicity severity by cumulative-link (proportional odds) regression.

Features are hashed words and word beginnings. One weight vector is shared by
all ordered thresholds: ``P(grade > k) = sigmoid(x.w - theta_k)``, and the
expected severity is the sum of these over k. Features that do not lean to the
toxic side of the training sample beyond chance are screened out, so long texts
do not gather noise.

The labels say toxic or not; the grades of toxic training texts are the thirds
of their screening evidence, the sum of the screened features' z scores. The model is fitted on a bounded sample
of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN, documented parameters), and
every document is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_text, columns_only, keep, ship

SAMPLE_TOXIC = 3000
SAMPLE_CLEAN = 5000
BITS = 22
GRADES = 4
#: Least toxic texts of a feature, and least z score of its lean to them.
LEAST_TEXTS, SCREEN = 3, 3.0
#: A document is toxic where a grade above 0 is likelier than not.
TOXIC_AT = 0.5
BEGINNINGS = range(4, 10)
CACHE = 150_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MASK = (1 << BITS) - 1


def word_features(token: str) -> tuple[int, ...]:
    """Hashed features of one white-space token: its word and its beginnings."""
    w = _EDGE.sub("", token.lower())
    if len(w) < 3:
        return ()
    parts = [w, *(w[:k] + "*" for k in BEGINNINGS if k < len(w))]
    return tuple(xxhash.xxh32_intdigest(p.encode()) & _MASK for p in parts)


class _Known(dict):
    """token -> features, forgotten as a whole when it has grown too large."""

    def __init__(self, only: frozenset[int] | None = None):
        self.only = only

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > (CACHE if self.only is None else 3 * CACHE):  # most words have no feature then
            self.clear()
        f = word_features(token)
        if self.only is not None:
            f = tuple(x for x in f if x in self.only)
        self[token] = f
        return f


def text_features(text: str, known: _Known) -> Counter[int]:
    """Feature counts of a whole text."""
    found: Counter[int] = Counter()
    for f in filter(None, map(known.__getitem__, text.split())):
        found.update(f)
    return found


@dataclass
class Ordinal:
    """weights: feature -> weight; theta: ascending thresholds."""

    weights: dict[int, float]
    theta: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row per score."""
        return 1.0 / (1.0 + np.exp(np.clip(self.theta[None, :] - score[:, None], -60, 60)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_ordinal(
    row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, n_cols: int, l2: float = 0.5, steps: int = 600
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by full-batch Adam on the penalised
    cumulative-link likelihood; (row, col, value) is the sparse design."""
    n, k = len(grade), int(GRADES) - 1
    w, a = np.zeros(n_cols), np.concatenate([[1.0], np.zeros(k - 1)])  # theta: first, then log steps
    m, v = np.zeros(n_cols + k), np.zeros(n_cols + k)
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([a[:1], np.exp(a[1:])]))
        s = np.bincount(row, value * w[col], n)
        upper = np.where(grade < k, _sigmoid(theta[np.minimum(grade, k - 1)] - s), 1.0)
        lower = np.where(grade > 0, _sigmoid(theta[np.maximum(grade, 1) - 1] - s), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gs = du - dl  # of the negative log likelihood by s
        gt = np.zeros(k)
        np.add.at(gt, grade[grade < k], -du[grade < k])
        np.add.at(gt, grade[grade > 0] - 1, dl[grade > 0])
        ga = np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(a[j]) for j in range(1, k)]])
        g = np.concatenate([np.bincount(col, value * gs[row], n_cols) + l2 * w, ga])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, a = w - step[:n_cols], a - step[n_cols:]
    return w, np.cumsum(np.concatenate([a[:1], np.exp(a[1:])]))


def fit(features: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray) -> Ordinal:
    """The model of a labelled sample: per text its feature ids and their counts.
    Without both classes, a model that calls nothing toxic. Beside the sample,
    memory holds one count per class and hash, and the screened features."""
    toxic = toxic.astype(bool)
    nothing = Ordinal({}, np.arange(GRADES - 1) + 20.0)
    if toxic.all() or not toxic.any():
        return nothing
    has = np.zeros((2, _MASK + 1), np.int32)
    for f, y in zip(features, toxic, strict=True):
        has[int(not y), f] += 1  # a text names a feature once
    often = np.nonzero(has[0] >= LEAST_TEXTS)[0]
    seen, n = has[:, often].astype(float), np.array([[toxic.sum()], [(~toxic).sum()]])
    odds = np.log((seen + 0.5) / (n + 1))
    z = (odds[0] - odds[1]) / np.sqrt((1 / (seen + 0.5)).sum(axis=0))
    chosen, z = often[z > SCREEN], z[z > SCREEN]
    if not len(chosen):
        return nothing
    number = np.full(_MASK + 1, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    rows, cols, tfs = [], [], []
    for k, (f, c) in enumerate(zip(features, counts, strict=True)):
        at = number[f]
        cols.append(at[at >= 0])
        tfs.append(np.log1p(c[at >= 0].astype(float)))
        rows.append(np.full(len(cols[-1]), k))
    row, col, tf = map(np.concatenate, (rows, cols, tfs))
    evidence = np.bincount(row, tf * z[col], len(features))
    cuts = np.quantile(evidence[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, evidence), 0)
    w, theta = fit_ordinal(row, col, tf, grade, len(chosen))
    return Ordinal({int(f): float(x) for f, x in zip(chosen, w, strict=True)}, theta)


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> DataFrame:
    """(toxic, text) of at most that many labelled documents of either class, by
    hash order of the id. A document with several labels counts as toxic if any
    says so; null ids and labels are left out."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = F.xxhash64("doc_id", F.lit(7))

    def some(test: str, n: int) -> DataFrame:
        return known.filter(test).orderBy(drawn, "doc_id").limit(n)

    few = some("toxic > 0", toxic_rows).unionByName(some("toxic <= 0", clean_rows))  # a bound by construction
    return columns_only(docs, "doc_id", "text").join(F.broadcast(few), "doc_id").select("toxic", "text")


def _leaning(few: DataFrame) -> frozenset[int]:
    """The features that may pass the screening of :func:`fit`, counted on the
    executors; those that a sample's text has beside them never leave these."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        texts: dict[int, list[int]] = {}
        for b in it:
            for toxic, t in zip(b.column(0).to_pylist(), as_text(b.column(1)), strict=True):
                for f in text_features(t, known):
                    texts.setdefault(f, [0, 0])[toxic <= 0] += 1
        n = np.array(list(texts.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["feature", "toxic", "clean"])

    counted = few.mapInArrow(run, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = {toxic: k for toxic, k in few.groupBy(F.col("toxic") > 0).count().collect()}
    seen = [F.col("toxic") + 0.5, F.col("clean") + 0.5]
    odds = F.ln(seen[0] / (n.get(True, 0) + 1)) - F.ln(seen[1] / (n.get(False, 0) + 1))
    leans = odds / F.sqrt(1 / seen[0] + 1 / seen[1]) > 0.99 * SCREEN
    found = counted.filter((F.col("toxic") >= LEAST_TEXTS) & leans).select("feature").toArrow()  # features of a model, fewer than hashes
    return frozenset(found.column(0).to_pylist())


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> Ordinal:
    """Fits the model; features are counted on the executors and only the bounded
    sample's counts of screened features come to the driver."""
    ship(docs.sparkSession)
    few = keep(sample(docs, labels, toxic_rows, clean_rows).select(F.col("toxic").cast("int").alias("toxic"), "text"), "sample")
    only = docs.sparkSession.sparkContext.broadcast(_leaning(few))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(only.value)
        for b in it:
            counts = [dict(sorted(text_features(t, known).items())) for t in as_text(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([np.fromiter(c.keys(), "<u4", len(c)).tobytes() for c in counts], pa.binary()),
                    pa.array([np.fromiter(c.values(), "<u4", len(c)).tobytes() for c in counts], pa.binary()),
                ],
                ["toxic", "ids", "counts"],
            )

    got = few.mapInArrow(run, "toxic int, ids binary, counts binary").toArrow()
    # one order whatever the partitioning, so that the fit is the same
    toxic = got.column(0).to_numpy() > 0
    ids, counts = ([np.frombuffer(x.as_buffer(), "<u4") for x in got.column(k)] for k in (1, 2))
    order = sorted(range(len(ids)), key=lambda k: (toxic[k], ids[k].tobytes(), counts[k].tobytes()))
    return fit([ids[k] for k in order], [counts[k] for k in order], toxic[order])


def scored(docs: DataFrame, model: Ordinal, severity: str = "severity", p_toxic: str = "p_toxic") -> DataFrame:
    """``docs`` with two columns for every whole text, by the names given: the
    expected grade, 0 to GRADES - 1, and the probability of a grade above 0. Null
    and empty texts score as no features at all; repeated rows score alike; an
    empty table stays empty; further columns are kept as they are, but columns of
    those two names give way."""
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (severity, p_toxic)]
    names = [f.name for f in kept]
    schema = type(docs.schema)(kept).add(severity, "double").add(p_toxic, "double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = model.weights, _Known(frozenset(model.weights))
        at = names.index("text")
        for b in it:
            score = np.array(
                [sum(weights[f] * np.log1p(n) for f, n in sorted(text_features(t, known).items())) for t in as_text(b.column(at))], float
            )
            p = model.above(score)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.sum(axis=1)), pa.array(p[:, 0])], [*names, severity, p_toxic])

    return docs.select(*[docs[n] for n in names]).mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, p_toxic, is_toxic) for every row of ``docs``."""
    out = scored(columns_only(docs, "doc_id", "text"), train(docs, labels))
    return out.select("doc_id", "severity", "p_toxic", (F.col("p_toxic") >= TOXIC_AT).alias("is_toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, columns unchanged, whatever their
    names; null and empty texts are not toxic; repeated rows share their fate; an
    empty table stays empty."""
    severity, p_toxic = "_severity", "_p_toxic"
    while {severity, p_toxic} & {c.lower() for c in docs.columns}:
        severity, p_toxic = severity + "_", p_toxic + "_"
    return scored(docs, train(docs, labels), severity, p_toxic).filter(F.col(p_toxic) < TOXIC_AT).select(*docs.columns)
