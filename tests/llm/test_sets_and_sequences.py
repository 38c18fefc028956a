"""Operators 11 to 13 against brute-force versions, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import importance, periodic, queries, set_join, words

DOCS = "doc_id long, text string, lang string, row long, node long, rank string, runs int"
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (4, "word"), (5, "word"), (None, "no id here at all"), (None, None), (6, "a b c " * 30_000), (7, "ünï 𝄞 codé"), (8, "x" * 100_000), (9, "A\x0bB\x1cc d")]


def docs_of(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "en", 1, 2, "r", 3) for i, t in texts], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def plain_words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


# --- words -------------------------------------------------------------------


def test_words_of_a_column():
    texts = ["a b", None, "", " x ", "y", "The the THE", "é ü", "b", "w" * 600_000 + " z"]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1), pa.array(texts, pa.large_string())):
        data, bounds = words.buffer_of(column)
        start, length, first = words.located(data, bounds)
        h = words.word_hashes(data, start, length)
        got = [[data[start[k] : start[k] + length[k]].tobytes() for k in range(a, b)] for a, b in zip(first, first[1:])]
        assert got == [plain_words(t) for t in texts]
        flat = [w.lower() for ws in got for w in ws]
        assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(h.tolist(), flat)))
        sh, at = words.shingles(h, first, 3)
        assert np.diff(at).tolist() == [max(len(w) - 2, min(len(w), 1)) for w in got]


# --- 11 similar sets ----------------------------------------------------------


def shingle_set(t):
    w = [x.lower() for x in plain_words(t)]
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    by = {}
    for k, s in enumerate(sets):
        if s:
            root[top(k)] = top(by.setdefault(s, k))
    kinds = sorted(by, key=len)
    for i, s in enumerate(kinds):
        for t in kinds[i + 1 :]:
            if 10 * len(s) < 9 * len(t):
                break
            both = len(s & t)
            if 100 * both >= 90 * (len(s) + len(t) - both):
                root[top(by[s])] = top(by[t])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_texts(seed=3, groups=40):
    """Texts and copies with a few words changed, about the similarity that links."""
    rng, vocabulary, out = random.Random(seed), [f"w{k}" for k in range(4000)], []
    passage = rng.choices(vocabulary, k=60)
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 12, 25, 40, 120, 400, 1500]))
        if g % 3 == 0:
            base += passage
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(copy) // 40) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: len(copy) - rng.randrange(0, len(copy) // 8 + 1)]
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


def test_similar_sets(spark, monkeypatch):
    monkeypatch.setattr(set_join, "CELL", 2)
    monkeypatch.setattr(set_join, "PARTNERS", 2)
    rows = near_texts()
    assert as_set(set_join.similar_sets(docs_of(spark, rows))) == sorted(brute_components(rows), key=repr)


@pytest.mark.parametrize("cell", [set_join.CELL, 3])
def test_every_link_is_found_without_the_first_pass(spark, monkeypatch, cell):
    """Tiles alone find all links, whatever the first pass leaves."""
    monkeypatch.setattr(set_join, "CELL", cell)
    monkeypatch.setattr(set_join, "CELL_ITEMS", 4000 * cell)
    monkeypatch.setattr(set_join, "starred", lambda texts: texts.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    rows = near_texts(11)
    assert as_set(set_join.similar_sets(docs_of(spark, rows))) == sorted(brute_components(rows), key=repr)


def test_similar_sets_of_the_corpus(spark, sf, corpus):
    assert as_set(queries.op11_ngram_jaccard_join(spark, sf)) == sorted(brute_components(corpus), key=repr)


def test_similar_sets_edges(edge, empty):
    assert as_set(set_join.similar_sets(edge)) == sorted(brute_components(EDGE), key=repr)
    assert set_join.similar_sets(empty).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n in (1, 5, 33, 400, 5000):
        a = words.distinct(rng.integers(0, 1 << 64, n, np.uint64))
        b = words.distinct(np.concatenate([a[: n // 2], rng.integers(0, 1 << 64, n, np.uint64)]))
        x, y = set_join.bitmap(a), set_join.bitmap(b)
        w = min(len(x), len(y))
        apart = int(np.bitwise_count(set_join.folded(x, w) ^ set_join.folded(y, w)).sum())
        assert 2 * len(np.intersect1d(a, b)) <= len(a) + len(b) - apart


def test_linked_sets_share_a_part():
    """However the n-grams in which two sets differ, and empty parts, are spread."""
    rng = np.random.default_rng(7)
    least = 0
    for n in [*range(9, 140), 500, 1499, 1700, 6000]:
        for spread in (64, 64, 61, 58, 40):  # bits of the hashes: below 64, they leave most parts empty
            a = words.distinct(rng.integers(0, (1 << spread) - 1, n, np.uint64))
            for share in (0.0, 0.5, 1.0):
                gone = int(set_join.apart_at_most(len(a)) * share)
                kept = np.delete(a, np.linspace(0, len(a) - 1, gone).astype(int)) if gone else a
                more = 0
                while 10 * len(kept) >= 9 * (len(a) + more + 1):
                    more += 1
                b = words.distinct(np.concatenate([kept, np.linspace(a[0], a[-1], more + 2)[1:-1].astype(np.uint64) + np.uint64(1)]))
                both = len(np.intersect1d(a, b))
                if len(a) + len(b) == 2 * both or 10 * both < 9 * (len(a) + len(b) - both):
                    continue
                least += 1
                assert len(np.intersect1d(set_join.part_hashes(a), set_join.part_hashes(b))), (n, spread, share)
    assert least > 1000
    for n in range(1, 3000):
        assert set_join.band_start(set_join.band_of(n)) <= n < set_join.band_start(set_join.band_of(n) + 1)


def test_unlike_sets_with_a_passage_in_common_do_not_meet(spark, monkeypatch):
    """What is dealt to cells follows the sets that are alike, not shared n-grams."""
    rng, cells, keep = random.Random(4), [], set_join.keep

    def kept(df, name="t", codec="zstd"):
        out = keep(df, name, codec)
        if name == "cells":
            cells.append(out.count())
        return out

    monkeypatch.setattr(set_join, "keep", kept)
    rows = []
    for _ in range(1500):
        passage = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(len(rows) + k, " ".join([f"w{rng.randrange(10**6)}" for _ in range(140)] + passage)) for k in range(2)]
    assert set_join.similar_sets(docs_of(spark, rows)).filter("component_id <> doc_id").count() == 0
    assert len(cells) == 1 and cells[0] < 100


# --- 12 importance resampling -------------------------------------------------


def features(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return w, [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute_resampled(rows, target):
    bags = [features(t) for _, t in rows]
    s, t = Counter(x for _, f in bags for x in f), Counter(x for y in target for x in features(y)[1])
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))

    out = []
    for (i, _), (w, f) in zip(rows, bags):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("chunk", [importance.CHUNK, 7])
def test_resampling(spark, sf, corpus, monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert as_set(queries.op12_importance_resampling(spark, sf)) == brute_resampled(corpus, target)


@pytest.mark.parametrize("chunk", [importance.CHUNK, 2])
def test_resampling_edges(spark, edge, empty, monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    long = [(40 + k % 3, f"{'y' * (60 + k)} Alpha-beta {k} " * 12) for k in range(9)]
    rows = EDGE + long + [(40, long[0][1])] * 5 + [(None, long[1][1])] * 4
    target = docs_of(spark, [(1, "alpha beta beta " + "y" * 63), (2, None)])
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    got = importance.resample_report(docs_of(spark, rows), target).select(*cols)
    assert as_set(got) == brute_resampled(rows, ["alpha beta beta " + "y" * 63])
    assert importance.resample_report(empty, target).count() == 0
    none = importance.resample_report(edge, empty).select(*cols)
    assert as_set(none) == brute_resampled(EDGE, [])


def test_resampled_rows(spark):
    rows = [(k, " ".join(f"w{k * j % 17}" for j in range(30))) for k in range(40)] + [(7, "one two three " * 9)] * 30
    df = docs_of(spark, rows)
    target = docs_of(spark, [(1, "one two three")])
    got = importance.resampled(df, target)
    assert got.columns == df.columns
    want = [r for r in brute_resampled(rows, ["one two three"]) if r[4]]
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in want)
    assert importance.resampled(df.limit(0), target).count() == 0


def test_ngrams_of_three():
    text = b"one two three two one two"
    data, bounds = words.buffer_of(pa.array([text]))
    start, length, first = words.located(data, bounds, words.LETTERS)
    at, bucket = importance.ngram_buckets(data, start, length, np.full(6, 6), 3, 1 << 16)
    w = text.split()
    want = [(i, zlib.crc32(b" ".join(w[i : i + k])) % (1 << 16)) for k in (1, 2, 3) for i in range(7 - k)]
    assert list(zip(at.tolist(), bucket.tolist())) == want


# --- 13 periodic runs ----------------------------------------------------------


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j
    return sorted(((i, m, q) for (i, m), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_report(i, t):
    w = plain_words(t)
    n = len(w)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    runs = brute_runs(w)
    drop = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(x for k, x in enumerate(w) if k not in drop)
    more = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *more, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(1)
    for k in range(1500):
        w = []
        while len(w) < rng.randrange(1, 90):
            part = rng.choices("abc"[: rng.randrange(1, 4)], k=rng.randrange(1, 9))
            w += part * rng.choice([1, 1, 2, 4, 5, 9]) + part[: rng.randrange(0, len(part) + 1)]
        got = periodic.runs_of(np.array([ord(x) for x in w], np.int64))
        assert got == brute_runs(w), w


@pytest.mark.parametrize("stretch", [periodic.STRETCH, 5])
def test_runs_over_several_stretches(monkeypatch, stretch):
    monkeypatch.setattr(periodic, "STRETCH", stretch)
    rng = np.random.default_rng(2)
    for p in (1, 2, 3, 7, 16, 31, 100):
        head, unit = rng.integers(0, 50, 40), rng.integers(0, 1000, p)
        w = np.concatenate([head, np.tile(unit, 6)[: 5 * p + p // 2], head, np.tile(unit[::-1], 4)])
        assert periodic.runs_of(w) == brute_runs(w.tolist())


def test_periodic_runs_of_the_corpus(spark, sf, corpus):
    got = as_set(queries.op13_periodic_runs(spark, sf))
    short = [(i, t) for i, t in corpus if len(plain_words(t)) < 1500]
    by = {r[0]: r for r in got}
    assert len(got) == len(corpus) and len(by) == len(corpus)
    assert all(by[i] == brute_report(i, t) for i, t in short)
    assert sum(r[1] > 0 for r in got) > 5


def test_periodic_edges(spark, edge, empty):
    small = [(i, t) for i, t in EDGE if len(t or "") < 1000] + [(k, "one two " * 5 + "three three three three three three") for k in (20, 21, 21, None)]
    assert as_set(periodic.run_report(docs_of(spark, small))) == sorted((brute_report(i, t) for i, t in small), key=repr)
    long = {r.doc_id: r for r in periodic.periodic_runs(edge).collect()}
    assert [tuple(r) for r in long[6].runs] == [(0, 90_000, 3)] and long[6].collapsed == "a b c"
    assert long[1].runs == [] and long[1].collapsed == ""
    assert periodic.run_report(empty).count() == 0 and periodic.run_report(edge).count() == len(EDGE)


def test_planted_runs_fall_on_a_tenth(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(50))) for k in range(400)]
    n = sum(r.n_runs > 0 for r in periodic.run_report(docs_of(spark, rows)).collect())
    want = sum(brute_report(i, t)[1] > 0 for i, t in itertools.islice(rows, 400))
    assert n == want > 0
