from __future__ import annotations

import itertools
import re

import corpus_pipeline
from pulsegrid.llm import mixing, near_copies, toxicity
from pulsegrid.llm.shared import keep


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = {"": docs}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = keep(stage(spark, now, sf))
        seen[name] = now
        if name != "sharding":
            assert now.columns == docs.columns
            assert now.exceptAll(docs).select("doc_id").distinct().count() <= now.count()
    a, b = seen[""], seen["toxicity"]
    gone = {r.doc_id for r in a.select("doc_id").subtract(b.select("doc_id")).collect()}
    scored = {r.doc_id: r.is_toxic for r in toxicity.toxicity_report(a, labels).collect()}
    assert gone == {k for k, v in scored.items() if v}
    before, after = ({r.doc_id: shingles(r.text) for r in seen[k].collect()} for k in ("toxicity", "near-dedup"))
    for x, y in itertools.combinations(after.values(), 2):
        assert len(x & y) < near_copies.SIMILARITY * len(x | y)
    for k in set(before) - set(after):
        assert any(len(before[k] & v) >= 0.7 * len(before[k] | v) for v in after.values())
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in seen["decontamination"].collect()}
    for r in seen["near-dedup"].collect():
        t = " ".join(re.findall(r"\w+", r.text.lower()))
        assert (r.doc_id not in left) == any(i in t for i in items)
    want = {r.doc_id: r.taken // r.size for r in mixing.mix_report(seen["decontamination"]).collect() if r.size}
    got = {r.doc_id: r["count"] for r in seen["mixing"].groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert seen["sharding"].count() == seen["mixing"].count() == seen["sharding"].select("shard", "shard_row").distinct().count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


CLASHING = ("_row", "_src", "_key", "_tie", "_size", "_text", "node", "key", "cell", "_node", "_id", "_more", "hash", "root", "copies", "_copy", "lo", "last", "_bad_id", "part", "row", "_p_toxic", "fp")


def folder(spark, sf, tmp_path, rows, *more):
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    names = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` int" for c in more)
    spark.createDataFrame([(*r, *[7] * len(more)) for r in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_nulls_repeats_and_clashing_columns(spark, sf, tmp_path):
    """Null ids, texts and sources, a source without words, rows that repeat, a
    long text and columns of the operators' own names, through all stages."""
    words = [f"w{k % 977}x{k % 31}" for k in range(60_000)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, None, "en", "a", 0), (2, "", "en", "none", 0), (3, "  \n", "en", "none", 0), (None, "some words without an id here today", None, None, 9)]
    rows += [(10, "the same words stand here twice and more", "en", "a", 9)] * 3 + [(11, " ".join(words), "en", "b", 9), (12, " ".join(words[:-5]), "en", "b", 9)]
    rows += [(20 + k, " ".join(words[k * 50 : k * 50 + 40]), "en", "ab"[k % 2], 9) for k in range(60)] + [(90, "before this " + item + " and after", "en", "a", 9)]
    sf_dir = folder(spark, sf, tmp_path, rows, *CLASHING)
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.columns
        now = keep(stage(spark, now, sf_dir))
        ids[name] = [r.doc_id for r in now.select("doc_id").collect()]
        if name != "sharding":
            assert now.columns == before and set(now.select(*CLASHING).distinct().first()) == {7}
    assert len(ids["toxicity"]) == len(rows)
    kept = ids["near-dedup"]
    # one of the rows without words, one of the repeats, one of the two long texts
    assert len(kept) == len(set(kept)) and {10, 11, 90, None} <= set(kept) and 12 not in kept and len({1, 2, 3} & set(kept)) == 1
    assert {20 + k for k in range(60)} <= set(kept)
    assert set(kept) - set(ids["decontamination"]) == {90}
    sizes = {r.source: r for r in mixing.mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").distinct(), "doc_id").collect()}
    assert sizes["none"].target == 0 and len(ids["sharding"]) == len(ids["mixing"])


def test_empty_tables(spark, sf, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, sf, tmp_path, []))
    assert out.count() == 0
