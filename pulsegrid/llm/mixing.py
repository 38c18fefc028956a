"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is ``-ln(u) / w`` (w: its quality weight, u: a hash of its id
and a seed), so ascending keys are a weighted draw without replacement. Each
source takes as many complete epochs as its target holds; what is left is taken
in key order until the prefix sum reaches the budget.

The prefix sum is distributed: bucket totals of the keys are summed per source,
the bucket that holds a source's cut is divided into finer ones, and so on, until
it is small enough to be sorted. Buckets are first even in the logarithm of the
key, so that none holds more than a fixed share of a source whatever the
weights, and then even in the key. The cut is a key, so whether a
row is taken follows from the row and a table with one line per source; texts
are never shuffled for it. Rows that tie in the key are equal in all columns;
where a cut falls inside such a tie, that many of them are taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, join_counted, keep

SEED = 20240601
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Buckets for each unit of ln(key), buckets that one is divided into, and the
#: rows that the last one of a source is meant to hold.
COARSE, FINER, SORTED = 16, 256, 200
_SYMBOLS = "!#$%&*|<>{}[]@\\^~=+_/0123456789"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight in [0.1, 1] that falls with the share of symbols and digits."""
    n = F.length(text)
    odd = (n - F.length(F.translate(text, _SYMBOLS, ""))) / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 3.0 * odd), F.lit(0.1))


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows of ``docs``, whole in _row, with _src (never null), _size, _key and
    _tie; no column of ``docs`` can clash with these."""
    size = words(F.col("text"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    whole = [F.to_json(docs[c]) if "map<" in kind else docs[c] for c, kind in docs.dtypes]
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_src"),
        size.alias("_size"),
        (-F.ln(u) / quality(F.col("text"))).alias("_key"),
        F.xxhash64(F.lit(seed), *whole).alias("_tie"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per-source targets: ``sizes`` has one row per source (_src, source_size).

    Sources in code-point order, null last, weigh 5, 2, 1, repeating; together
    they get the total of all sizes; a target stops at MAX_EPOCHS times its
    source's size and the excess is reshared by weight, i.e. targets are
    ``min(cap, level * weight)`` with the level that uses up the total.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_src") == "", "_src")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS)).cast("int") + 1)
    whole = Window.orderBy("ratio", "_src")
    everything = Window.partitionBy(F.lit(0))
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(MAX_EPOCHS)).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumns(
        {
            "below": F.coalesce(F.sum("cap").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("w").over(whole.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("below")) / F.col("rest")
    t = t.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", "_src", level.alias("level")))).over(everything)["level"])
    return t.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))).select(
        "_src", "source_size", "target"
    )


@dataclass
class Mix:
    """rows: the light table of all documents; sources: one line per source with
    its size, target, epochs and cut."""

    rows: DataFrame
    sources: DataFrame

    def apply(self, keyed_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``keyed_rows`` with source_size, target and copies; and those of ties of
        which only some are taken once more, with source_size, target, epochs and,
        of their ``tied`` number, the ``more`` that are taken."""
        at, edge = F.struct("_key", "_tie"), F.col("last.at")
        inside = F.coalesce((F.col("_key") < F.col("lo")) | (at <= edge), F.col("_key") < F.col("lo"), F.lit(False))
        split = F.coalesce((F.col("last.more") < F.col("last.tied")) & (at == edge), F.lit(False))
        out = join_counted(keyed_rows, self.sources, "_src", "n")
        whole = out.filter(~split).withColumn("copies", (F.col("epochs") + inside.cast("int")).cast("long"))
        return whole, out.filter(split).withColumns({"more": F.col("last.more"), "tied": F.col("last.tied")})


def _cut(rows: DataFrame, aims: DataFrame, bucket: Column) -> DataFrame:
    """``aims`` with lo, hi and before made anew: of the buckets of a source's
    ``rows`` the one that its budget ends in, by its least and greatest key and
    the words ahead of it. Without a budget there is none."""
    order = Window.partitionBy("_src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("_src", bucket.alias("bucket")).agg(F.sum("_size").alias("size"), F.min("_key").alias("first"), F.max("_key").alias("final"))
    held = held.withColumn("ahead", F.coalesce(F.sum("size").over(order), F.lit(0))).join(aims.select("_src", "budget", "before"), "_src")
    ahead = F.col("before") + F.col("ahead")
    ends = held.filter((F.col("budget") > 0) & (ahead < F.col("budget")) & (F.col("budget") <= ahead + F.col("size")))
    ends = ends.groupBy("_src").agg(F.min(F.struct("bucket", F.col("first").alias("lo"), F.col("final").alias("hi"), ahead.alias("before"))).alias("c"))
    return aims.drop("lo", "hi", "before").join(ends.select("_src", "c.lo", "c.hi", F.col("c.before").alias("before")), "_src", "left")


def plan_mix(docs: DataFrame, seed: int = SEED) -> Mix:
    rows = keep(keyed(docs, seed).select(F.col("_row.doc_id").alias("doc_id"), "_src", "_size", "_key", "_tie"), "mix", "lz4_raw")
    per_source = keep(rows.groupBy("_src").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n")), "sources", "lz4_raw")
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    aims = (
        source_targets(per_source.select("_src", "source_size"))
        .withColumn("epochs", F.least(epochs, F.lit(MAX_EPOCHS).cast("long")))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("before", F.lit(0).cast("long"))
    )
    aims = keep(per_source.select("_src", "n").join(aims, "_src"), "aims", "lz4_raw")
    aims = keep(_cut(rows, aims, F.floor(F.ln("_key") * COARSE).cast("long")), "cuts", "lz4_raw")
    # the density of the logarithm of an exponential key is at most 1 / e
    left = (per_source.agg(F.max("n")).first()[0] or 0) / (math.e * COARSE)
    while True:
        near = join_counted(rows, aims, "_src", "n", "inner").filter("_key between lo and hi")
        if left <= SORTED:
            break
        finer = F.least(F.floor(F.coalesce(F.try_divide(F.col("_key") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * FINER), F.lit(FINER - 1))
        aims = keep(_cut(near.select("_src", "_size", "_key", "lo", "hi"), aims, finer.cast("long")), "cuts", "lz4_raw")
        left /= FINER
    # of the bucket that holds the cut, the prefix whose sum is nearest to the budget
    ties = near.groupBy("_src", "_key", "_tie", "_size", "before", "budget").agg(F.count("*").alias("tied"))
    prefix = Window.partitionBy("_src").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum(F.col("_size") * F.col("tied")).over(prefix), F.lit(0))
    fit = F.floor(F.coalesce(F.try_divide(F.col("budget") - F.col("ahead"), F.col("_size")), F.lit(float(1 << 52))) + 0.5).cast("long")
    last = (
        ties.withColumn("ahead", ahead)
        .filter(F.col("ahead") + F.col("_size") / 2 <= F.col("budget"))
        .select("_src", F.struct(F.struct("_key", "_tie").alias("at"), F.least("tied", fit).alias("more"), "tied").alias("last"))
        .groupBy("_src")
        .agg(F.max("last").alias("last"))
    )
    return Mix(rows, keep(aims.join(last, "_src", "left"), "plan", "lz4_raw"))


def _repeated(rows: DataFrame, count: Column, part: int = 1000) -> DataFrame:
    """Each row ``count`` times, numbered by _k from 1, spread in parts."""
    chunks = rows.withColumn("_n", count).filter("_n > 0").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {part}"))))
    last = F.least(F.col("_n"), (F.col("_part") + 1) * part)
    return chunks.repartition("_src", "_part").withColumn("_k", F.explode(F.sequence(F.col("_part") * part + 1, last)))


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    size counts ``[^\\x20\\x09-\\x0D]+`` (null text: 0); taken is copies times
    size, so at most 3 times size, and a source's taken words differ from its
    target by at most half of its longest text. Null is a source of its own; one
    whose texts have no words has target 0. Rows that are equal in all columns
    share one key; where the mix needs only some of them, only some are taken.
    An empty table gives an empty result; other columns are ignored.
    """
    mix = plan_mix(docs)
    whole, split = mix.apply(mix.rows)
    columns = ["doc_id", F.col("_size").alias("size"), "source_size", "target"]
    out = whole.select(*columns, (F.col("copies") * F.col("_size")).alias("taken"))
    if split.isEmpty():
        return out
    one = split.groupBy("_src").agg(*[F.first(c).alias(c) for c in ("doc_id", "_size", "source_size", "target", "epochs", "more", "tied")])
    copies = F.col("epochs") + (F.col("_k") <= F.col("more")).cast("long")
    return out.unionByName(_repeated(one, F.col("tied")).select(*columns, (copies * F.col("_size")).alias("taken")))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with
    the columns of ``docs``, which may have any names. Texts stay where they are
    read. Nulls, empty texts, repeated rows and empty tables are as in
    :func:`mix_report`."""
    mix = plan_mix(docs)
    whole, split = mix.apply(keyed(docs))
    out = whole.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
    if mix.apply(mix.rows)[1].isEmpty():
        return out
    one = split.groupBy("_src").agg(*[F.first(c).alias(c) for c in ("_row", "epochs", "more", "tied")])
    return out.unionByName(_repeated(one, F.col("epochs") * F.col("tied") + F.col("more")).select("_row.*"))
