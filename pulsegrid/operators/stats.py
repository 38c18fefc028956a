"""Statistics over labelled or scored rows, all in aggregates."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, in one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = frame.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(made).alias("x")).select("x.*")


def percentiles(frame: DataFrame, column: str, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    """Exact, linearly interpolated."""
    return frame.groupBy(*keys).agg(*[F.percentile(column, F.lit(p)).alias(f"p{round(p * 100)}") for p in at])


#: Rows in this many that a quantile's bracket may hold, about, by the accuracy of
#: the sketch that finds it.
BRACKET = 100_000


def quantiles(frame: DataFrame, column: str, at: dict[str, float]) -> DataFrame:
    """One row of exact, linearly interpolated quantiles of a whole column (name ->
    share), without its values in one task: a sketch brackets each rank to within
    a few in BRACKET rows, one pass counts what is below the brackets and the
    values inside by value, and the rank is picked from these counts. Null where
    there are no values."""
    x = F.col(column).cast("double")
    given = frame.select(x.alias("x")).filter("x is not null")
    shares = [min(1.0, max(0.0, p + d / BRACKET)) for p in at.values() for d in (-4, 4)]
    ends = given.agg(F.percentile_approx("x", shares, BRACKET).alias("e"), F.count("*").alias("n"))
    t = given.crossJoin(F.broadcast(ends))  # one row
    out = None
    for k, (name, p) in enumerate(at.items()):
        # few rows, and the ends at 0 and 1, need no bracket
        few = F.col("n") <= BRACKET
        low = F.when(few | F.lit(shares[2 * k] == 0), float("-inf")).otherwise(F.get("e", F.lit(2 * k)))
        high = F.when(few | F.lit(shares[2 * k + 1] == 1), float("inf")).otherwise(F.get("e", F.lit(2 * k + 1)))
        held = t.select("n", F.when(F.col("x") < low, -1).when(F.col("x") > high, 1).otherwise(0).alias("side"), "x")
        counts = held.groupBy("side", F.when(F.col("side") == 0, F.col("x")).alias("x")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
        one = counts.agg(
            F.max("n").alias("n"), F.coalesce(F.sum(F.when(F.col("side") == -1, F.col("c"))), F.lit(0)).alias("below"),
            F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.struct("x", "c")))).alias("inside"),
        ).withColumn("r", F.lit(p) * (F.col("n") - 1))

        def picked(rank: Column) -> Column:
            start = F.struct((rank - F.col("below")).cast("long").alias("left"), F.lit(None).cast("double").alias("v"))

            def step(a: Column, v: Column) -> Column:
                hit = a["v"].isNull() & (a["left"] >= 0) & (a["left"] < v["c"])
                return F.struct((a["left"] - v["c"]).alias("left"), F.when(hit, v["x"]).otherwise(a["v"]).alias("v"))

            found = F.aggregate("inside", start, step)["v"]
            return F.when(F.col("n").isNotNull(), F.coalesce(found, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")))

        low_rank = F.floor("r")
        share = F.col("r") - low_rank
        value = picked(low_rank) * (1 - share) + picked(F.ceil("r")) * share
        one = one.select(value.alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def histogram(frame: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n), bins of equal width from the least to the largest value, which
    falls into the last."""
    edge = F.broadcast(frame.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    k = F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return frame.filter(F.col(column).isNotNull()).crossJoin(edge).groupBy(F.coalesce(k, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # edge is one row


def one_hot(frame: DataFrame, column: str, values: list[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns for the sorted values, without the first; nulls are all 0."""
    kept = sorted(values)[1 if drop_first else 0 :]
    return frame.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in kept])


def standardised(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, 0 where it does not vary."""
    stats = F.broadcast(frame.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]))
    out = frame.crossJoin(stats)  # one row
    scaled = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(f"_s_{c}", F.lit(0.0)), F.lit(0.0)) for c in columns}
    return out.withColumns(scaled).select(*frame.columns)


def class_balance(frame: DataFrame, target: str) -> DataFrame:
    return frame.agg(F.count("*").alias("n"), F.sum(target).alias("positive"), F.avg(target).alias("share"))


def confusion(frame: DataFrame, score: str, target: str, threshold: float) -> DataFrame:
    """One row of counts, precision, recall, F1 of the failing class, accuracy."""
    said, true = F.col(score) >= threshold, F.col(target) == 1
    t = frame.agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn")
    )
    precision, recall = (F.try_divide(F.col("tp"), F.col("tp") + F.col(x)) for x in ("fp", "fn"))
    return t.withColumns({"precision": precision, "recall": recall}).withColumns(
        {
            "f1": F.try_divide(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")),
            "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        }
    )


def roc_auc(frame: DataFrame, score: str, target: str) -> DataFrame:
    """Mann-Whitney form; ties count half. Scores are counted first, so the one
    window runs over distinct scores."""
    t = frame.groupBy(score).agg(F.count_if(F.col(target) == 1).alias("_p"), F.count_if(F.col(target) != 1).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.select("_p", "_n", below.alias("_below"))
    return t.agg(F.try_divide(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2.0)), F.sum("_p") * F.sum("_n")).alias("auc"))


def roc_curve(frame: DataFrame, score: str, target: str) -> DataFrame:
    w = Window.orderBy(F.desc(score))
    t = frame.groupBy(score).agg(F.count_if(F.col(target) == 1).alias("_p"), F.count_if(F.col(target) != 1).alias("_n"))
    every = Window.partitionBy(F.lit(0))
    return t.select(F.col(score).alias("threshold"), F.try_divide(F.sum("_p").over(w), F.sum("_p").over(every)).alias("tpr"), F.try_divide(F.sum("_n").over(w), F.sum("_n").over(every)).alias("fpr"))


def _pairs(c: Column) -> Column:
    return c * (c - 1) / 2.0


def adjusted_rand(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    cells = frame.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("ij"), F.sum("n").alias("total"))
    side = [cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias(name)) for k, name in ((a, "i"), (b, "j"))]
    t = both.crossJoin(side[0]).crossJoin(side[1])  # one row each
    expected = F.col("i") * F.col("j") / F.nullif(_pairs(F.col("total")), F.lit(0.0))
    most = (F.col("i") + F.col("j")) / 2
    return t.select(F.coalesce((F.col("ij") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def mode_by(frame: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, the least of equals."""
    n = frame.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x")).select(key, F.col("x.v").alias("mode"))


def summary_by(frame: DataFrame, key: str, column: str) -> DataFrame:
    return frame.groupBy(key).agg(F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
