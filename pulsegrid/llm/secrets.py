"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Every text is scanned for candidate spans; the hash of each candidate's value is
aggregated by distinct repositories and owners; values copied across owners are
told apart from those that only one owner holds and that look live.

Positions come from interleaving: the gaps of ``split`` and the matches of
``regexp_extract_all`` alternate, so running sums of their lengths are the
starts and ends in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_counted, keep

#: Fixed patterns of the contract. hex and access are written with the least
#: length inside: a run that is too short as a whole has no part long enough, so
#: the same spans result as from matching first and dropping after.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What the ownership method may add: prefixed vendor tokens, and long opaque
#: tokens that mix letters and digits.
VENDOR = r"(?:gh[pousr]_|xox[abprs]-|sk-|eyJ)[A-Za-z0-9_.-]{16,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"

#: In the order in which spans that start together are listed.
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("vendor", VENDOR), ("opaque", OPAQUE))
BASE = 3
LEAST_VALUE = 12

#: A value in this many owners, or in several owners and this many repositories,
#: is a widely copied example; one that a single owner holds never is.
COPIED_OWNERS = 3
COPIED_REPOS = 10


def _pieces(text: Column, kind: int) -> Column:
    """array of (kind, at, gap length, match) over the whole text."""
    pattern = F.lit(KINDS[kind][1])
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), m.alias("match")
        ),
    )
    return F.when(F.regexp_like(text, pattern), zipped)


def _value(kind: Column, match: Column) -> Column:
    """What of a match is the secret; null where the match is no candidate."""
    named = F.regexp_extract(match, ASSIGN, 2)
    opaque = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.when(kind == 0, F.when(F.length(named) >= LEAST_VALUE, named)).when(kind == 4, F.when(opaque, match)).otherwise(match)


def candidates(docs: DataFrame, repo: Column, owner: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, _id, _text), the distinct texts' candidate spans and the
    repositories and owners that hold them (_id, _text, repo, owner).

    _id and _text stand for a row's doc_id and text: rows that agree in both have
    the same spans and share them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(
        docs.select(
            "doc_id",
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"),
            F.xxhash64(text, F.col("doc_id").isNull()).alias("_text"),
            F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
            F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
            F.flatten(F.array_compact(F.array(*[_pieces(text, k) for k in range(len(KINDS))]))).alias("pieces"),
        ),
        "secrets",
    )
    holding = rows.filter(F.size("pieces") > 0)
    pieces = holding.groupBy("_id", "_text").agg(F.min("pieces").alias("pieces")).select("_id", "_text", F.explode("pieces").alias("p"))
    before = Window.partitionBy("_id", "_text", "p.kind").orderBy("p.at").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        pieces.withColumn("end", F.sum(F.col("p.gap") + F.col("p.size")).over(before))
        .withColumn("value", _value(F.col("p.kind"), F.col("p.match")))
        .filter("value is not null")
        .select(
            "_id", "_text", F.col("p.kind").alias("kind"), (F.col("end") - F.col("p.size")).alias("start"), "end",
            F.xxhash64("value").alias("hash"),
        )
    )
    return rows.select("doc_id", "_id", "_text"), keep(spans, "spans", "lz4_raw"), holding.select("_id", "_text", "repo", "owner").distinct()


def ownership(spans: DataFrame, holders: DataFrame) -> DataFrame:
    """(hash, n, repos, owners, standing): in how many spans, and by whom, each
    candidate value is held. standing is 'copied', 'shared' or 'owned'."""
    held = spans.select("_id", "_text", "hash").distinct().join(holders, ["_id", "_text"]).select("hash", "owner", "repo").distinct()
    return (
        held.groupBy("hash", "owner")
        .agg(F.count("*").alias("repos"))
        .groupBy("hash")
        .agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))
        .join(spans.groupBy("hash").agg(F.count("*").alias("n")), "hash")
        .withColumn(
            "standing",
            F.when((F.col("owners") >= COPIED_OWNERS) | (F.col("owners") > 1) & (F.col("repos") >= COPIED_REPOS), "copied")
            .when(F.col("owners") > 1, "shared")
            .otherwise("owned"),
        )
    )


def secret_spans(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id and found, an array of
    (start, order, kind, end, standing) in order.

    Base spans (assign, access, hex) always stay; vendor spans are added unless
    widely copied, opaque ones only where a single owner holds them, and neither
    where a base span covers the same stretch. Null texts count as empty and have
    no spans; null owners and repositories count as one unnamed; rows equal in
    doc_id and text share their spans, and each of their owners counts; texts are
    scanned whole; an empty table gives an empty result;
    other columns are ignored.
    """
    rows, spans, holders = candidates(docs, repo, owner)
    known = keep(ownership(spans, holders).select("hash", "n", "standing"), "owners", "lz4_raw")
    judged = join_counted(spans, known, "hash", "n")
    name = F.element_at(F.array(*[F.lit(k) for k, _ in KINDS]), F.col("kind") + 1)
    found = judged.groupBy("_id", "_text").agg(
        F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("order"), name.alias("kind"), "end", "standing"))).alias("all")
    )
    base = F.filter("all", lambda s: s["order"] < BASE)
    stays = F.filter(
        "all",
        lambda s: (s["order"] < BASE)
        | (
            F.when(s["order"] == 3, s["standing"] != "copied").otherwise(s["standing"] == "owned")
            & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        ),
    )
    found = found.select("_id", "_text", stays.alias("found"))
    nothing = F.array().cast(found.schema["found"].dataType)
    return rows.join(found, ["_id", "_text"], "left").select("doc_id", F.coalesce("found", nothing).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """Digest of :func:`secret_spans`, one row per row of ``docs``."""
    found = secret_spans(docs, repo, owner)
    base = F.filter("found", lambda s: s["order"] < BASE)

    def n(test) -> Column:
        return F.size(F.filter("found", test)).cast("long")

    def of_kind(k: int) -> Column:
        return n(lambda s: s["order"] == k)

    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        n(lambda s: s["standing"] == "owned").alias("n_owned"),
        n(lambda s: s["standing"] == "copied").alias("n_copied"),
    )
