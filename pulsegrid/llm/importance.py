"""Importance resampling of documents towards a target distribution.

Texts are bags of word n-grams hashed to buckets. A bucket's gain says how much
more often the target holds it than the documents do; a document's weight is the
mean gain of its n-grams, and Gumbel noise of a seed and its id turns weights
into scores of which the highest are drawn without replacement.

Long texts are cut into chunks at word boundaries. A chunk owns the n-grams that
start in its first CHUNK words and carries the n - 1 words behind them, so every
n-gram is counted once. A text's first chunk stays where the text is; all others
are dealt to tasks by row and number. Counts and weights of chunks are summed by
document. Buckets, gains and scores are of bounded number, whatever the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_only, keep, ship
from .words import LETTERS, LOWER, buffer_of, located, pieces, ramp

NGRAM, BUCKETS = 2, 10_000
#: Words that a chunk owns.
CHUNK = 4096
#: Percentage of the documents of at least LEAST_WORDS words that is drawn.
SHARE, LEAST_WORDS = 25, 20
SEED = 7
#: Longer words have their checksums taken one by one.
_WIDE = 64


def _linear(images: np.ndarray) -> np.ndarray:
    """Tables (4, 256) of the linear map of 32 bits with the given images of its
    basis."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ images[8 * byte + bit]
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shift, byte, zero): what appending d bytes does to a checksum, as linear
    tables; a byte's share in the checksum of a text that ends d bytes behind it;
    the checksum of d zero bytes."""
    zero = np.array([zlib.crc32(bytes(d)) for d in range(_WIDE + 2)], np.uint32)
    shift = np.stack([_linear(np.array([zlib.crc32(bytes(d), 1 << j) ^ int(zero[d]) for j in range(32)], np.uint32)) for d in range(_WIDE + 2)])
    byte = np.array([[zlib.crc32(bytes([v]) + bytes(d)) ^ int(zero[d + 1]) for v in range(256)] for d in range(_WIDE)], np.uint32)
    return shift, byte, zero


def _appended(crc: np.ndarray, tail: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Checksums of texts with others of d <= _WIDE + 1 bytes behind them."""
    shift = _tables()[0]
    out = tail.copy()
    for k in range(4):
        out ^= shift[d, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def word_checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of every word of lower-case ``data``."""
    _, byte, zero = _tables()
    out = np.empty(len(start), np.uint32)
    for i, j in pieces(length):
        n = length[i:j]
        pos = ramp(n)
        left = np.minimum(np.repeat(n, n) - 1 - pos, _WIDE - 1)
        share = byte[left, data[np.repeat(start[i:j], n) + pos]]
        out[i:j] = np.bitwise_xor.reduceat(share, np.cumsum(n) - n) ^ zero[np.minimum(n, _WIDE)]
    for k in np.flatnonzero(length > _WIDE).tolist():
        out[k] = zlib.crc32(data[start[k] : start[k] + length[k]])
    return out


def ngram_buckets(data: np.ndarray, start: np.ndarray, length: np.ndarray, stop: np.ndarray, n: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all runs of 1 to ``n`` words, joined by one space, by the
    number of their first word; word i's runs end before word ``stop[i]``."""
    own = word_checksums(data, start, length)
    spaced = np.empty(len(own), np.uint32)  # of a space and the word
    short = length <= _WIDE
    spaced[short] = _appended(np.full(int(short.sum()), zlib.crc32(b" "), np.uint32), own[short], length[short])
    wide = {k: b" " + data[start[k] : start[k] + length[k]].tobytes() for k in np.flatnonzero(~short).tolist()}
    at = np.arange(len(own))
    words, found, crc = [at], [own], own
    for d in range(1, n):
        inside = at + d < stop[at]
        at, crc = at[inside], crc[inside]
        tail = at + d
        ok = short[tail]
        more = np.empty(len(at), np.uint32)
        more[ok] = _appended(crc[ok], spaced[tail[ok]], length[tail[ok]] + 1)
        for k in np.flatnonzero(~ok).tolist():
            more[k] = zlib.crc32(wide[int(tail[k])], int(crc[k]))
        crc = more
        words.append(at)
        found.append(crc)
    return np.concatenate(words), (np.concatenate(found) % buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def _by_row(rows: int, row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Counts, and the buckets of each row as bytes."""
    count = np.bincount(row, minlength=rows)
    flat = np.ascontiguousarray(bucket[np.argsort(row, kind="stable")])
    ends = np.concatenate([[0], np.cumsum(count)]) * flat.itemsize
    return count, pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _heads(n: int, buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, hash, text): number of words, first chunk's buckets, the
    words of the other chunks."""
    for b in it:
        data, bounds = buffer_of(b.column(3))
        data = LOWER[data]
        start, length, first = located(data, bounds, LETTERS)
        words = np.diff(first)
        # the first chunk with what it carries; its runs start in what it owns
        size = np.minimum(words, CHUNK + n - 1)
        at = np.repeat(first[:-1], size) + ramp(size)
        row = np.repeat(np.arange(len(words)), size)
        stop = np.cumsum(size)[row]
        word, bucket = ngram_buckets(data, start[at], length[at], stop, n, buckets)
        owned = ramp(size)[word] < CHUNK
        count, held = _by_row(len(words), row[word][owned], bucket[owned])
        rest = [[] for _ in range(len(words))]
        for r in np.flatnonzero(words > CHUNK).tolist():
            for a in range(int(first[r]) + CHUNK, int(first[r + 1]), CHUNK):
                z = min(a + CHUNK + n - 1, int(first[r + 1])) - 1
                rest[r].append(data[start[a] : start[z] + length[z]].tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(b.column(k).cast(pa.int64()) for k in range(3)), pa.array(words), pa.array(count), held, pa.array(rest, pa.list_(pa.binary()))],
            ["row", "doc_id", "hash", "words", "n", "held", "rest"],
        )


def _chunks(n: int, buckets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, chunk): the buckets that the chunk owns."""
    for b in it:
        data, bounds = buffer_of(b.column(1))
        start, length, first = located(data, bounds, LETTERS)
        size = np.diff(first)
        row = np.repeat(np.arange(len(size)), size)
        word, bucket = ngram_buckets(data, start, length, first[1:][row], n, buckets)
        owned = ramp(size)[word] < CHUNK
        count, held = _by_row(len(size), row[word][owned], bucket[owned])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count), held], ["row", "n", "held"])


def _flat(column: pa.Array, buckets: int) -> np.ndarray:
    return buffer_of(column)[0].view(np.uint16 if buckets <= 1 << 16 else np.uint32)


def bags(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Scratch tables (row, doc_id, hash, words, n, held, rest) of documents and
    (row, n, held) of further chunks; row is a number of its own for each row,
    hash that of the text, held the buckets of the chunk's n-grams."""
    ship(docs.sparkSession)
    rows = columns_only(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text"
    )
    schema = "row long, doc_id long, hash long, words long, n long, held binary, rest array<binary>"
    heads = keep(rows.mapInArrow(partial(_heads, n, buckets), schema), "heads")
    rest = heads.filter(F.size("rest") > 0).select("row", F.posexplode("rest").alias("part", "chunk"))
    rest = rest.repartition("row", "part").select("row", "chunk")
    return heads, keep(rest.mapInArrow(partial(_chunks, n, buckets), "row long, n long, held binary"), "chunks")


def bucket_counts(bagged: tuple[DataFrame, DataFrame], buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is held; a task emits one row for a bucket at most."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in it:
            total += np.bincount(_flat(b.column(0), buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    held = bagged[0].select("held").unionByName(bagged[1].select("held"))
    found = held.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    all_s, all_t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weighted(bagged: tuple[DataFrame, DataFrame], gain: np.ndarray) -> DataFrame:
    """(row, doc_id, hash, words, n_features, weight) of every document."""
    buckets = len(gain)

    def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            count = b.column("n").to_numpy()
            total = np.concatenate([[0], np.cumsum(gain[_flat(b.column("held"), buckets)])])
            ends = np.cumsum(count)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(total[ends] - total[ends - count])], ["row", "doc_id", "hash", "words", "n", "gain"])

    heads, rest = bagged
    none = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "hash", "words")]
    held = heads.select("row", "doc_id", "hash", "words", "n", "held").unionByName(rest.select("row", *none, "n", "held"))
    sums = held.mapInArrow(summed, "row long, doc_id long, hash long, words long, n long, gain long")
    # only the first chunk's row names the document
    by = sums.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "hash", "words")], F.sum("n").alias("n_features"), F.sum("gain").alias("gain"))
    floored = F.expr("(gain - pmod(gain, n_features)) div n_features")
    return by.withColumn("weight", F.when(F.col("n_features") > 0, floored).otherwise(F.lit(0).cast("long"))).drop("gain")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight and Gumbel noise of the seed and the doc_id, a null
    one standing as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return weights.withColumn("score", F.col("weight") + noise)


def ranked(scores: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """(row, rank) of the ``share`` percent of documents of at least ``least`` words
    with the highest scores, ties to the smaller doc_id, nulls last, then the
    text's hash. ``scores`` is a scratch table.

    Scores are whole numbers within 2^18 of each other, so their histogram, which
    gives the cut, is bounded; what is above the cut is sorted by ranges and
    numbered from the ranges' sizes."""
    able = scores.filter(F.col("words") >= least)
    held = able.groupBy("score").agg(F.count("*").alias("n")).toArrow()
    score, n = held.column(0).to_numpy(), held.column(1).to_numpy()
    draw = share * int(n.sum()) // 100
    order = np.argsort(-score)
    cut = int(np.searchsorted(np.cumsum(n[order]), draw)) if draw else 0
    above = able.filter(F.col("score") >= int(score[order][cut])) if draw else able.limit(0)
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("hash"), F.asc("row")]
    parts = max(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), draw // 1_000_000)
    ranged = above.select("score", "doc_id", "hash", "row").repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranged = keep(ranged.select("row", F.monotonically_increasing_id().alias("at")), "ranks")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one for each of the parts
    before = np.cumsum([0, *[r.n for r in sizes]]).tolist()
    offsets = scores.sparkSession.createDataFrame([(r.part, b) for r, b in zip(sizes, before)], "part long, before long")
    found = ranged.withColumn("part", part).join(F.broadcast(offsets), "part")
    return found.select("row", (F.col("before") + inside + 1).alias("rank")).filter(F.col("rank") <= draw)


def resample_report(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, text_hash) of every document;
    rank is null where it is not drawn.

    Null and empty texts have no features and weight 0; repeated rows are
    documents of their own and rank one behind the other; a null doc_id ranks
    behind others of its score; an empty table gives an empty result, an empty
    target equal shares; other columns of either table are ignored.
    """
    of_target = target.select(F.lit(0).alias("doc_id"), target["text"])
    bagged = bags(docs)
    gain = gains(bucket_counts(bagged), bucket_counts(bags(of_target)))
    scores = keep(scored(weighted(bagged, gain), seed), "scores")
    found = scores.join(ranked(scores, share, least), "row", "left")
    return found.select("doc_id", "n_features", "weight", "score", "rank", F.col("hash").alias("text_hash"))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``, all columns. Of rows equal in id and text as many
    are returned as were drawn; only the last drawn id and text can be one of
    which some were and some were not."""
    report = keep(resample_report(docs, target, share, least, seed), "report")
    drawn = report.filter("rank is not null")
    key = [docs["doc_id"].cast("long").alias("_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_hash")]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *key)

    def same(a: DataFrame, b: DataFrame):
        return a["_id"].eqNullSafe(b["doc_id"]) & (a["_hash"] == b["text_hash"])

    last = drawn.orderBy(F.desc("rank")).limit(1).select("doc_id", "text_hash")
    held = last.collect()
    if not held:
        return docs.limit(0)
    edge = F.col("_id").eqNullSafe(F.lit(held[0].doc_id)) & (F.col("_hash") == held[0].text_hash)
    n = drawn.filter(F.col("doc_id").eqNullSafe(F.lit(held[0].doc_id)) & (F.col("text_hash") == held[0].text_hash)).count()
    ids = drawn.select("doc_id", "text_hash").distinct()
    whole = rows.filter(~edge).join(ids, same(rows, ids), "left_semi")
    return whole.unionByName(rows.filter(edge).limit(n)).select("_row.*")
