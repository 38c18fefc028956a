"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken, SIGMOD 2003).

Rolling hashes of all K-grams of code points; of every WINDOW consecutive hashes
the least is kept, of equal ones the rightmost, with its position. Two texts that
share K + WINDOW - 1 code points in a row therefore share a print, and no match
shorter than K is ever reported.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_text, columns_only, id_parts, keep, part_of, ship

K = 16
WINDOW = 32
#: Code points that are hashed at a time.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(32)).astype(np.uint32)


def grams(cp: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams: polynomials over the code points, a window
    of 2j put together from two of j."""
    with np.errstate(over="ignore"):
        h, width, done = cp.astype(np.uint64) + np.uint64(1), 1, None
        offset = 0
        while True:
            if k & width:
                if done is None:
                    done, offset = h, width
                else:
                    n = len(h) - offset
                    done = done[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + h[offset:]
                    offset += width
            width *= 2
            if width > k:
                return _mixed(done)
            j = width // 2
            h = h[:-j] * np.uint64(pow(_BASE, j, 1 << 64)) + h[j:]


def _least(packed: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    m, width = packed, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = w - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def prints(texts: list[str], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, bounds): the prints of text d are those from bounds[d] to
    bounds[d + 1]. A text of fewer than ``window`` k-grams is one window; one
    shorter than k is one gram; an empty one has no print."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    start = end - size
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    found_h, found_p = [], []
    span = k + window - 1
    for d in np.nonzero((size > 0) & (size < span))[0].tolist():
        h = grams(cp[start[d] : end[d]], min(k, int(size[d])))
        at = len(h) - 1 - int(np.argmin(h[::-1]))
        found_h.append(h[at : at + 1])
        found_p.append(np.array([start[d] + at]))
    opens = np.zeros(len(cp) + 1, np.int32)  # windows that may start at a code point
    long = size >= span
    np.add.at(opens, start[long], 1)
    np.add.at(opens, end[long] - span + 1, -1)
    opens = np.cumsum(opens)[:-1].astype(bool) if long.any() else opens[:0].astype(bool)
    for a in range(0, len(opens), CHUNK):
        ok = opens[a : a + CHUNK]
        if not ok.any():
            continue
        h = grams(cp[a : a + CHUNK + span - 1], k)
        if len(h) < window:
            continue
        back = np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64)
        least = _least(h.astype(np.uint64) << np.uint64(32) | back, window)[:CHUNK][ok[: len(h) - window + 1]]
        least = least[np.concatenate([[True], np.diff(least) != 0])]
        found_h.append((least >> np.uint64(32)).astype(np.uint32))
        found_p.append((np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64) + a)
    if not found_p:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    h, p = np.concatenate(found_h), np.concatenate(found_p)
    order = np.argsort(p, kind="stable")
    h, p = h[order], p[order]
    new = np.concatenate([[True], np.diff(p) != 0])
    h, p = h[new], p[new]
    bounds = np.concatenate([np.searchsorted(p, start), [len(p)]])
    return h, p - start[np.searchsorted(end, p, "right")], bounds


def packed(h: np.ndarray, p: np.ndarray) -> str:
    """Base64 of 5 bytes per print: its hash, little-endian, and its distance
    from the print before, which never exceeds the window."""
    out = np.empty(len(h), [("h", "<u4"), ("d", "u1")])
    out["h"], out["d"] = h, np.diff(p, prepend=0)
    return base64.b64encode(out.tobytes()).decode()


def unpacked(text: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(base64.b64decode(text), [("h", "<u4"), ("d", "u1")])
    return x["h"].copy(), np.cumsum(x["d"], dtype=np.int64)


def _sets(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct (text, hash) keys."""
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    return np.unique(text << np.uint64(32) | h)


def likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Jaccard similarity of the distinct hashes of text d in ``a`` and in ``b``
    for d < n; 1 where both have none."""
    high = np.uint64(32)
    count = [np.bincount((x >> high).astype(np.int64), minlength=n)[:n] for x in (a, b, np.intersect1d(a, b, assume_unique=True))]
    union = count[0] + count[1] - count[2]
    return np.where(union > 0, count[2] / np.maximum(union, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many code points of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, n_prints long"
)


def _compared(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
    n = len(texts)
    h, p, b = prints([*texts, following])
    changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], following], strict=True)]
    eh, ep, eb = prints(changed)
    own, other = _sets(h, b), _sets(eh, eb)
    first = np.uint64(1) << np.uint64(32)
    after = own[own >= first] - first
    mine = own[own < np.uint64(n) << np.uint64(32)]

    def strings(h: np.ndarray, p: np.ndarray, b: np.ndarray) -> list[str]:
        cut = b.tolist()
        return [packed(h[cut[d] : cut[d + 1]], p[cut[d] : cut[d + 1]]) for d in range(n)]

    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
        pa.array(strings(h, p, b)),
        pa.array(strings(eh, ep, eb)),
        pa.array(likeness(mine, other, n)),
        pa.array(likeness(mine, after, n)),
        pa.array(np.diff(b)[:n].astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def _with_followers(dealt: DataFrame) -> DataFrame:
    """``dealt`` with after = 0, and for each part the first text of the next one,
    of the first part after the last, with after = 1. The first scan reads ids
    only; the second finds the texts of as many ids as there are parts."""
    least = keep(dealt.groupBy("part").agg(F.min("doc_id").alias("doc_id")), "heads", "lz4_raw")
    order = Window.orderBy("part")  # one row for each part
    before = F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    least = least.select(F.col("part").alias("_part"), F.col("doc_id").alias("_first"), before.alias("_before"))
    met = dealt.join(F.broadcast(least), (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    heads = met.groupBy("_before").agg(F.min("text").alias("text"))
    heads = heads.select(F.col("_before").alias("part"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).alias("after"))
    return dealt.withColumn("after", F.lit(0)).unionByName(heads)


def fingerprint_report(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_prints.

    The next document is the next row in ascending doc_id order, repeated ids by
    text and null ids last; after the last comes the first, so a single row is
    its own next. Null texts count as empty; two empty fingerprints are alike
    (1.0); an empty table gives an empty result; other columns are ignored.

    Texts are dealt once, by id, to parts of ascending order; what a part needs
    of the next one is that part's first text, which is dealt to it as well.
    """
    ship(docs.sparkSession)
    docs = columns_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = id_parts(docs, parts)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(part_of(ids, first))

    dealt = docs.withColumn("part", part("doc_id")).select("part", "doc_id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for b in it:
            for after, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_text(b.column(2)), strict=True):
                if after or size >= CHUNK:
                    yield _compared(ids, texts, t)
                    ids, texts, size = [], [], 0
                if not after:
                    ids.append(d)
                    texts.append(t)
                    size += len(t)

    ordered = _with_followers(dealt).repartitionById(len(first) + 1, F.col("part"))
    ordered = ordered.sortWithinPartitions("part", "after", F.col("doc_id").asc_nulls_last(), "text")
    return ordered.select("after", "doc_id", "text").mapInArrow(run, SCHEMA)
