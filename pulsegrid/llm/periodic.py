"""Runs: stretches of words that repeat with a period.

A run has a smallest period q, at least LEAST words and REPEATS periods, and no
neighbouring word extends it keeping q. Block matching finds them. At scale L, a
power of two, the words of a text are cut into aligned blocks of L; a run of a
period p with L <= p < 2L holds, in its first 2L - 1 words, a whole aligned
block, and the same words again p later. So the blocks, as sequences of the
numbers of their words or of their quarters, are the keys of an Aho-Corasick
automaton, which is run across the text; an occurrence at a distance of L to 2L - 1 behind its block seeds an extension to
both sides, word by word, and what is long enough is a run. Larger scales skip
seeds that lie in a run whose period divides their distance: they would find it
again.

Only blocks that can belong to a run are keys: all words of a run but those of
its last period occur again within p words, so a block and the block behind it
must hold no word whose next occurrence is 2L or more away.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, columns_only, ship
from .words import buffer_of, located, word_hashes

LEAST, REPEATS = 6, 4
#: Integers of a key at most: larger blocks are keys of the names of their parts.
KEY = 4
#: Words that the automaton is run over at a time, or four blocks if that is more.
STRETCH = 1 << 16
_FAR = np.int64(1) << 62
Run = tuple[int, int, int]


def next_distances(words: np.ndarray) -> np.ndarray:
    """How far each word's next occurrence is; very far where there is none."""
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    out = np.full(len(words), _FAR)
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def live_blocks(near: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the aligned blocks that a run of a period of size to 2 size - 1
    may hold in front."""
    blocks = len(near) // size
    held = near[: blocks * size].reshape(blocks, size).max(axis=1) < 2 * size
    return np.flatnonzero(held[:-1] & held[1:]) if blocks > 1 else np.zeros(0, np.int64)


def paired(names: np.ndarray, size: int) -> np.ndarray:
    """Names, from 1, of the stretches of 2 size words that start at each word,
    from those of ``size`` words: equal names, equal words."""
    both = names[:-size] * (int(names.max(initial=0)) + 1) + names[size:]
    order = np.argsort(both, kind="stable")
    new = np.ones(len(both), np.int64)
    new[order] = np.cumsum(np.concatenate([[1], both[order[1:]] != both[order[:-1]]])) if len(both) else 0
    return new


def seeds(names: np.ndarray, unit: int, live: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance) of occurrences of live blocks at distances of size
    to 2 size - 1, in order of the occurrence. ``names`` are those of the
    stretches of ``unit`` words; a key is the names of a block's units, so the
    text is run over in its ``unit`` phases."""
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    key = np.full((len(names) + unit) // size + 1, -1)
    known: dict[tuple[int, ...], int] = {}
    for b in live.tolist():
        block = tuple(names[b * size : (b + 1) * size : unit].tolist())
        if block not in known:
            known[block] = len(known)
            auto.add_word(block, known[block])
        key[b] = known[block]
    auto.make_automaton()
    begin, end = int(live[0]) * size, min(len(names) + unit - size, (int(live[-1]) + 3) * size)
    step = max(STRETCH, 4 * size)
    for a in range(begin, end, step):
        part = names[a : min(end, a + step) + size - unit]
        wide = -(-len(part) // unit)
        phases = np.zeros((unit, wide + 1), np.int64)  # 0 stands between phases
        phases[:, :wide] = np.concatenate([part, np.zeros(wide * unit - len(part), np.int64)]).reshape(wide, unit).T
        hits = list(auto.iter(tuple(phases.ravel().tolist())))
        if hits:
            last, which = np.array(hits, np.int64).T
            at = a + last % (wide + 1) * unit + last // (wide + 1) + unit - size
            order = np.argsort(at)
            at, which = at[order], which[order]
            block = (at - size) // size
            ok = (at >= size) & (key[block] == which)
            yield block[ok] * size, (at - block * size)[ok]


def _extended(words: np.ndarray, a: int, p: int) -> tuple[int, int]:
    """The longest stretch around words a and a + p that has period p."""
    n, begin, end, step = len(words), a, a, 64
    while begin:
        k = max(0, begin - step)
        off = np.flatnonzero(words[k:begin] != words[k + p : begin + p])
        if len(off):
            begin = k + int(off[-1]) + 1
            break
        begin, step = k, step * 2
    step = 64
    while end + p < n:
        k = min(n - p, end + step)
        off = np.flatnonzero(words[end:k] != words[end + p : k + p])
        if len(off):
            end += int(off[0])
            break
        end, step = k, step * 2
    return begin, end + p


def runs_of(words: np.ndarray, near: np.ndarray | None = None) -> list[Run]:
    """(start, length, period) of every run of a sequence of integers, by start,
    then period."""
    n = len(words)
    if n < LEAST:
        return []
    near = next_distances(words) if near is None else near
    found: list[Run] = []
    names, unit, size = words + 1, 1, 1
    while REPEATS * size <= n:
        live = live_blocks(near, size)
        for start, length, _ in found:  # what a block far from a run's end seeds is in the run
            live = live[(live * size < start) | ((live + 3) * size > start + length)]
        while len(live) and KEY * unit < size:
            names, unit = paired(names, unit), 2 * unit
        new: list[Run] = []
        last: dict[int, tuple[int, int]] = {}
        for at, p in seeds(names, unit, live, size) if len(live) else ():
            held = np.zeros(len(at), bool)
            for start, length, q in found:
                lo, hi = np.searchsorted(at, (start, start + length))
                held[lo:hi] |= (at[lo:hi] + p[lo:hi] + size <= start + length) & (p[lo:hi] % q == 0)
            for a, d in zip(at[~held].tolist(), p[~held].tolist()):
                before = last.get(d, (0, 0))
                if before[0] <= a and a + d + size <= before[1]:
                    continue
                last[d] = begin, end = _extended(words, a, d)
                if end - begin >= max(LEAST, REPEATS * d):
                    new.append((begin, end - begin, d))
        found += new
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay when of every run only the first period does."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _of_batch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ["start", "length", "period"]
    for b in it:
        data, bounds = buffer_of(b.column(1))
        start, length, first = located(data, bounds)
        hashed = word_hashes(data, start, length)
        sizes, flat, out = [], [], []
        for text, a, z in zip(as_bytes(b.column(1)), first[:-1].tolist(), first[1:].tolist()):
            near = next_distances(hashed[a:z])
            words, found = text.split(), []
            # hashes only tell which texts may hold a run; words decide
            if len(words) >= LEAST and any(len(live_blocks(near, 1 << k)) for k in range((len(words) // REPEATS).bit_length())):
                number: dict[bytes, int] = {}
                found = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
            if found:
                stay = kept_words(len(words), found)
                words = [w for w, k in zip(words, stay.tolist()) if k]
            sizes.append(len(found))
            flat += found
            out.append(b" ".join(words).decode())
        spans = np.array(flat, np.int64).reshape(-1, 3)
        runs = pa.StructArray.from_arrays([pa.array(spans[:, k]) for k in range(3)], fields)
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), runs)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), listed, pa.array(out, pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of ``docs``: the runs by start, then
    period, counted in words, and the text's words joined by one space without
    what any run holds after its first period.

    Each row is handled by itself, whole; nothing is shuffled. Null and empty
    texts have no runs and collapse to the empty string; repeated rows give
    repeated rows; a null doc_id stays null; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    return columns_only(docs, "doc_id", "text").mapInArrow(_of_batch, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every document whose id's crc32 ends in 0, the words from
    some place on are replaced by a repetition of the first of them. A document
    of null id or without words stays as it is."""
    h = F.crc32(docs["doc_id"].cast("string"))
    words = F.filter(F.split(docs["text"], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`periodic_runs` over :func:`with_planted_runs`: doc_id,
    n_runs; start, length, period and exponent_milli of the run with the greatest
    exponent (null without runs); runs_sha256, collapsed_sha256."""
    found = periodic_runs(with_planted_runs(docs))
    # exponents are compared as fractions; runs come by start, then period
    best = F.expr("reduce(slice(runs, 2, size(runs)), runs[0], (m, r) -> if(r.length * m.period > m.length * r.period, r, m))")
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
