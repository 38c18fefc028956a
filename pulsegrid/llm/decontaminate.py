"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a re-parameterised
question has the template of the original; a run of numbers or of names is one
placeholder. A capital at the start of a sentence may or may not mark a name, so
texts with such capitals have a second reading in which these words are names
(but for common openers). Windows of the template are joined by hash; matches of
a document and an item of one reading that lie in order on neighbouring
diagonals add up to the item's coverage. The slot values that the placeholders
hide must substitute consistently: a name stands for one name throughout, and of
numbers and units, which may be equal by chance, AGREEING of the places agree.

A bitmap of the benchmark's windows, of a size fixed by MAX_BITS whatever the
benchmark's, filters the documents' windows where they are read; what passes is
joined by shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_SHARE, as_text, columns_only, keep, ship

WINDOW = 8
#: Words that a window must still have beside its placeholders.
LEAST_WORDS = 4
COVERAGE = 0.5
#: Tokens by which a document may shift against an item from one matched window
#: to the next.
SHIFT = 3
#: Share of an item's numbers and units that must stand for one value each.
AGREEING = 2 / 3
#: Parts that the rows of a very common window are dealt to.
PARTS = 64
MAX_BITS = 1 << 26
CACHE = 400_000

#: Fixed lists of the placeholders' vocabularies.
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm km kg mg lb lbs oz ml mph kmh kph second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams "
    "kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons dollar dollars cent cents euro euros "
    "percent degree degrees".split()
)
#: Fixed: words that open sentences and are no names.
OPENERS = frozenset(
    "a an and another any are as assume at before both but by calculate can compute consider determine did do does during each either "
    "estimate evaluate every everyone explain find for from given had has have he her here his how however i if in is it its later let "
    "many mr mrs ms most my name no not now of on once one only or our she show simplify since so solve some state suppose that the "
    "their then there these they this those to today tomorrow under until was we were what when where which while who whose why will "
    "with would yesterday yet you your".split()
)
_TOKEN = re.compile(r"(?:[.!?\n]\W*)?\w+")
_WORD = re.compile(r"\w+$")
_ROOT = 0x9E3779B97F4A7C15
#: What the hash of a window of a reading, and of one taken by its values, begins
#: with.
_READINGS = (np.uint64(0), np.uint64(0xA0761D6478BD642F))
_BY_VALUE = np.uint64(0xE7037ED1A0B428DB)


def _digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42)


_WORDS, _NUMBERS, _NAMES, _UNITS = range(4)
_PLACEHOLDERS = np.array([_digest(f"<{k}>") for k in ("", "number", "name", "unit")], np.uint64)


class _Tokens(dict):
    """raw token -> its number; its value hash, and its kind in both readings and
    whether it begins a sentence (two bits each, and one), lie in arrays."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.value, self.flags = array("Q"), array("B")

    def __missing__(self, raw: str) -> int:
        begins = raw[0] in ".!?\n"
        word = _WORD.search(raw)[0] if begins else raw
        low = word.lower()
        kind = _WORDS
        if not word.isalpha() and any(map(str.isdigit, word)) or low in NUMBER_WORDS:
            kind = _NUMBERS
        elif low in UNITS:
            kind = _UNITS
        first = second = kind
        if kind == _WORDS and word[0].isupper() and word[1:].islower():
            first, second = kind if begins else _NAMES, kind if begins and low in OPENERS else _NAMES
        self.value.append(_digest(low))
        self.flags.append(first | second << 2 | (begins and raw != "." + word) << 4)
        n = self[raw] = len(self)
        return n

    def look_up(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE:
            self._reset()
        if not raw:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        at = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        return np.frombuffer(self.value, np.uint64)[at], np.frombuffer(self.flags, np.uint8)[at]


Reading = tuple[np.ndarray, np.ndarray, np.ndarray]


def _read(value: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> Reading:
    """Template hashes, value hashes (their two low bits the kind) and kinds.
    Numbers that follow each other in a sentence are one token, and so are names."""
    again = (kind[1:] == kind[:-1]) & ((kind[1:] == _NUMBERS) | (kind[1:] == _NAMES)) & ~begins[1:]
    if again.any():
        start = np.flatnonzero(np.concatenate([[True], ~again]))
        place = np.arange(len(kind)) - np.repeat(start, np.diff(np.append(start, len(kind))))
        with np.errstate(over="ignore"):
            value = np.add.reduceat(value * (2 * place + 1).astype(np.uint64), start)
        kind = kind[start]
    value = value & ~np.uint64(3) | kind.astype(np.uint64)
    template, slots = value.copy(), np.flatnonzero(kind)
    template[slots] = _PLACEHOLDERS[kind[slots]]
    return template, value, kind


def readings(text: str, known: _Tokens) -> list[Reading]:
    """The one or two readings of a whole text."""
    raw = _TOKEN.findall(text)
    if raw and raw[0][0] not in ".!?\n":
        raw[0] = "." + raw[0]  # a text begins like a sentence
    value, flags = known.look_up(raw)
    first, second, begins = flags & np.uint8(3), flags >> np.uint8(2) & np.uint8(3), flags >= 16
    one = _read(value, first, begins)
    return [one] if (first == second).all() else [one, _read(value, second, begins)]


def _rolled(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` hashes: a run of 2j put together from two
    of j."""
    h, width, done, reached = x, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                if done is None:
                    done, reached = h, width
                else:
                    n = len(h) - reached
                    done, reached = done[:n] * np.uint64(pow(_ROOT, width, 1 << 64)) + h[reached:], reached + width
            if 2 * width > size:
                return done[: len(x) - size + 1]
            h = h[:-width] * np.uint64(pow(_ROOT, width, 1 << 64)) + h[width:]
            width *= 2


def windows(reading: Reading, size: int, number: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and hashes of the windows of the reading of that number, first those
    with enough words left, by their template, and the number of these; then the
    others, by their values."""
    t, v, kind = reading
    n = len(t) - size + 1
    if n <= 0 or size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    seed = np.uint64(size) ^ _READINGS[number]
    words = np.concatenate([[0], np.cumsum(kind == _WORDS)])
    enough = words[size:] - words[:-size] >= min(LEAST_WORDS, size)
    h = _rolled(t, size) ^ seed
    if enough.all():
        return np.arange(n), h, n
    few = np.flatnonzero(~enough)
    at = np.flatnonzero(enough)
    return np.concatenate([at, few]), np.concatenate([h[at], _rolled(v, size)[few] ^ seed ^ _BY_VALUE]), len(at)


_WINDOW_TYPE = "hash long, at int, slots array<long>"


def _emit(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)


def _slots(reading: Reading, at: int, size: int) -> list[int]:
    """Values of a window, 0 where it has words."""
    _, v, kind = reading
    return np.where(kind[at : at + size] != _WORDS, v[at : at + size], np.uint64(0)).view(np.int64).tolist()


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, reading, size, n, hash, at, slots): the template windows of every
    item; n is their number in the reading. Items shorter than a window are one
    window; items of which no window has enough words are matched by the values
    of all of them."""
    ship(benchmark.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for b in it:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), as_text(b.column(1)), strict=True):
                for number, reading in enumerate(readings(text, known)):
                    size = min(WINDOW, len(reading[0]))
                    at, h, plain = windows(reading, size, number)
                    at, h = at[: plain or None], h[: plain or None]
                    for a, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        rows.append((item, number, size, len(at), x, a, _slots(reading, a, size)))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield _emit(rows, ["item_id", "reading", "size", "n", "hash", "at", "slots"], kinds)

    items = columns_only(benchmark, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long")).distinct()
    return items.mapInArrow(run, f"item_id long, reading int, size int, n int, {_WINDOW_TYPE}")


def _bitmap(bench: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """Bitmap of window hashes, its number of bits, the window sizes in use."""
    n = bench.count()
    bits = 1 << 22
    while bits < 1024 * n and bits < MAX_BITS:
        bits *= 2
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = (
        bench.groupBy(F.shiftright(bit, 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 31 as int))")).alias("mask"))
        .toArrow()  # at most bits / 32 rows
    )
    out = np.zeros(bits // 32, np.uint32)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    return out, bits, sorted(r[0] for r in bench.select("size").distinct().collect())


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hash, at, slots): windows of whole texts that the
    bitmap lets through."""
    ship(docs.sparkSession)
    bitmap, bits, sizes = _bitmap(bench)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = _Tokens(), shared.value
        for b in it:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), as_text(b.column(1)), strict=True):
                for number, reading in enumerate(readings(text, known)):
                    for size in sizes:
                        at, h, _ = windows(reading, size, number)
                        low = h & np.uint64(bits - 1)
                        hit = np.nonzero(table[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32) & np.uint32(1))[0]
                        if len(hit):
                            key = np.array([_digest(text)], np.uint64).view(np.int64)[0]
                            rows += [(doc, key, x, a, _slots(reading, a, size)) for a, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True)]
            yield _emit(rows, ["doc_id", "text_hash", "hash", "at", "slots"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())])

    return columns_only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, f"doc_id long, text_hash long, {_WINDOW_TYPE}")


def _consistent(places: dict[int, tuple[int, int]]) -> bool:
    """Whether the (item's, document's) values at the item's slots substitute
    consistently."""
    ours: dict[int, Counter[int]] = defaultdict(Counter)
    for theirs, mine in places.values():
        ours[theirs][mine] += 1
    counts = {theirs: c for theirs, c in ours.items() if theirs & 3 != _NAMES}
    if any(len(c) > 1 for theirs, c in ours.items() if theirs & 3 == _NAMES):
        return False
    return sum(max(c.values()) for c in counts.values()) >= AGREEING * sum(map(sum, (c.values() for c in counts.values())))


def chained(rows: list[tuple[int, int, list[int], list[int]]], n: int) -> tuple[float, bool] | None:
    """Of matched windows (place in the item, in the document, their slots): the
    longest chain in the item's order, from one to the next at most SHIFT
    diagonals apart, that covers enough of the item's n windows and substitutes
    its slots consistently, as its coverage and whether all values agree."""
    rows = sorted({(i, a): (i, a, x, y) for i, a, x, y in rows}.values(), key=lambda r: r[:2])
    ends: dict[int, int] = {}  # by diagonal, the row that ends the longest chain
    length: list[int] = []
    before: list[int | None] = []
    for k, (i, a, _, _) in enumerate(rows):
        near = [e for d in range(a - i - SHIFT, a - i + SHIFT + 1) if (e := ends.get(d)) is not None and rows[e][0] < i and rows[e][1] < a]
        best = max(near, key=length.__getitem__, default=None)
        before.append(best)
        length.append(1 if best is None else length[best] + 1)
        ends[a - i] = k
    tried: set[int] = set()
    for end in sorted(range(len(rows)), key=lambda k: -length[k]):
        if length[end] < COVERAGE * n:
            return None
        if end in tried:
            continue
        places: dict[int, tuple[int, int]] = {}
        k: int | None = end
        while k is not None:
            tried.add(k)
            i, _, theirs, mine = rows[k]
            places |= {i + p: (x, y) for p, (x, y) in enumerate(zip(theirs, mine, strict=True)) if x}
            k = before[k]
        if _consistent(places):
            return length[end] / n, all(x == y for x, y in places.values())
    return None


_PAIR = ["doc_id", "text_hash", "item_id", "reading"]


def _judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair (doc_id, text_hash, item_id, reading, n, item_at, at,
    item_slots, slots): the pairs that leak."""
    held: list[tuple] = []
    pair = None
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]

    def judge() -> list[tuple]:
        got = chained([r[5:] for r in held], held[0][4]) if held else None
        return [(*pair[:3], *got)] if got else []

    for b in it:
        out = []
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:4] != pair:
                out += judge()
                held, pair = [], row[:4]
            held.append(row)
        yield _emit(out, [*_PAIR[:3], "coverage", "verbatim"], types)
    yield _emit(judge(), [*_PAIR[:3], "coverage", "verbatim"], types)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, coverage, kind): pairs of a document and a
    benchmark item of which, in one reading, at least COVERAGE of the template
    windows stand in the document in the item's order, at most SHIFT tokens nearer
    or further from one to the next, with consistent slots. kind is 'verbatim'
    where all slot values agree and 're-parameterised' otherwise.

    Null and empty texts match nothing; rows equal in doc_id and text, and items
    equal in id and text, count once; a null doc_id is carried as null; texts of
    any length are read whole; either table may be empty; other columns are
    ignored.
    """
    bench = keep(benchmark_windows(benchmark), "bench")
    found = keep(matches(docs, bench), "windows")
    times = found.groupBy("hash").agg(F.count("*").alias("times"))
    # a window that many documents share is dealt to parts; there are at most HOT_SHARE such
    common = keep(times.filter(F.col("times") > found.count() / HOT_SHARE).select("hash", F.lit(PARTS).alias("parts")), "common", "lz4_raw")
    parts = F.coalesce("parts", F.lit(1))
    dealt = found.join(F.broadcast(common), "hash", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash", "at"), parts).cast("int"))
    theirs = bench.join(F.broadcast(common), "hash", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    theirs = theirs.select("hash", "part", "item_id", "reading", "n", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    met = keep(dealt.drop("parts").join(theirs, ["hash", "part"]).select(*_PAIR, "n", "item_at", "at", "item_slots", "slots"), "met")
    enough = met.groupBy(*_PAIR).agg(F.countDistinct("item_at").alias("hits"), F.max("n").alias("n")).filter(F.col("hits") >= F.col("n") * COVERAGE)
    enough = enough.select(*[F.col(k).alias(f"_{k}") for k in _PAIR])
    some = met.join(enough, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in _PAIR], "left_semi")
    some = some.repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    leaking = some.mapInArrow(_judged, "doc_id long, text_hash long, item_id long, coverage double, verbatim boolean")
    best = leaking.groupBy(*_PAIR[:3]).agg(F.max(F.struct("coverage", "verbatim")).alias("b"))
    return best.select(*_PAIR[:3], "b.coverage", F.when(F.col("b.verbatim"), "verbatim").otherwise("re-parameterised").alias("kind"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns unchanged; nulls,
    empty and repeated rows and empty tables are as in :func:`leaks`, and columns
    may have any names."""
    bad = keep(leaks(docs, benchmark).select("doc_id", "text_hash").distinct(), "leaks")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_text"))
    return docs.join(
        bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_bad_text"]), "left_anti"
    )
