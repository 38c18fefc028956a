"""Token ids in files of Simple-8b blocks.

Documents are tokenised where they are read, dealt by document id to parts in
ascending order and written as Parquet files whose rows are blocks of whole
documents. A block's ids are Simple-8b words: the top four bits select how many
ids of which width the other sixty hold. Ids of more than sixty bits are
escapes: their word is a placeholder and the value stands in the block's escape
list. Every block has its id and word offsets within its part, so any block can
be decoded by itself and all selectors of a block at once.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import as_text, columns_only, id_parts, part_of, ship

END_ID = 2
#: Ids of a block, unless one document alone has more.
BLOCK_IDS = 1 << 16
#: Pieces that a Python worker remembers.
CACHE = 900_000
#: Code points that are tokenised at a time.
CHUNK = 1 << 21
BLOCK_TYPE = "part int, block int, first_id long, first_word long, n_ids long, doc_ids binary, sizes binary, words binary, escapes binary"

#: Fixed: (ids a word, bits an id) by selector; selector 0 is the escape, and
#: selector 1 a run of zeros.
SELECTORS = ((1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


# --- Simple-8b --------------------------------------------------------------


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned 64-bit values: each word takes as many of the
    values ahead as any selector can."""
    v = values.astype(np.uint64, copy=False)
    n = len(v)
    if not n:
        return v, v
    take = np.ones(n, np.uint8)
    chosen = np.full(n, 15, np.uint8)
    narrow = values if values.dtype == np.uint16 else v
    for s in range(14, 0, -1):
        count, bits = SELECTORS[s]
        if count > n:
            continue
        # where the next ``count`` values that fit are neighbours
        fits = np.flatnonzero(narrow < 1 << bits if bits < 16 or narrow is v else np.ones(n, bool))
        if len(fits) < count:
            continue
        head = fits[: len(fits) - count + 1]
        at = head[fits[count - 1 :] - head == count - 1]
        chosen[at], take[at] = s, count
    if narrow is v:
        large = v >> np.uint64(60) != 0
        chosen[large], take[large] = 0, 1
    step, starts, p = take.tolist(), [], 0
    while p < n:
        starts.append(p)
        p += step[p]
    start = np.array(starts)
    selector = chosen[start]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector).tolist():
        if s < 2:
            continue  # nothing but the selector
        count, bits = SELECTORS[s]
        at = np.nonzero(selector == s)[0]
        for k in range(count):
            words[at] |= v[start[at] + k] << np.uint64(k * bits)
    return words, v[start[selector == 0]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of :func:`encode`."""
    selector = (words >> np.uint64(60)).astype(np.intp)
    counts = np.array([c for c, _ in SELECTORS])[selector]
    end = np.cumsum(counts)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint64)
    start = end - counts
    out[start[selector == 0]] = escapes
    for s in np.unique(selector).tolist():
        count, bits = SELECTORS[s]
        if s < 2:
            continue
        at = np.nonzero(selector == s)[0]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[start[at] + k] = words[at] >> np.uint64(k * bits) & mask
    return out


# --- tokenising -------------------------------------------------------------


class TextEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` of many texts.

    For texts of ASCII and precomposed Latin-1 letters, the tokenizer's own
    normaliser and splitter come down to lower-casing and the pattern below; the
    pieces go to the tokenizer's model once and are remembered. Any other text,
    and any other tokenizer file, goes through the tokenizer as a whole.
    """

    _LETTERS = "a-zß-öø-ÿ"
    _PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t-\r{_LETTERS}0-9]+")
    _OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
    #: Fixed: the splitter that the fast way stands for.
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer.model)
        made = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (made["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and splits == [self._PATTERN, None]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and their number by text."""
        pieces: list[str] = []
        count = np.zeros(len(texts), np.int64)
        whole: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            if not self.fast or "<|" in t or not t.isascii() and self._OTHER.search(t):
                whole[k] = self.tokenizer.encode(t, add_special_tokens=False).ids
            else:
                found = self._PIECE.findall(t.lower())
                count[k] = len(found)
                pieces += found
        ids, size = self.pieces.look_up(pieces)
        end = np.concatenate([[0], np.cumsum(size)])
        last = np.cumsum(count)
        out_size = end[last] - end[last - count]
        if whole:
            cut = np.concatenate([[0], np.cumsum(out_size)])
            runs = [np.array(whole[k], np.uint32) if k in whole else ids[cut[k] : cut[k + 1]] for k in range(len(texts))]
            return np.concatenate(runs), np.array([len(r) for r in runs], np.int64)
        return ids, out_size


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """piece -> its number; the ids of all pieces lie one after another."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_letters()
        self.flat, self.ends = array("I"), array("I", [0])

    def __missing__(self, piece: str) -> int:
        plain = piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))
        self.flat.extend([t.id for t in self.model.tokenize(plain)])
        self.ends.append(len(self.flat))
        n = self[piece] = len(self)
        return n

    def look_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after another, and their number by piece."""
        if len(self) > CACHE:
            self.clear()
            self.flat, self.ends = array("I"), array("I", [0])
        at = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        ends, flat = np.frombuffer(self.ends, np.uint32), np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        start = ends[at].astype(np.int64)
        size = ends[at + 1] - start
        last = np.cumsum(size)
        return flat[np.arange(last[-1] if len(last) else 0) + np.repeat(start - (last - size), size)], size


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


# --- files ------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, parts: int | None = None) -> None:
    """Tokenises every whole text, appends END_ID and writes the files, documents
    in ascending doc_id order (nulls last, repeated ids by their ids' bytes)."""
    spark = docs.sparkSession
    ship(spark)
    docs = columns_only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    first = id_parts(docs, parts)

    def tokenise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer_path)
        for b in it:
            texts = as_text(b.column(1))
            ids: list[bytes] = []
            a, size = 0, np.cumsum([len(t) for t in texts])
            while a < len(texts):
                e = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHUNK)))
                x, n = made.batch(texts[a:e])
                # two bytes an id where that is enough; the last byte says so
                wide = bool(len(x)) and int(x.max()) > 65535
                last = np.cumsum(n) + np.arange(1, len(n) + 1)
                ended = np.full(len(x) + len(n), END_ID, "<u8" if wide else "<u2")
                keep = np.ones(len(ended), bool)
                keep[last - 1] = False
                ended[keep] = x
                data, step = ended.tobytes(), ended.itemsize
                ids += [data[step * f : step * l] + bytes([wide]) for f, l in zip((last - n - 1).tolist(), last.tolist(), strict=True)]
                a = e
            yield pa.RecordBatch.from_arrays([pa.array(part_of(b.column(0), first)), b.column(0), pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, ids_before, words_before = -1, 0, 0, 0
        docs_, runs, size = [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal block, ids_before, words_before, docs_, runs, size
            words, escapes = encode(np.concatenate(runs))
            row = [
                [part], [block], [ids_before], [words_before], [size],
                [np.array([-1 if d is None else d for d in docs_], "<i8").tobytes() + bytes(d is None for d in docs_)],
                [np.array([len(r) for r in runs], "<i8").tobytes()], [words.astype("<u8").tobytes()], [escapes.astype("<u8").tobytes()],
            ]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 4
            block, ids_before, words_before = block + 1, ids_before + size, words_before + len(words)
            docs_, runs, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], [f.split()[0] for f in BLOCK_TYPE.split(", ")])

        for b in it:
            for p, d, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if p != part or size >= BLOCK_IDS:
                    if runs:
                        yield made()
                    if p != part:
                        part, block, ids_before, words_before = p, 0, 0, 0
                run = np.frombuffer(x[:-1], "<u8" if x[-1] else "<u2")
                docs_.append(d)
                runs.append(run)
                size += len(run)
        if runs:
            yield made()

    dealt = docs.mapInArrow(tokenise, "part int, doc_id long, ids binary").repartitionById(len(first) + 1, F.col("part"))
    order = ["part", F.col("doc_id").asc_nulls_last(), "ids"]
    dealt.sortWithinPartitions(*order).mapInArrow(blocks, BLOCK_TYPE).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, or with
    ``digest=False`` (doc_id, start, ids); start counts the ids of all documents
    before it over all parts."""
    ship(spark)
    stored = spark.read.schema(BLOCK_TYPE).parquet(path)
    last = "ids_crc32 long" if digest else "ids array<long>"

    def documents(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                ids = decode(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u8"))
                size = np.frombuffer(r["sizes"], "<i8")
                key = np.frombuffer(r["doc_ids"][: 8 * len(size)], "<i8")
                null = np.frombuffer(r["doc_ids"][8 * len(size) :], np.bool_)
                end = np.cumsum(size)
                each = [ids[a:e] for a, e in zip((end - size).tolist(), end.tolist(), strict=True)]
                made = [zlib.crc32(x.astype("<u4").tobytes()) for x in each] if digest else [x.astype(np.int64) for x in each]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, mask=null),
                        pa.array(np.full(len(size), r["part"], np.int32)),
                        pa.array(end - size + r["first_id"]),
                        pa.array(size),
                        pa.array(made, pa.int64() if digest else pa.list_(pa.int64())),
                    ],
                    ["doc_id", "part", "at", "n_tokens", last.split()[0]],
                )

    # one row per part, whose number is a parameter of the writer
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("part", before.alias("before"))
    rows = stored.mapInArrow(documents, f"doc_id long, part int, at long, n_tokens long, {last}")
    return rows.join(F.broadcast(totals), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", last.split()[0])


def token_report(docs: DataFrame, tokenizer_path: str, path: str) -> DataFrame:
    """Writes the files of ``docs`` at ``path`` and reads them back. Null and
    empty texts have the end id alone; every row is a document of its own,
    repeated ones too; an empty table makes files without blocks."""
    write_token_files(docs, tokenizer_path, path)
    return read_token_files(docs.sparkSession, path)
