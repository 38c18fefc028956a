"""Main-text extraction by a recurrent block labeller.

A bidirectional LSTM in numpy reads a page's blocks in order, each as hashed
tag-path and word vectors with a few measures, and calls every block main text
or not; its memory of both directions is the context of the whole page. The
weights beside this module were trained by :mod:`.html_training`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_blocks import Block, blocks
from .shared import as_text, columns_only, ship

PATH_DIM = 512
WORD_DIM = 128
MEASURES = 8
EMBED = 40
HIDDEN = 24
#: Pages, and padded blocks, that are labelled together; a longer page alone.
PAGES, CELLS = 128, 1 << 14
#: Blocks that are embedded at a time, code points of pages that are read at a time.
EMBEDDED, CHUNK = 4096, 1 << 23
WEIGHTS = Path(__file__).with_name("html_labeller.npz")
CACHE = 200_000


def _slot(s: str, size: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % size


class Features:
    """Hashed indices of paths and words, remembered up to CACHE of each."""

    def __init__(self):
        self.paths: dict[tuple[str, ...], list[int]] = {}
        self.words: dict[str, int] = {}

    def path(self, p: tuple[str, ...]) -> list[int]:
        got = self.paths.get(p)
        if got is None:
            if len(self.paths) > CACHE:
                self.paths.clear()
            names = set()
            for k, step in enumerate(p):
                tag, *words = step.split(" ")
                near = min(len(p) - k, 3)
                names |= {f"t:{tag}", f"t{near}:{tag}"} | {f"c:{w}" for w in words}
            got = self.paths[p] = sorted({_slot(x, PATH_DIM) for x in names})
        return got

    def word(self, w: str) -> int:
        got = self.words.get(w)
        if got is None:
            if len(self.words) > CACHE:
                self.words.clear()
            got = self.words[w] = PATH_DIM + _slot(w.lower(), WORD_DIM)
        return got

    def page(self, page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index, value, offsets, measures) of a page's blocks: a bag of hashed
        features per block."""
        index: list[int] = []
        value: list[float] = []
        offsets, measures = [], np.zeros((len(page), MEASURES), np.float32)
        for k, b in enumerate(page):
            offsets.append(len(index))
            p = self.path(b.path)
            words = b.text.split(" ")
            distinct = {self.word(w) for w in words}
            index += p
            value += [1.0] * len(p)
            index += sorted(distinct)
            value += [1.0 / len(distinct) ** 0.5] * len(distinct)
            n = len(b.text)
            measures[k] = (
                np.log1p(n) / 5, min(1.0, b.linked / n), len(words) / (len(words) + 20), sum(map(b.text.count, ".,;:!?")) / len(words),
                min(b.inline, 5) / 5, len(b.path) / 10, k / len(page), b.text[-1] in ".!?",
            )
        return np.array(index, np.int64), np.array(value, np.float32), np.array(offsets, np.int64), measures


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Parameters by name: E and M embed bags and measures, then per direction
    an LSTM (W, U, b; gates i, f, o, g), and the output (V, c)."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @staticmethod
    def fresh(seed: int = 1) -> Labeller:
        r = np.random.default_rng(seed)

        def some(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)

        p = {"E": some(PATH_DIM + WORD_DIM, EMBED, scale=0.1), "M": some(MEASURES, EMBED, scale=0.3), "e": np.zeros(EMBED, np.float32)}
        for d in "fb":
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1.0
            p |= {f"W{d}": some(EMBED, 4 * HIDDEN, scale=0.2), f"U{d}": some(HIDDEN, 4 * HIDDEN, scale=0.2), f"b{d}": b}
        return Labeller(p | {"V": some(2 * HIDDEN + EMBED, scale=0.2), "c": np.zeros(1, np.float32)})

    @staticmethod
    def load() -> Labeller:
        with np.load(WEIGHTS) as f:
            return Labeller({k: f[k].astype(np.float32) for k in f.files})

    def save(self) -> None:
        np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def embed(self, page: tuple) -> np.ndarray:
        """tanh embeddings of a page's blocks."""
        index, value, offsets, measures = page
        out = np.empty((len(offsets), EMBED), np.float32)
        ends = np.append(offsets, len(index))
        for a in range(0, len(offsets), EMBEDDED):
            b = min(a + EMBEDDED, len(offsets))
            i, j = ends[a], ends[b]
            bag = np.add.reduceat(self.p["E"][index[i:j]] * value[i:j, None], offsets[a:b] - i, axis=0)
            out[a:b] = np.tanh(bag + measures[a:b] @ self.p["M"] + self.p["e"])
        return out

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Logits of padded (time, page, EMBED) embeddings; padding, where mask
        is 0, leaves the state as it was."""
        t, n, _ = x.shape
        hidden, tape = [], []
        for d in "fb":
            w = (x.reshape(t * n, -1) @ self.p[f"W{d}"] + self.p[f"b{d}"]).reshape(t, n, -1)
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            out = np.zeros((t, n, HIDDEN), np.float32)
            steps = []
            for k in range(t) if d == "f" else range(t - 1, -1, -1):
                z = w[k] + h @ self.p[f"U{d}"]
                gates = _sigmoid(z[:, : 3 * HIDDEN])
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[k][:, None]
                new = f * c + i * g
                tc = np.tanh(new)
                if keep:
                    steps.append((k, h, c, i, f, o, g, tc))
                h, c = m * (o * tc) + (1 - m) * h, m * new + (1 - m) * c
                out[k] = h
            hidden.append(out)
            tape.append(steps)
        top = np.concatenate([*hidden, x], axis=2)
        return top @ self.p["V"] + self.p["c"], [top, tape]

    def label(self, pages: list[tuple]) -> list[np.ndarray]:
        """Probability of main text for every block of every page."""
        sizes = [len(p[2]) for p in pages]
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if sizes[k]), key=lambda k: sizes[k])
        while order:
            few = 1
            while few < min(PAGES, len(order)) and (few + 1) * sizes[order[few]] <= CELLS:
                few += 1
            some, order = order[:few], order[few:]
            x, mask = self.padded([pages[k] for k in some])
            p = _sigmoid(self.run(x, mask)[0])
            for j, k in enumerate(some):
                out[k] = p[: sizes[k], j]
        return out

    def padded(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(p[2]) for p in pages]
        x = np.zeros((max(sizes), len(pages), EMBED), np.float32)
        mask = np.zeros(x.shape[:2], np.float32)
        for j, (n, page) in enumerate(zip(sizes, pages, strict=True)):
            x[:n, j], mask[:n, j] = self.embed(page), 1.0
        return x, mask


def main_texts(pages: list[str], model: Labeller, features: Features) -> list[str]:
    """The main text of each page: its main blocks in page order, joined by one
    space."""
    parsed = [blocks(p) for p in pages]
    p = model.label([features.page(b) for b in parsed])
    return [" ".join(b.text for b, x in zip(bs, xs, strict=True) if x >= 0.5) for bs, xs in zip(parsed, p, strict=True)]


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``. Null and empty
    html, and pages without text, give an empty text; pages of any length are read
    whole, memory growing with the longest alone; repeated rows repeat; nulls in page_id and url are carried; an empty table stays empty; other columns are
    ignored."""
    ship(pages.sparkSession)
    params = Labeller.load().p

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = Labeller(params), Features()
        for b in it:
            source = as_text(b.column(2))
            texts: list[str] = []
            some: list[str] = []
            size = 0
            for page in source:
                some.append(page)
                size += len(page)
                if len(some) == PAGES or size >= CHUNK:
                    texts += main_texts(some, model, features)
                    some, size = [], 0
            texts += main_texts(some, model, features)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return columns_only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
