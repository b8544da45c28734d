"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark text of m characters that occurs in a document with at most k edits shares at least
``m + 1 - q * (k + 1)`` q-grams with that region, and all lie on diagonals no more than k apart. The
filter looks up every q-gram of a document in an index of the benchmark, counts the shared ones in overlapping
bands of 2(k+1) diagonals (any k+1 neighbouring diagonals lie within one), keeps the bands that reach the
bound, and verifies each by an alignment of the benchmark text within the band. k is a tenth of the text.

Texts are compared lower-cased with runs of blanks as one space. What is looked for is a stretch of as many characters of a
benchmark text as a window has, or the whole of one that is no longer: windows start at every eighth of a window and one ends
with the text, so a passage of nine eighths of a window is found wherever it lies, and what must occur of a text grows with its
length up to a window without a jump. Without a window, texts of all lengths are looked for whole. In texts of fewer than 40 characters or so, k is less than a tenth,
so that the bound stays above zero; those of fewer than q characters are looked for as they are, as whole words. The benchmark is
a stated query set: it is taken in blocks of about ``BLOCK_CHARS`` indexed characters, each broadcast, against all documents.
A worker builds the index of a block once.

Defined results: null or empty texts, of documents or of the benchmark, match nothing; repeated rows and ids are judged each; an
empty benchmark keeps all, an empty table gives none; other columns pass (``drop_leaked``) or are not looked at
(``find_leaks``). Long texts are taken whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, tidy

Q = 8
WINDOW = 512
BLOCK_CHARS = 2_000_000
_BITS = 22
_CHARS = 1 << 18  # characters of documents looked at together
_HITS = 1 << 20  # shared q-grams counted together
_CELLS = 1 << 21  # characters aligned together


def normal(text: str | None) -> str:
    return " ".join((text or "").replace("\0", " ").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each position."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < Q:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + (h[step:] ^ (h[step:] >> np.uint64(29)))
        step *= 2
    return mix(h)


class Index:
    """The q-grams of a block of benchmark texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, window: int | None = None):
        self.ids: list[int] = []
        self.short: dict[str, list[int]] = {}
        codes = []
        for item, text in items:
            text = normal(text)
            if 0 < len(text) < Q:
                self.short.setdefault(text, []).append(item)
            elif text:
                size = min(window or len(text), len(text))
                for at in sorted({*range(0, len(text) - size, max(size // 8, 1)), len(text) - size}):
                    self.ids.append(item)
                    codes.append(_codes(text[at : at + size]))
        self.words = sorted({t.count(" ") + 1 for t in self.short})
        self.m = np.array([len(c) for c in codes], np.int64)
        self.k = np.minimum((rate * self.m).astype(np.int64), (self.m - Q) // Q)
        self.need = self.m + 1 - Q * (self.k + 1)
        self.codes = codes
        sizes = self.m - Q + 1
        flat = np.concatenate([_grams(c) for c in codes]) if codes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable").astype(np.int32)
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.gram, self.first, self.count = flat[starts], starts.astype(np.int32), np.diff(starts, append=len(flat)).astype(np.int32)
        del flat
        self.item = np.repeat(np.arange(len(codes), dtype=np.int32), sizes)[order]
        self.pos = (order - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)[order]).astype(np.int32)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.kmax = int(self.k.max()) if codes else 0
        self.mmax = int(self.m.max()) if codes else 0

    def _short(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """As ``find``, of the benchmark texts that are too short for a q-gram."""
        out = []
        for o, text in enumerate(texts if self.short else ()):
            words = text.split(" ")
            held = {" ".join(words[k : k + n]) for n in self.words for k in range(len(words) - n + 1)}
            out += [(o, i, 0) for t in held & self.short.keys() for i in sorted(set(self.short[t]))]
        return out

    def find(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, benchmark id, edits) of each normalised text and benchmark text within the budget."""
        short = self._short(texts)
        if not self.codes:
            return short
        pad = np.zeros(self.mmax + 4 * self.kmax + 8, np.uint32)
        gap = np.zeros(self.kmax + Q, np.uint32)  # no alignment within the budget crosses it
        parts, starts, at = [pad], [], len(pad)
        for t in texts:
            c = _codes(t)
            parts += [c, gap]
            starts.append(at)
            at += len(c) + len(gap)
        doc = np.concatenate([*parts, pad])
        h = _grams(doc)
        where = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        g = np.searchsorted(self.gram, h[where])
        g[g == len(self.gram)] = 0
        same = self.gram[g] == h[where]
        where, g = where[same], g[same]
        if not len(where):
            return short
        top = len(doc) + 2
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, lo = np.cumsum(self.count[g], dtype=np.int64), 0
        while lo < len(where):
            hi = max(lo + 1, int(np.searchsorted(n, (n[lo - 1] if lo else 0) + _HITS, "right")))
            size = self.count[g[lo:hi]].astype(np.int64)
            hit = np.repeat(self.first[g[lo:hi]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            place, item = np.repeat(where[lo:hi], size), self.item[hit].astype(np.int64)
            band = (place - self.pos[hit]) // (self.k[item] + 1)
            key = ((np.searchsorted(starts, place, "right") - 1) * len(self.codes) + item) * top + band + 1
            keys, at = np.unique(np.concatenate([keys, key, key - 1]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(2 * len(key), np.int64)]), len(keys)).astype(np.int64)
            lo = hi
        item = keys // top % len(self.codes)
        good = counts >= self.need[item]
        keys, item = keys[good], item[good]
        found: dict[tuple[int, int], int] = {}
        order = np.argsort(self.m[item], kind="stable")  # texts of like length are aligned together
        keys, item = keys[order], item[order]
        lo = 0
        while lo < len(keys):
            room = self.m[item[lo:]] + 4 * self.k[item[lo:]] + 3
            hi = lo + max(1, int(np.searchsorted(room[:512] * np.arange(1, len(room[:512]) + 1), _CELLS, "right")))
            part, own = keys[lo:hi], item[lo:hi]
            lo = hi
            edits = self._align(doc, own, (part % top - 1) * (self.k[own] + 1) - self.k[own])
            for o, i, e in zip(part // top // len(self.codes), own, edits, strict=True):
                if e <= self.k[i]:
                    pair = int(o), self.ids[i]
                    found[pair] = min(found.get(pair, 1 << 30), int(e))
        return short + [(o, i, e) for (o, i), e in found.items()]

    def _align(self, doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Fewest edits that turn each item into a stretch of ``doc``, on the diagonals from ``start``."""
        m = self.m[item]
        rows, band = int(m.max()), 4 * int(self.k[item].max()) + 3
        text = doc[np.clip(start[:, None] + np.arange(rows + band), 0, len(doc) - 1)]
        want = np.zeros((len(item), rows), np.uint32)
        for c, i in enumerate(item):
            want[c, : self.m[i]] = self.codes[i]
        d = np.zeros((len(item), band), np.int32)
        ramp = np.arange(band, dtype=np.int32)
        for r in range(rows):
            best = d + (text[:, r : r + band] != want[:, r, None])
            np.minimum(best[:, :-1], d[:, 1:] + 1, out=best[:, :-1])
            best = (np.minimum.accumulate(best - ramp, axis=1) + ramp).astype(np.int32)
            d = np.where((r < m)[:, None], best, d)
        return d.min(axis=1)


def _runs(texts: list[str]):
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > _CHARS:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t)
    if texts[first:]:
        yield first, texts[first:]


def _blocks(docs: DataFrame, benchmark: DataFrame, rate: float, window: int | None):
    """For each block of the benchmark a function that gives its index within a task."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    chars = F.char_length("text")
    size = items.agg(F.sum(chars if window is None else F.when(chars > window, 8 * chars).otherwise(chars))).first()[0] or 0
    n = size // BLOCK_CHARS + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            shared, name = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in rows]), uuid.uuid4().hex
            yield lambda shared=shared, name=name: _index(name, shared, rate, window)


#: The index that the worker used last, by the name of its block.
_LAST: dict[str, Index] = {}


def _index(name: str, shared, rate: float, window: int | None) -> Index:
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Index(shared.value, rate, window)
    return _LAST[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, window: int | None = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits) of every document row that holds a benchmark text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = None
    for index_of in _blocks(docs, benchmark, rate, window):

        def run(batches, index_of=index_of):
            index = index_of()
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    texts = [normal(t) for t in part.column("text").to_pylist()]
                    for first, some in _runs(texts):
                        hits = index.find(some)
                        rows = pa.array([first + o for o, _, _ in hits], pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), pa.array([i for _, i, _ in hits], pa.int64()), pa.array([e for _, _, e in hits], pa.int32())], ["doc_id", "item_id", "edits"])

        found = base.mapInArrow(tidy(run), f"doc_id {kind}, item_id long, edits int")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, edits int")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, window: int | None = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark text."""
    for index_of in _blocks(docs, benchmark, rate, window):

        def run(batches, index_of=index_of):
            index = index_of()
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    keep = np.ones(part.num_rows, bool)
                    for first, some in _runs([normal(t) for t in part.column(text_col).to_pylist()]):
                        keep[[first + o for o, _, _ in index.find(some)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
