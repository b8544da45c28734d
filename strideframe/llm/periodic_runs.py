"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of consecutive words with smallest period q that is at least ``min_words`` and ``min_powers`` * q
words long and that no neighbouring word extends with period q. A document is halved again and again; the runs that a
midpoint cuts are found by Z-functions: in one of a run's two parts the first (or last) q words recur at once, so
Z-values from the midpoint give every period that may cross it, and Z-values across it how far each reaches. What is
found is extended to its whole length (what reaches beyond the part that was halved is left to the midpoint that cuts
it); intervals are kept once, with their smallest period.

Most words of most texts can be in no run, as a run repeats each three words of it within its period. Stretches where
the last equal three words are too far back for the stretch's own length are put aside before, and so are halves,
so the Z-functions run over little of ordinary prose. Both are bounds that every run meets: no run is lost.

Defined results: a null, empty or blank text has no words and no runs; texts of any length are read whole by one task
(about 100 bytes a word); repeated rows each get their own result; ids may be null; an empty table gives an empty
result; columns named like the added ones are replaced, other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, split_words, tidy

ADDED = ["n_words", "runs", "collapsed"]
#: Words that a run of three words back is said to be where there is none.
FAR = np.iinfo(np.int64).max // 2


def z_values(s: list[int]) -> list[int]:
    """How many leading items ``s`` and each of its suffixes share."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for k in range(1, n):
        v = min(right - k, z[k - left]) if k < right else 0
        while k + v < n and s[v] == s[k + v]:
            v += 1
        z[k] = v
        if k + v > right:
            left, right = k, k + v
    return z


def _halves(own: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int]]:
    """(p, reach within ``own``, reach into ``other``) of periods p whose first p items of ``own`` recur at once.

    ``own`` leads away from the midpoint, ``other`` from there the other way.
    """
    k = len(own) // 2
    # A period p needs own[p] == own[0] and own[2p-1] == own[p-1].
    if not k or not ((own[1 : k + 1] == own[0]) & (own[1 : 2 * k : 2] == own[:k])).any():
        return []
    z = z_values(own.tolist())
    found = [p for p in range(1, k + 1) if z[p] >= p]
    if not found:
        return []
    # How far items before the midpoint equal those p further on: other[j] against own read backwards from p - 1.
    span, far = other.tolist(), found[-1]
    across = z_values([*span, -1, *own[:far][::-1].tolist(), *span])
    at = len(span) + 1 + far
    return [(p, z[p], across[at - p]) for p in found]


def _across(ids: np.ndarray, left: int, mid: int, right: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the repetitions that ``mid`` cuts, within [left, right)."""
    after, before = ids[mid:right], ids[left:mid][::-1]
    out = [(mid - back, mid + p + reach, p) for p, reach, back in _halves(after, before)]
    return out + [(mid - p - reach, mid + back, p) for p, reach, back in _halves(before, after)]


def _stretches(back: np.ndarray, powers: int) -> list[tuple[int, int]]:
    """Stretches of places where the equal three words before are near enough for a run of the stretch's length."""
    ok = back < FAR
    for _ in range(64):  # each round leaves out places that no run has; it need not be the last that could be
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        size = ends - starts
        near = (size + 2) // (powers - 1)  # the largest period whose run fits, see three_back
        inside = np.repeat(near, size)
        at = np.flatnonzero(ok)
        bad = at[back[at] > inside]
        if not len(bad):
            break
        ok[bad] = False
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def three_back(ids: np.ndarray) -> np.ndarray:
    """How far before each place the same three words last began.

    In a run of n words and period q all n - q - 2 places from its second period on have a value of q at most, and
    n >= powers * q, so a stretch of t such places holds runs of a period of at most (t + 2) / (powers - 1) only.
    """
    out = np.full(len(ids), FAR, np.int64)
    if len(ids) < 4:
        return out
    x = ids.astype(np.uint64)
    key = mix(mix(mix(x[:-2]) * np.uint64(3) + x[1:-1]) * np.uint64(3) + x[2:])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def find_runs(ids: np.ndarray, docs: list[tuple[int, int]], min_words: int = 6, min_powers: int = 4) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every run, sorted. ``docs`` are the bounds of documents in ``ids``, ascending;
    documents have something unique between them."""
    if min_powers < 4 or min_words < 5:
        raise ValueError("runs of under four periods or five words are not found by what recurs at once")
    back = three_back(ids)
    best: dict[tuple[int, int], int] = {}
    lows = np.array([a for a, _ in docs])
    for a, b in _stretches(back, min_powers):
        low, high = docs[int(np.searchsorted(lows, a, "right")) - 1]
        near = (b - a + 2) // (min_powers - 1)
        todo = [(max(low, a - near), min(high, b + 2), FAR)]
        while todo:
            left, right, under = todo.pop()
            if right - left < min_words:
                continue
            # Runs in here have a period below ``under``, and of their own places some are this near.
            if not (back[left:right] <= min((right - left) // min_powers, under - 1)).any():
                continue
            mid = (left + right) // 2
            whole = []
            for s, e, p in _across(ids, left, mid, right):
                beyond = (s == left > low and ids[s - 1] == ids[s - 1 + p]) or (e == right < high and ids[e] == ids[e - p])
                if e - s >= max(min_words, min_powers * p) and not beyond:
                    best[s, e] = min(p, best.get((s, e), FAR))
                if e - s >= 2 * p:
                    whole.append((s, e, p))
            for x, y in ((left, mid), (mid, right)):
                # A part within something of period p, though of fewer powers, holds no run of that period or a larger one.
                todo.append((x, y, min([under, *[p for s, e, p in whole if s <= x and y <= e]])))
    return sorted((s, e, p) for (s, e), p in best.items())


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for s, e, p in runs:
        gone[s + p] += 1
        gone[e] -= 1
    return np.cumsum(gone[:n]) == 0


def mark_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, min_powers: int = 4) -> DataFrame:
    """``docs`` without the text and with n_words, runs (start, length, period by word number; sorted) and collapsed:
    the words that no run repeats, joined by one space."""
    base = docs.drop(*ADDED).withColumnRenamed(text_col, "__text")
    kept = [f for f in base.schema.fields if f.name != "__text"]
    kind = "array<struct<start:long,length:long,period:long>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_words long", f"runs {kind}", "collapsed string"])
    pa_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            for first, texts in pieces(b, "__text"):
                lens, at, words = split_words(texts)
                # Documents lie one after the other with an item of its own after each.
                ends = np.cumsum(lens + 1)
                ids = np.empty(int(ends[-1]), np.int64)
                own = np.ones(len(ids), bool)
                own[ends - 1] = False
                ids[own] = at
                ids[ends - 1] = len(words) + np.arange(len(lens))
                bounds = list(zip((ends - 1 - lens).tolist(), (ends - 1).tolist(), strict=True))
                by_doc: list[list] = [[] for _ in texts]
                for s, e, p in find_runs(ids, bounds, min_words, min_powers):
                    k = int(np.searchsorted(ends, s, "right"))
                    by_doc[k].append((s - bounds[k][0], e - bounds[k][0], p))
                flat, place = at.tolist() if any(by_doc) else [], (np.cumsum(lens) - lens).tolist()
                out = []
                for k, (text, n) in enumerate(zip(texts, lens.tolist(), strict=True)):
                    if by_doc[k]:
                        stay = collapse(n, by_doc[k])
                        out.append(b" ".join([words[flat[place[k] + j]] for j in np.flatnonzero(stay).tolist()]).decode("utf-8", "surrogatepass"))
                    else:
                        out.append(b" ".join(text.split()).decode("utf-8", "surrogatepass"))
                rest = b.slice(first, len(texts))
                runs = [[{"start": s, "length": e - s, "period": p} for s, e, p in found] for found in by_doc]
                yield pa.RecordBatch.from_arrays([rest.column(f.name) for f in kept] + [pa.array(lens, pa.int64()), pa.array(runs, pa_kind), pa.array(out, pa.string())], names=[f.name for f in kept] + ADDED)

    return base.select(*[F.col(f.name) for f in kept], "__text").mapInArrow(tidy(run), schema)
