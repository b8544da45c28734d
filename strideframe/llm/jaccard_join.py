"""Exact Jaccard join of word shingles by T-occurrence search.

Two texts link when their sets of ``WIDTH``-word shingles overlap by at least ``PERCENT`` per cent of their union.
Texts of one set are one class; only classes are joined. A set of n that links with any set overlaps it by T = ceil(PERCENT n / 100)
at least, and in any fixed order of shingles the first j they share lie within the first n - T + j of it.

*Sieve.* Of each set the first ``EARLY`` per cent by hash are shuffled, packed by part of the hash range, and each class learns how many of them
another class has too. Fewer than the shares above, and it links with nothing. What is left (near copies, mostly) is read again and its whole
sets are counted likewise: a class of fewer than T shared shingles is out, and shingles of one class alone can be left out of
every overlap. A shingle that two classes of one task hold goes out once, marked as shared, so no shingle has more rows than there are tasks.

*Groups.* Shingles are ordered by (classes that have it, hash); those in very many classes come last. Classes that share one of their first n - T + 1
meet in a list. A list's classes are tied to one of them, its pivot, and the connected groups of these ties hold every pair that can link.

*Search.* The sets of a group, in blocks of at most about ``UNIT`` shingles, are inverted lists, and the classes ask them in turn by DivideSkip:
the longest lists are set aside, the short ones are heap-merged for the rest of the T occurrences, the long ones are probed by
binary search, and the full count decides the link exactly. Classes already in one component with the first that asked need not ask: whoever is
outside does. In a group of one block all this is one task; where there are more, the pivots ask every block, and then each class outside the
group's largest component does.

Defined results: A-Z are lower-cased; null, empty and blank texts have empty sets and link with nothing; a text of fewer words than a
shingle is one shingle; rows of one id are one node, repeated rows change nothing; a null id has no place in a component (its id is null if
it stands alone); an empty table gives an empty result; other columns are not looked at. Long texts are taken whole.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, n_shuffle, pieces, shared_dir, shingle_hashes, signed, staged, tidy, whole_groups

WIDTH, PERCENT = 5, 75
EARLY = 40  # per cent of a set that the sieve looks at
UNIT = 2_000_000  # shingles of a block of a group
PARTS = 4  # parts of the hash range for each shuffle partition
LOCAL, COMMON = 8, 1024  # classes of one task, and of all, that make a shingle common
MAX_COMMON = 1_000_000  # common shingles that are broadcast, at most
MAX_BROADCAST = 1_000_000  # rows of (class, document) that are broadcast, at most; beyond, texts are joined by shuffle
_HOLD = 3_000_000  # shingles a task keeps before it emits them


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after the other, and their numbers."""
    h, counts = shingle_hashes([t.lower() for t in texts], WIDTH)
    ends = np.cumsum(counts)
    for lo, hi in zip(ends - counts, ends, strict=True):
        h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(ends - counts)[counts > 0]] = True
    return h[new], np.diff(np.concatenate([[0], np.cumsum(new)])[ends], prepend=0)


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``x``, modulo 2^64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def needed(n):
    """The least overlap of a set of n with any set it links with."""
    return -(-PERCENT * n // 100)


def _classes(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the sets that don't depend on order; the first is never 0."""
    c = _sums(mix(s), counts).view(np.int64)
    return np.where(c == 0, 1, c), _sums(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), counts).view(np.int64)


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` in which absent columns are null."""
    size = len(next(iter(columns.values())))
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.nulls(size, kinds[k]) if f not in columns else pa.array(columns[f], kinds[k]) for f, k in fields], [f for f, _ in fields])


# ---- sieve --------------------------------------------------------------------------------------


def _packed(token: np.ndarray, c: np.ndarray, parts: int) -> dict[str, list]:
    """Postings as one row for each part of the hash range."""
    part = (token % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.diff(part[order], prepend=-1))
    token, c = token[order], c[order]
    ends = [*at[1:], len(part)]
    return {"part": part[order][at].astype(np.int32), "tokens": [token[a:b].tobytes() for a, b in zip(at, ends, strict=True)], "classes": [c[a:b].tobytes() for a, b in zip(at, ends, strict=True)]}


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct postings of packed rows, sorted by shingle."""
    tokens, classes = (batch.column(f).drop_null() for f in ("tokens", "classes"))
    token = np.frombuffer(b"".join(tokens.to_pylist()), np.uint64)
    c = np.frombuffer(b"".join(classes.to_pylist()), np.int64)
    order = np.lexsort((c, token))
    token, c = token[order], c[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
    return token[new], c[new]


def _run_sizes(x: np.ndarray) -> np.ndarray:
    """For each element of sorted ``x`` how often it occurs."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(x)))
    return np.repeat(n, n)


#: kind 0: a row of the table; 1: packed postings, or how many (n) of a class's shingles another class has; 2: those seen within a task.
FIRST = "kind int, part int, doc_id long, n long, c1 long, c2 long, tokens binary, classes binary"
SEEN = "kind int, doc_id long, n long, c1 long, c2 long"


def _early(docs: DataFrame, parts: int) -> DataFrame:
    """Every row's class, and the packed first shingles of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens, classes, held = set(), [], [], 0

        def emit():
            token, c = np.concatenate(tokens), np.concatenate(classes)
            order = np.argsort(token, kind="stable")
            token, c = token[order], c[order]
            several = _run_sizes(token) > 1
            own, n = np.unique(c[several], return_counts=True)
            yield _batch(FIRST, kind=np.full(len(own), 2), part=(own % parts).astype(np.int32), c1=own, n=n)
            marks = np.unique(token[several])
            rows = _packed(np.concatenate([token[~several], marks]), np.concatenate([c[~several], np.zeros(len(marks), np.int64)]), parts)
            yield _batch(FIRST, kind=np.ones(len(rows["part"]), np.int32), **rows)

        for b in batches:
            for first, texts in pieces(b, "text"):
                s, counts = shingle_sets(texts)
                c1, c2 = _classes(s, counts)
                yield _batch(FIRST, kind=np.zeros(len(c1), np.int32), part=(c1 % parts).astype(np.int32), doc_id=b.column("doc_id").slice(first, len(texts)), n=counts, c1=c1, c2=c2)
                p = np.maximum(counts - needed(counts) + 1, -(-EARLY * counts // 100)) * (counts > 0)
                for k, c in enumerate(c1.tolist()):
                    if c in seen:
                        p[k] = 0
                    seen.add(c)
                at = np.repeat(np.cumsum(counts) - counts - (np.cumsum(p) - p), p) + np.arange(int(p.sum()))
                tokens.append(s[at])
                classes.append(np.repeat(c1, p))
                held += len(at)
                if held > _HOLD:
                    yield from emit()
                    tokens, classes, held = [], [], 0
        if held:
            yield from emit()

    return docs.mapInArrow(tidy(run), FIRST)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the table and what tasks saw pass; packed postings become how many of a class's shingles are shared."""
    for b in whole_groups(batches, ["part"]):
        kind = b.column("kind").to_numpy()
        yield b.filter(pa.array(kind != 1)).select([f.split(" ")[0] for f in SEEN.split(", ")])
        token, c = _unpacked(b.filter(pa.array(kind == 1)))
        marked = np.zeros(len(token), bool)
        at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        if len(at):
            marked = np.repeat(np.logical_or.reduceat(c == 0, at), np.diff(np.append(at, len(token))))
        own, n = np.unique(c[(marked | (_run_sizes(token) > 1)) & (c != 0)], return_counts=True)
        yield _batch(SEEN, kind=np.ones(len(own), np.int32), c1=own, n=n)


# ---- whole sets of what is left ------------------------------------------------------------------


def _whole_sets(docs: DataFrame, left: DataFrame) -> DataFrame:
    """(c, tokens) of the classes ``left`` (c, doc_id), from the texts."""

    def run(batches):
        for b in batches:
            for first, texts in pieces(b, "text"):
                s, counts = shingle_sets(texts)
                c = b.column("c").slice(first, len(texts)).to_numpy()
                ends = np.cumsum(counts)
                mine = np.flatnonzero(_classes(s, counts)[0] == c)  # another text of the same id is not the class
                yield pa.RecordBatch.from_arrays([pa.array(c[mine]), pa.array([s[ends[k] - counts[k] : ends[k]].tobytes() for k in mine], pa.binary())], ["c", "tokens"])

    asked = F.broadcast(left) if left.count() <= MAX_BROADCAST else left
    return docs.join(asked, "doc_id").select("c", "text").mapInArrow(tidy(run), "c long, tokens binary")


def common_shingles(sets: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles known to be in very many sets, at most MAX_COMMON."""

    def run(batches):
        for b in batches:
            k, n = np.unique(np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(k[n >= LOCAL]), pa.array(n[n >= LOCAL])], ["token", "n"])

    sums = sets.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    total = sets.agg(F.sum(F.length("tokens"))).first()[0] or 0
    return np.sort(sums.where(F.col("n") >= max(COMMON, total // 8 // MAX_COMMON)).select("token").toArrow().column("token").to_numpy().view(np.uint64))


#: Packed postings, or (df < 0) the size of a class's set and its common shingles.
POSTING = "part int, c long, df int, tokens binary, classes binary"
COUNTED = "token long, c long, df int, common binary"


def _dealt(sets: DataFrame, common, parts: int) -> DataFrame:
    """Packed postings of whole sets; a row for each class has its size and its common shingles."""

    def run(batches):
        tokens, classes, held = [], [], 0

        def emit():
            rows = _packed(np.concatenate(tokens), np.concatenate(classes), parts)
            return _batch(POSTING, **rows)

        for b in batches:
            c = b.column("c").to_numpy()
            raw = b.column("tokens").to_pylist()
            n = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
            token, own = np.frombuffer(b"".join(raw), np.uint64), np.repeat(c, n)
            at = np.minimum(np.searchsorted(common.value, token), max(len(common.value) - 1, 0))
            is_common = common.value[at] == token if len(common.value) else np.zeros(len(token), bool)
            cuts = np.concatenate([[0], np.cumsum(is_common)])[np.cumsum(n)]
            yield _batch(POSTING, part=(c % parts).astype(np.int32), c=c, df=-n, tokens=[x.tobytes() for x in np.split(token[is_common], cuts[:-1])] if len(c) else [])
            tokens.append(token[~is_common])
            classes.append(own[~is_common])
            held += len(tokens[-1])
            if held > _HOLD:
                yield emit()
                tokens, classes, held = [], [], 0
        if held:
            yield emit()

    return sets.mapInArrow(tidy(run), POSTING)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of shingles that two classes or more have, with how many; rows of classes pass."""
    for b in whole_groups(batches, ["part"]):
        own = b.filter(b.column("df").is_valid())
        yield _batch(COUNTED, token=np.zeros(len(own), np.int64), c=own.column("c"), df=own.column("df"), common=own.column("tokens"))
        token, c = _unpacked(b.filter(b.column("df").is_null()))
        df = _run_sizes(token)
        yield _batch(COUNTED, token=signed(token[df > 1]), c=c[df > 1], df=df[df > 1])


LEAN = "c long, n int, tokens binary"


def _lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (c, df, token): the shared shingles of each class that has enough of them, in that order, common ones last."""
    for b in whole_groups(batches, ["c"]):
        c, df, token = (b.column(f).to_numpy() for f in ("c", "df", "token"))
        new = np.ones(len(c), bool)  # a row that the table repeats counts once
        new[1:] = (c[1:] != c[:-1]) | (df[1:] != df[:-1]) | (token[1:] != token[:-1])
        c, df, token = c[new], df[new], token[new]
        first = np.flatnonzero(df < 0)
        common = b.column("common").filter(pa.array(new)).take(pa.array(first)).to_pylist()
        n, ends = -df[first].astype(np.int64), np.append(first[1:], len(c))
        have = ends - first - 1 + np.fromiter((len(x) // 8 for x in common), np.int64, len(common))
        own = np.flatnonzero(have >= needed(n))
        yield _batch(LEAN, c=c[first[own]], n=n[own], tokens=[token[first[k] + 1 : ends[k]].tobytes() + common[k] for k in own])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, c, share): the shared ones of the first n - T + 1 shingles of each class, and the share of its set that is shared."""
    for b in batches:
        c, n = b.column("c").to_numpy(), b.column("n").to_numpy().astype(np.int64)
        sets = [np.frombuffer(x, np.int64) for x in b.column("tokens").to_pylist()]
        have = np.fromiter(map(len, sets), np.int64, len(sets))
        p = np.maximum(have - needed(n) + 1, 0)  # n - T + 1 less the n - have that come before
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[:k] for s, k in zip(sets, p, strict=True)]) if len(p) else np.zeros(0, np.int64)), pa.array(np.repeat(c, p)), pa.array(np.repeat(have / np.maximum(n, 1), p))], ["token", "c", "share"])


# ---- search within a block ------------------------------------------------------------------------


def t_occurrence(lists: list[np.ndarray], least: int) -> dict[int, int]:
    """The numbers that occur in at least ``least`` of the sorted ``lists``, and in how many, by DivideSkip."""
    if len(lists) < least:
        return {}
    by_size = sorted(lists, key=len)
    aside = min(int(least / (0.01 * math.log2(len(by_size[-1]) + 1) + 1)), least - 1)
    short, long = [x.tolist() for x in by_size[: len(by_size) - aside]], by_size[len(by_size) - aside :]
    rest = least - aside  # occurrences the short lists must show
    found: list[tuple[int, int]] = []
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        k, n, popped = heap[0][0], 0, []
        while heap and heap[0][0] == k:
            popped.append(heapq.heappop(heap))
            n += 1
        if n >= rest:
            found.append((k, n))
            ahead = k + 1
        else:  # what can't reach the count is skipped: rest - 1 lists may jump to the next head
            while heap and len(popped) < rest - 1:
                popped.append(heapq.heappop(heap))
            if not heap and len(popped) < rest:
                break
            ahead = max(heap[0][0], k + 1) if heap else k + 1
        for _, i, at in popped:
            at = bisect_left(short[i], ahead, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))
    if not found:
        return {}
    k, n = (np.array(x, np.int64) for x in zip(*found, strict=True))
    for to_go, x in zip(range(len(long), 0, -1), long, strict=True):
        able = n + to_go >= least
        k, n = k[able], n[able]
        if not len(k):
            return {}
        n = n + (x[np.minimum(np.searchsorted(x, k), len(x) - 1)] == k)
    return dict(zip(k[n >= least].tolist(), n[n >= least].tolist(), strict=True))


class Lists:
    """Inverted lists over sets of shared shingles; ``n`` are the sizes of the whole sets."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray):
        self.n, self.have = n, np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.member = np.repeat(np.arange(len(sets)), self.have)[order]
        self.token, self.first, self.size = np.unique(flat[order], return_index=True, return_counts=True)

    def linked(self, query: np.ndarray, n: int, able: np.ndarray) -> np.ndarray:
        """Which of the sets that ``able`` marks link with a set of n, of which ``query`` are the shared shingles."""
        able = able & (100 * np.minimum(self.n, n) >= PERCENT * np.maximum(self.n, n)) & ((100 + PERCENT) * np.minimum(self.have, len(query)) >= PERCENT * (self.n + n))
        if not able.any() or not len(self.token):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        size = self.size[at]
        ends = np.cumsum(size)
        members = self.member[np.repeat(self.first[at] - (ends - size), size) + np.arange(int(size.sum()))]
        kept = np.concatenate([[0], np.cumsum(able[members])])
        least = -(-PERCENT * (n + int(self.n[able].min())) // (100 + PERCENT))
        lists = np.split(members[able[members]], kept[ends][:-1])
        got = t_occurrence([x for x in lists if len(x)], max(least, 1))
        return np.array([k for k, both in got.items() if 100 * both >= PERCENT * (n + int(self.n[k]) - both)], np.int64)


def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Which of ``sets`` link with ``query``; all are whole sets of hashes."""
    lists = Lists([s.view(np.int64) for s in sets], np.array([len(s) for s in sets], np.int64))
    return sorted(lists.linked(np.sort(query.view(np.int64)), len(query), np.ones(len(sets), bool)).tolist())


#: ask 0: a set of the block; 1: a set that asks it. root: what the class is known to be linked with.
UNITS = "unit long, block int, ask int, alone int, c long, n int, root long, tokens binary"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) found in each block; in a group of one block, only as many as tie its components."""
    for b in whole_groups(batches, ["unit", "block"]):
        unit, block, ask, alone, c, n, root = (b.column(f).to_numpy(zero_copy_only=False) for f in ("unit", "block", "ask", "alone", "c", "n", "root"))
        raw = b.column("tokens")
        cuts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (block[1:] != block[:-1])]))
        links: list[tuple[int, int]] = []
        for lo, hi in zip(cuts, [*cuts[1:], len(unit)], strict=True):
            sets = [np.frombuffer(raw[k].as_py(), np.int64) for k in range(lo, hi)]
            if alone[lo]:
                label = _components_of(sets, n[lo:hi].astype(np.int64))
                links += [(int(c[lo + k]), int(c[lo + x])) for k, x in enumerate(label) if x != k]
            else:
                m = int((ask[lo:hi] == 0).sum())
                lists = Lists(sets[:m], n[lo : lo + m].astype(np.int64))
                for k in range(m, hi - lo):
                    links += [(int(c[lo + k]), int(c[lo + x])) for x in lists.linked(np.sort(sets[k]), int(n[lo + k]), root[lo : lo + m] != root[lo + k])]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def _components_of(sets: list[np.ndarray], n: np.ndarray) -> list[int]:
    """For each set the least one of its component. The first to ask is the one with the most shared shingles; those it reaches need not ask."""
    lists = Lists(sets, n)
    up = list(range(len(sets)))

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    order = np.argsort(-lists.have / np.maximum(n, 1), kind="stable").tolist()
    asked = np.zeros(len(sets), bool)
    for k in order:
        main = top(order[0])
        if asked.any() and top(k) == main:
            continue
        asked[k] = True
        able = ~asked  # whoever has asked knows already
        able[[x for x in np.flatnonzero(able).tolist() if top(x) == top(k)]] = False
        for x in lists.linked(np.sort(sets[k]), int(n[k]), able).tolist():
            i, j = top(k), top(x)
            up[max(i, j)] = min(i, j)
    return [top(k) for k in range(len(sets))]


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the least node of its component, by hooking and pointer jumping."""
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/both")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), f"{folder}/labels-0")
    for k in range(1, 1000):
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        hooked = labels.join(seen, labels.node == seen.a).select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = staged(hooked.join(jump, "low", "left").select("node", F.coalesce("far", "low").alias("root"), (F.coalesce("far", "low") != F.col("root")).alias("moved")), f"{folder}/labels-{k}")
        discard(edges.sparkSession, f"{folder}/labels-{k - 1}")
        labels = new.select("node", "root")
        if new.where("moved").isEmpty():
            discard(edges.sparkSession, f"{folder}/both")
            return labels
    raise RuntimeError("components did not settle")


def _ask(rows: DataFrame, folder: str) -> DataFrame:
    """The links found by units ``rows``, written to ``folder``."""
    dealt = rows.repartition(n_shuffle(rows.sparkSession), "unit", "block").sortWithinPartitions("unit", "block", "ask", "c")
    return staged(dealt.mapInArrow(tidy(_search), "a long, b long"), folder)


def _links(lean: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) that tie every component of the classes ``lean`` (c, n, tokens)."""
    lists = staged(lean.mapInArrow(tidy(_lists), "token long, c long, share double"), f"{folder}/lists")
    pivots = lists.groupBy("token").agg(F.max(F.struct("share", "c")).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1").select("token", F.col("best.c").alias("b"))
    ties = staged(lists.join(pivots, "token").where("c <> b").select(F.col("c").alias("a"), "b").distinct(), f"{folder}/ties")
    groups = components(ties, f"{folder}/groups")
    sets = staged(lean.join(groups, F.col("c") == F.col("node")).select(F.col("root").alias("unit"), "c", "n", "tokens"), f"{folder}/sets")
    sizes = sets.groupBy("unit").agg(F.ceil(F.sum(F.length("tokens")) / (8.0 * UNIT)).cast("int").alias("blocks"))
    sizes = staged(sizes, f"{folder}/sizes")
    whole = sets.join(sizes.where("blocks <= 1"), "unit")
    links = _ask(whole.select("unit", F.lit(0).alias("block"), F.lit(0).alias("ask"), F.lit(1).alias("alone"), "c", "n", F.col("c").alias("root"), "tokens"), f"{folder}/links-0")

    large = sets.join(sizes.where("blocks > 1"), "unit")
    if sizes.where("blocks > 1").isEmpty():
        return links

    def asked(of: DataFrame, who: DataFrame) -> DataFrame:
        """Units of the blocks of ``of`` (with root) and the classes ``who`` (c), which ask all blocks of their groups."""
        fields = ("unit", "block", "ask", F.lit(0).alias("alone"), "c", "n", "root", "tokens")
        members = of.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("ask", F.lit(0))
        queries = of.join(who, "c", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("ask", F.lit(1))
        return members.select(*fields).unionByName(queries.select(*fields))

    found = _ask(asked(large.withColumn("root", F.col("c")), ties.select(F.col("b").alias("c")).distinct()), f"{folder}/links-1")
    roots = components(found.where("a <> b"), f"{folder}/roots")
    known = staged(large.join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c")).drop("node"), f"{folder}/known")
    main = known.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("unit").agg(F.max(F.struct("size", "root")).alias("most")).select("unit", F.col("most.root").alias("main"))
    outside = known.join(main, "unit").where("root <> main").select("c")
    more = _ask(asked(known, outside), f"{folder}/links-2")
    return links.unionByName(found).unionByName(more).where("a <> b")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    n, parts = n_shuffle(spark), PARTS * n_shuffle(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = staged(_early(base, parts).repartition(n, "part").sortWithinPartitions("part").mapInArrow(tidy(_seen), SEEN), f"{folder}/first")
    members = first.where("kind = 0").select("doc_id", "n", "c1", "c2")
    reps = members.where("n > 0 and doc_id is not null").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"))
    seen = first.where("kind > 0").groupBy(F.col("c1").alias("c")).agg((F.coalesce(F.sum(F.expr("if(kind = 1, n, 0)")), F.lit(0)) + F.coalesce(F.max(F.expr("if(kind = 2, n, 0)")), F.lit(0))).alias("seen"))
    # The first j that two sets share are seen in both, where j is the less of the two sets' shares: (EARLY - 100 + PERCENT) per cent of T at least.
    enough = F.ceil((EARLY - 100 + PERCENT) * F.ceil(PERCENT * F.col("n") / 100) / 100)
    reps = staged(reps.join(seen, reps.c1 == seen.c, "left").select("c1", "c2", "n", "rep", (F.col("seen") >= enough).alias("able")), f"{folder}/reps")

    left = reps.where("able").groupBy(F.col("c1").alias("c")).agg(F.min("rep").alias("doc_id"))
    sets = staged(_whole_sets(base, left), f"{folder}/left")
    common = spark.sparkContext.broadcast(common_shingles(sets))
    counted = _dealt(sets, common, parts).repartition(n, "part").sortWithinPartitions("part").mapInArrow(tidy(_count), COUNTED)
    lean = staged(counted.repartition(n, "c").sortWithinPartitions("c", "df", "token").mapInArrow(tidy(_lean), LEAN), f"{folder}/lean")
    links = _links(lean, f"{folder}/search")
    # Rows of one id are one node, also where their texts differ.
    several = members.where("n > 0").groupBy("doc_id").agg(F.min("c1").alias("b"), F.max("c1").alias("most")).where("doc_id is not null and b <> most").select("doc_id", "b")
    several = staged(members.where("n > 0").join(several, "doc_id").where("c1 <> b").select(F.col("c1").alias("a"), "b").distinct(), f"{folder}/several")
    roots = components(links.unionByName(several), f"{folder}/components")
    named = roots.join(reps.groupBy(F.col("c1").alias("node")).agg(F.min("rep").alias("rep")), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    classes = reps.join(named.join(least, "root").select(F.col("node").alias("c1"), "component"), "c1", "left").select("c1", "c2", "n", F.coalesce("component", "rep").alias("component"))
    classes = staged(classes, f"{folder}/classes")
    for name in ("reps", "left", "lean", "search", "several", "components"):
        discard(spark, f"{folder}/{name}")
    return members.join(classes, ["c1", "c2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
