"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words joined by one space and closed by an end byte. Each byte is eight binary
decisions; the tree of each decision has the last ``DEPTH`` bytes as context, one byte a level. Every node keeps
the zeros and ones it saw in training; its Krichevsky-Trofimov probability and the product of its children's
weighted probabilities are mixed half and half. After training, a decision's probability is the
posterior mixture along its context path (a context not seen in training leaves the rest of the path out), so the
sum of its logarithms is the code length of the text.

The rows are dealt to chunks of about ``CHUNK_BYTES`` of text by a hash of id and text. Training sends each
chunk's distinct grams and their counts, packed, to slots that hold all contexts ending in the same two bytes;
a slot sums them and builds its part of the tree, ``BLOCK_GRAMS`` grams at a time down to three context bytes. The two levels
above the slots have at most 65,280 nodes and are built on the driver. For scoring each slot answers every chunk with one
number for each gram that the chunk holds, and a chunk's texts are summed beside the answers. So the texts are read twice
at any size, nothing that grows with the corpus goes through the driver or a broadcast, and the model grows with the corpus.

Defined results: a null or empty text is the end token alone; a null id counts as the empty text in the split; rows of
equal id and text give one row (each counts in training); other columns are left out; an empty table gives no rows; without
training rows every decision has probability one half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, n_shuffle, pieces, shared_dir, staged, tidy, word_hashes

DEPTH = 5
END = b"\n"
#: The end as a token: the hash of a blank, which no word holds.
END_KEY = np.uint64(xxhash.xxh64_intdigest(b"\n"))
CHUNK_BYTES = 16 << 20
BLOCK_GRAMS = 250_000
SLOTS = 256  # at least; more where there are many chunks
HELD_OUT, FOLDS = 2, 7
_HOLD = 3_000_000  # counts a task keeps before it folds them
_RUN = 1 << 16  # positions that fit beside a gram in one word


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def byte_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram at every byte of the normalised texts, and the bytes of each text."""
    rows = [b" ".join(t.split()) + END for t in texts]
    pad = END * DEPTH
    b = np.frombuffer(pad + pad.join(rows), np.uint8)
    gram = np.zeros(len(b) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        gram |= b[k : len(b) - DEPTH + k].astype(np.int64) << (8 * (DEPTH - k))
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    first = np.cumsum(lens + DEPTH) - lens - DEPTH
    own = np.arange(int(lens.sum())) + np.repeat(first - (np.cumsum(lens) - lens), lens)
    return gram[own], lens


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, the end token last, and how many."""
    h, lens = word_hashes([t + b" " for t in texts])
    return np.insert(h, np.cumsum(lens), END_KEY), lens + 1


def _pack(x: np.ndarray) -> bytes:
    """64-bit values as bytes of equal weight side by side, compressed, after their length."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(x: bytes, dtype=np.int64) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    raw = pa.Codec("zstd").decompress(x[8:], size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(dtype).ravel()


def _pack_keys(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.int64(0)))  # sorted; differences wrap around and back


def _unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and where each starts, with the array's end."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.append(at, len(x))


class _Counts:
    """Sums of counts by key, folded together whenever many are held."""

    def __init__(self):
        self.keys, self.sums, self.held = [], [], 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.held += len(keys)
        if self.held > _HOLD and self.held > 2 * len(self.keys[0]):
            self.fold()

    def fold(self) -> None:
        keys, sums = np.concatenate(self.keys), np.concatenate(self.sums)
        order = np.argsort(keys, kind="stable")
        k, at = _runs(keys[order])
        self.keys, self.sums, self.held = [k], [np.add.reduceat(sums[order], at[:-1]) if len(k) else sums], len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys and their sums."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fold()
        return self.keys[0], self.sums[0]


def _gram_counts(grams: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and how often each is in training rows (0 where only held-out rows have it)."""
    marked, at = _runs(np.sort(grams << 1 | train))
    k, first = _runs(marked >> 1)
    return k, np.add.reduceat(np.where(marked & 1, np.diff(at), 0), first[:-1])


def _token_counts(tokens: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, _ = _runs(np.sort(tokens))
    seen, at = _runs(np.sort(tokens[train]))
    n = np.zeros(len(k), np.int64)
    n[np.searchsorted(k, seen)] = np.diff(at)
    return k, n


def _slots(kind: int, keys: np.ndarray, slots: int) -> np.ndarray:
    """Grams by the last two bytes of their context, tokens by their hash, in slots of their own."""
    if kind:
        return slots + (keys & (slots - 1))
    return ((keys >> 8 & 65535) * 40503 & 65535) * slots >> 16


def _spans(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of equal values of the columns in a batch, with the values."""
    cols = [batch.column(c).to_numpy() for c in columns]
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    ends = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        if z > a:
            yield tuple(int(c[a]) for c in cols), batch.slice(a, z - a)


def chunk_counts(dealt: DataFrame, slots: int) -> DataFrame:
    """(chunk, slot, keys, counts): what each chunk holds, packed by slot. ``dealt`` is partitioned and sorted by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, None

        def emit():
            for kind in (0, 1):
                k, n = counts[kind].take()
                slot = _slots(kind, k, slots)
                order = np.argsort(slot, kind="stable")
                own, at = _runs(slot[order])
                k, n = k[order], n[order]
                rows = [(current, int(own[j]), _pack_keys(k[at[j] : at[j + 1]]), _pack(n[at[j] : at[j + 1]])) for j in range(len(own))]
                for first in range(0, len(rows), 64):
                    chunk, slot_, keys, sums = zip(*rows[first : first + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(slot_, pa.int32()), pa.array(keys, pa.binary()), pa.array(sums, pa.binary())], ["chunk", "slot", "keys", "counts"])

        for b in batches:
            for (chunk,), part in _spans(b, ["chunk"]):
                if chunk != current:
                    if counts is not None:
                        yield from emit()
                    current, counts = chunk, (_Counts(), _Counts())
                ids = part.column("doc_id").to_pylist()
                for first, texts in pieces(part, "text", 1 << 20):
                    texts = [t.lower() for t in texts]
                    train = np.array([not held_out(i) for i in ids[first : first + len(texts)]])
                    grams, lens = byte_grams(texts)
                    counts[0].add(*_gram_counts(grams, np.repeat(train, lens)))
                    tokens, lens = token_keys(texts)
                    counts[1].add(*_token_counts(tokens.view(np.int64), np.repeat(train, lens)))
        if counts is not None:
            yield from emit()

    return dealt.select("chunk", "doc_id", "text").mapInArrow(tidy(run), "chunk int, slot int, keys binary, counts binary")


# ---- the tree ---------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _parent(key: np.ndarray, depth: int) -> np.ndarray:
    """The node of ``depth`` context bytes above nodes given as context << 8 | bits so far."""
    return ((key >> 8) & ((1 << (8 * depth)) - 1)) << 8 | (key & 255)


def _decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram and each of eight bits: the node of full depth, and the bit."""
    byte, j = (grams & 255)[:, None], np.arange(8)
    node = (1 << j) | (byte >> (8 - j))
    return (((grams >> 8) << 8)[:, None] | node).ravel(), ((byte >> (7 - j)) & 1).ravel()


class Level:
    """The nodes of one depth: counts, weighted probability and the posterior of stopping here."""

    def __init__(self, key, n0, n1, below=None):
        self.key, self.n0, self.n1 = key, n0, n1
        own = log_kt(n0, n1)
        self.log_w = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.ones(len(key)) if below is None else np.exp(own - np.log(2) - self.log_w)

    def above(self, depth: int) -> tuple[np.ndarray, ...]:
        """Keys of the parents and sums over their children: zeros, ones, log weighted probability."""
        key, inverse = np.unique(_parent(self.key, depth), return_inverse=True)
        return key, *(np.bincount(inverse, x, len(key)) for x in (self.n0, self.n1, self.log_w))

    def mix(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probabilities of ``bit``, given those of the deeper levels (NaN where nothing was seen there)."""
        at = np.searchsorted(self.key, key)
        n0, n1 = self.n0[at], self.n1[at]
        kt = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
        stop = self.stop[at]
        p = np.where(np.isnan(deeper), kt, stop * kt + (1 - stop) * np.nan_to_num(deeper))
        return np.where(n0 + n1 > 0, p, np.nan)


def deep_levels(grams: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels DEPTH down to 3."""
    node, bit = _decisions(grams)
    n = np.repeat(n, 8)
    key, inverse = np.unique(node, return_inverse=True)
    levels = [Level(key, np.bincount(inverse, n * (bit == 0), len(key)), np.bincount(inverse, n * (bit == 1), len(key)))]
    for depth in range(DEPTH - 1, 2, -1):
        levels.append(Level(*levels[-1].above(depth)))
    return levels


def _blocks(grams: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the grams in blocks of about BLOCK_GRAMS that hold whole contexts of three bytes."""
    context = grams >> 8 & 0xFFFFFF
    order = np.argsort(context, kind="stable")
    _, at = _runs(context[order])
    first = 0
    for end in at[1:].tolist():
        if end - first >= BLOCK_GRAMS or end == len(grams):
            yield order[first:end]
            first = end


def slot_sums(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """At level 2, from all grams of a slot: keys, zeros, ones, log weighted probability below."""
    parts = [deep_levels(grams[at], n[at])[-1].above(2) for at in _blocks(grams)]
    key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, *(np.bincount(inverse, np.concatenate([p[j] for p in parts]), len(key)) for j in (1, 2, 3))


def top_levels(rows: list[tuple]) -> list[Level]:
    """Levels 1 and 0 from the sums at level 1: (key, zeros, ones, log weighted probability below)."""
    key, n0, n1, below = (np.array(x) for x in zip(*rows, strict=True))
    order = np.argsort(key)
    one = Level(key[order].astype(np.int64), *(x[order].astype(float) for x in (n0, n1, below)))
    return [one, Level(*one.above(0))]


def merged_counts(requests: DataFrame, slots: int, parts: int) -> DataFrame:
    """(slot, keys, counts, two, n, seen): the sums of each slot over all chunks, and for grams the sums at level 2."""

    def run(batches):
        current, counts = None, None

        def emit():
            k, n = counts.take()
            two = b"" if current >= slots else b"".join(len(x).to_bytes(8, "little") + x for x in map(_pack, slot_sums(k, n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([_pack_keys(k)], pa.binary()), pa.array([_pack(n)], pa.binary()), pa.array([two], pa.binary()), pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])],
                ["slot", "keys", "counts", "two", "n", "seen"],
            )

        for b in batches:
            for (slot,), part in _spans(b, ["slot"]):
                if slot != current:
                    if counts is not None:
                        yield from emit()
                    current, counts = slot, _Counts()
                for keys, sums in zip(part.column("keys").to_pylist(), part.column("counts").to_pylist(), strict=True):
                    counts.add(_unpack_keys(keys), _unpack(sums))
        if counts is not None:
            yield from emit()

    dealt = requests.select("slot", "keys", "counts").repartition(parts, "slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(tidy(run), "slot int, keys binary, counts binary, two binary, n long, seen long")


def _level_two(two: bytes) -> tuple[np.ndarray, ...]:
    out, at = [], 0
    for dtype in (np.int64, float, float, float):
        size = int.from_bytes(two[at : at + 8], "little")
        out.append(_unpack(two[at + 8 : at + 8 + size], dtype))
        at += 8 + size
    return tuple(out)


def tree_top(merged: DataFrame, slots: int) -> list[Level]:
    """Levels 1 and 0: at most 65,280 sums reach the driver."""

    def run(batches):
        for b in batches:
            for two in b.column("two").to_pylist():
                key, n0, n1, below = Level(*_level_two(two)).above(1)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "n0": pa.array(n0), "n1": pa.array(n1), "below": pa.array(below)})

    sums = merged.where(F.col("slot") < slots).select("two").mapInArrow(tidy(run), "key long, n0 double, n1 double, below double")
    rows = sums.groupBy("key").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).collect()
    return top_levels([tuple(r) for r in rows]) if rows else []


def gram_logs(grams: np.ndarray, n: np.ndarray, upper: list[Level]) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others, given the levels from 2 up."""
    out = np.zeros(len(grams))
    for at in _blocks(grams):
        node, bit = _decisions(grams[at])
        p = np.full(len(node), np.nan)
        for depth, level in zip(range(DEPTH, -1, -1), deep_levels(grams[at], n[at]) + upper, strict=True):
            p = level.mix(_parent(node, depth), bit, p)
        out[at] = np.log10(np.where(np.isnan(p), 0.5, p)).reshape(-1, 8).sum(axis=1)
    return out


def answers(requests: DataFrame, merged: DataFrame, top: list[Level], slots: int, parts: int) -> DataFrame:
    """(chunk, slot, keys, values): for each gram of a chunk its logarithm, for each token log10(count + 1), NaN where untrained."""
    shared = requests.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        keys, values = None, None
        for b in batches:
            asked = [], [], [], []
            for chunk, slot, own, n, two in zip(*(b.column(c).to_pylist() for c in ("chunk", "slot", "keys", "counts", "two")), strict=True):
                if chunk < 0:  # the slot's own row comes first
                    keys, n = _unpack_keys(own), _unpack(n)
                    if slot < slots:
                        values = gram_logs(keys, n, [Level(*_level_two(two)), *shared.value])
                    else:
                        values = np.where(n > 0, np.log10(n + 1.0), np.nan)
                else:
                    for out, x in zip(asked, (chunk, slot, own, _pack(values[np.searchsorted(keys, _unpack_keys(own))])), strict=True):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(asked[0], pa.int32()), pa.array(asked[1], pa.int32()), pa.array(asked[2], pa.binary()), pa.array(asked[3], pa.binary())], ["chunk", "slot", "keys", "values"])

    none = F.lit(None).cast("binary")
    rows = requests.select("chunk", "slot", "keys", none.alias("counts"), none.alias("two"))
    rows = rows.unionByName(merged.select(F.lit(-1).alias("chunk"), "slot", "keys", "counts", "two"))
    dealt = rows.repartition(parts, "slot").sortWithinPartitions("slot", "chunk")
    return dealt.mapInArrow(tidy(run), "chunk int, slot int, keys binary, values binary")


# ---- scoring ----------------------------------------------------------------------------------


def _look_up(keys: np.ndarray, values: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The value of every gram; the grams are sorted in runs so that neighbours meet neighbours in the table."""
    n = len(grams)
    rows = -(-n // _RUN)
    packed = np.zeros(rows * _RUN, np.uint64)
    packed[:n] = grams.astype(np.uint64) << np.uint64(16)
    packed[n:] = packed[0]
    packed |= np.tile(np.arange(_RUN, dtype=np.uint64), rows)
    packed = np.sort(packed.reshape(rows, _RUN), axis=1)
    place = (packed & np.uint64(_RUN - 1)).astype(np.int64) + (np.arange(rows) * _RUN)[:, None]
    out = np.empty(rows * _RUN)
    out[place.ravel()] = values[np.searchsorted(keys, (packed >> np.uint64(16)).astype(np.int64).ravel())]
    return out[:n]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("row"))
    folder = shared_dir(spark)
    size = base.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    chunks = size // CHUNK_BYTES + 1
    slots = SLOTS
    while slots < min(chunks // 4, 65536):
        slots *= 2
    parts = max(n_shuffle(spark), chunks // 4)
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row"), F.lit(chunks)).cast("int"))
    requests = staged(chunk_counts(base.repartition(parts, "chunk").sortWithinPartitions("chunk"), slots), f"{folder}/requests")
    merged = staged(merged_counts(requests, slots, min(parts, 2 * slots)), f"{folder}/merged")
    tokens = merged.where(F.col("slot") >= slots).agg(F.sum("n").alias("n"), F.sum("seen").alias("v")).first()
    total, kinds = tokens.n or 0, tokens.v or 0
    known = staged(answers(requests, merged, tree_top(merged, slots), slots, min(parts, 2 * slots)), f"{folder}/answers")
    for done in ("requests", "merged"):
        discard(spark, f"{folder}/{done}")
    kind = base.schema["doc_id"].dataType.simpleString()
    unseen = np.log10(total + kinds + 1.0)

    def run(batches):
        current, held, tables = None, None, None
        for b in batches:
            for (chunk, is_text), part in _spans(b, ["chunk", "is_text"]):
                if chunk != current:
                    current, held, tables = chunk, [], None
                if not is_text:
                    held += zip(part.column("slot").to_pylist(), part.column("keys").to_pylist(), part.column("values").to_pylist(), strict=True)
                    continue
                if tables is None:
                    tables = []
                    for wanted in (False, True):
                        rows = [(_unpack_keys(k), _unpack(v, float)) for slot, k, v in held if (slot >= slots) == wanted]
                        k, v = (np.concatenate(x) for x in zip(*rows, strict=True))
                        order = np.argsort(k)
                        tables.append((k[order], v[order]))
                    held = []
                for at, texts in pieces(part, "text", 1 << 20):
                    texts = [t.lower() for t in texts]
                    n = len(texts)
                    g, g_lens = byte_grams(texts)
                    score = np.bincount(np.repeat(np.arange(n), g_lens), _look_up(*tables[0], g), n)
                    t, t_lens = token_keys(texts)
                    value = tables[1][1][np.searchsorted(tables[1][0], t.view(np.int64))]
                    seen, owner = ~np.isnan(value), np.repeat(np.arange(n), t_lens)
                    sums = np.bincount(owner, np.nan_to_num(value), n)
                    hits = np.bincount(owner, seen, n).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(at, n), part.column("row").slice(at, n), pa.array(t_lens), pa.array(g_lens), pa.array(sums), pa.array(hits), pa.array(score)], ["doc_id", "row", "n_tokens", "n_bytes", "base", "known", "score"])

    rows = base.withColumn("is_text", F.lit(1)).unionByName(known.withColumn("is_text", F.lit(0)), allowMissingColumns=True)
    rows = rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "is_text")
    out = rows.mapInArrow(tidy(run), f"doc_id {kind}, row long, n_tokens long, n_bytes long, base double, known long, score double")
    is_held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    return out.select(
        "doc_id",
        is_held.alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(unseen))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
