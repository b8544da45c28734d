"""Byte-level BPE by recursive queries of an embedded DuckDB in every partition.

Spark cuts texts into words by the tokenizer's pattern. Each partition keeps a merge table (pairs of ids
and the id, hence rank, of their concatenation) in an in-memory DuckDB. The distinct new words of some texts
become rows of (word, tokens), first one token for each byte, each with the rank of the pair that it starts. A step of the
recursive query contracts each word's leftmost pair of the lowest rank and looks up the two pairs that the new token is in,
until no pair of the word is in the table. Ids are decoded by an ordered aggregation of their bytes.

A word is cut first between two bytes that no token holds side by side, as nothing can merge across. A query
takes ``STEPS`` steps at most; words that need more go on in the next one, so what a query holds is bounded.
Words repeat, so they are kept in Arrow columns beside their ids and decoded bytes, from which the texts are put together.
Beyond ``MAX_BYTES`` a worker keeps the words that were used last, half as much. This changes no result.

Defined results: a null text is empty; an empty text has no ids and decodes to nothing; rows and ids may repeat and are
coded each; an empty table gives an empty result; other columns are not looked at. Long texts and words are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

MAX_BYTES = 24_000_000  # bytes of the words, ids and decoded words that a worker keeps, with WORD_BYTES for each word
WORD_BYTES = 32
BATCH_BYTES = 200_000  # bytes of the words of a query, about
TEXT_BYTES = 4_000_000  # bytes of texts whose words are looked up together, about
ROWS, ROWS_BYTES = 512, 1_000_000  # rows, and bytes of their texts, that are put together from words at once, about
STEPS = 24

#: A token in a list: the rank of the pair that it starts (NONE: not in the table), its place in the part, its id. So the least
#: is the leftmost pair of the lowest rank. PAD stands before and behind the tokens of a part and merges with nothing.
ID_BITS, RANK_AT = 20, 42
PAD = 2**ID_BITS - 1
NONE = 2**ID_BITS

ENCODE = f"""
with recursive s(w, x, low, step) as (
  select w, x, list_min(x), 0 from word_tokens
  union all
  select w, y, list_min(y), step + 1 from (
    select w, step, list_concat(
      x[:p - 2],
      [(coalesce(l.id, {NONE})::bigint << {RANK_AT}) | before, (coalesce(r.id, {NONE})::bigint << {RANK_AT}) | (low & {2**RANK_AT - 2**ID_BITS}) | merged],
      x[p + 2:]
    ) as y
    from (
      select *, low >> {RANK_AT} as merged, x[p - 1] & {2**RANK_AT - 1} as before, x[p + 2] & {PAD} as after
      from (select *, list_position(x, low)::bigint as p from s where low < {NONE << RANK_AT} and step < {STEPS})
    )
    left join merges l on l.pair = ((before & {PAD}) << {ID_BITS}) | merged
    left join merges r on r.pair = (merged << {ID_BITS}) | after
  )
)
select w, x, low >= {NONE << RANK_AT} as done from s where low >= {NONE << RANK_AT} or step = {STEPS}
"""

#: A long part takes many places in one step. Let L be the bytes of the longest token that the part's bytes can make.
#:
#: A pair of rank r is calm where none of the pairs that its new id would make with its neighbours, or with its own kind beside
#: it, ranks below r. A calm pair that ranks lowest among the pairs that start from L bytes before it to 2 L after it is
#: contracted by the one-at-a-time rule sooner or later, with its neighbours as they are: what would take one of its tokens or
#: change a neighbour first has to grow a token beside it, of at most L bytes, out of pairs there, and the first of those would
#: rank below r or, further left, at r; the latter can't grow before where it is calm, else the pair waits. To contract it at once
#: changes no other choice, as what it makes possible ranks above r. Pairs of equal rank that overlap go every second one from
#: the left, and only as far as each of them is lowest around its own place. Another pair may make lower ranks possible within
#: L bytes of it: it is contracted where it is the lowest, and the leftmost of that rank, from 4 L before to 4 L after, so that
#: nothing which goes before it reaches those bytes. Contractions of one step, taken from the highest rank to the lowest and
#: from left to right, leave each other's surroundings as they are.
ENCODE_LONG = """
with recursive s(k, id, done, step) as (
  select k, id, false, 0 from word_bytes
  union all
  select * from (
    with a as (
      select k, id, step, lead(k) over o as nk, lead(id) over o as nid, lag(id) over o as before, lead(id, 2) over o as after
      from s where not done and step < {steps} window o as (order by k)
    ),
    pairs as materialized (select a.*, m.id as merged, m.safe from a left join merges m on m.pair = a.id::bigint * 1048576 + a.nid),
    calm as (
      select p.*, p.safe or (coalesce(l.id, 1048576) > merged and coalesce(r.id, 1048576) > merged and coalesce(b.id, 1048576) > merged) as calm
      from pairs p left join merges l on l.pair = case when not p.safe then before::bigint * 1048576 + merged end
      left join merges r on r.pair = case when not p.safe then merged::bigint * 1048576 + after end
      left join merges b on b.pair = case when not p.safe then merged::bigint * 1048576 + merged end
      where merged is not null
    ),
    around as (
      select k, nk, merged, calm,
        min(merged) over (order by k range between {reach} preceding and {reach} * 2 following) as near,
        min(case when not calm then merged end) over (order by k range between {reach} preceding and 1 preceding) as restless,
        min(merged) over (order by k range between {reach} * 4 preceding and 1 preceding) as left_low,
        min(merged) over (order by k range between 1 following and {reach} * 4 following) as right_low,
        lag(nk) over (order by k) is distinct from k or lag(merged) over (order by k) is distinct from merged as starts
      from calm
    ),
    chains as (
      select *, case when calm then merged = near and restless is distinct from merged else merged < coalesce(left_low, 1048576) and merged <= coalesce(right_low, 1048576) end as low,
        sum(starts::int) over (order by k rows unbounded preceding) as chain
      from around
    ),
    turns as (select *, row_number() over (partition by chain order by k) as n, bool_and(low and calm) over (partition by chain order by k rows unbounded preceding) as settled from chains),
    acts as materialized (select unnest([k, nk]) as k, unnest([merged, -1]) as id from turns where case when calm then settled and n % 2 = 1 else low end)
    select p.k, coalesce(t.id, p.id), not exists (select 1 from calm), p.step + 1
    from pairs p left join acts t on t.k = p.k where t.id is distinct from -1
  )
)
select id, k as p, done from s where done or step = {steps} order by k
"""

#: Bytes of a part from which it is long, and rows times steps of a query over long parts.
LONG, LONG_ROWS = 1024, 3_000_000

DECODE = """
select t.w, string_agg(v.hex, '' order by t.p) as hex from tokens t join vocab v on v.id = t.id group by t.w order by t.w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes words to ids and ids to bytes in an in-memory DuckDB."""

    def __init__(self, path: str):
        import duckdb

        ranks = load_ranks(path)
        pairs = [(a, b, r) for tok, r in ranks.items() for k in range(1, len(tok)) if (a := ranks.get(tok[:k])) is not None and (b := ranks.get(tok[k:])) is not None]
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        unsafe = np.concatenate([left[merged < left], right[merged < right]])
        beside = np.zeros(1 << 16, bool)  # byte pairs that some token holds
        for tok in ranks:
            beside[[a << 8 | b for a, b in zip(tok, tok[1:], strict=False)]] = True
        self.beside = beside
        self.byte_pairs = np.array([ranks.get(bytes([k >> 8, k & 255]), NONE) for k in range(1 << 16)], np.int64)  # their ranks
        self.has = np.zeros((len(ranks), 32), np.uint8)  # which bytes each token holds, a bit for each
        for k, tok in enumerate(ranks):
            for b in tok:
                self.has[k, b >> 3] |= 128 >> (b & 7)
        self.sizes = np.fromiter(map(len, ranks), np.int64, len(ranks))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        merges = pa.table({"pair": left * 1048576 + right, "id": pa.array(merged, pa.int32()), "safe": ~np.isin(merged, unsafe)})
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db.register("m", merges)
        self.db.register("v", vocab)
        self.db.execute("create table merges as select * from m")
        self.db.execute("create table vocab as select * from v")
        self.words = pa.array([], pa.large_string())  # with their ids, what these decode to, and the turns in which they were used last
        self.ids = self.raw = pa.array([], pa.large_binary())
        self.used, self.turn = np.zeros(0, np.int64), 0

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        ids, counts = self._encode(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        return np.split(ids, np.cumsum(counts)[:-1]) if words else []

    def _encode(self, raw: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that lie one behind the other in ``raw``, and how many each has."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(lens), np.int64)
        own = np.repeat(np.arange(len(lens)), lens)
        pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
        cut = np.ones(len(raw), bool)  # where a part that merges by itself starts
        cut[1:] = (own[1:] != own[:-1]) | ~self.beside[pair]
        part = np.cumsum(cut) - 1
        first = np.flatnonzero(cut)
        size = np.diff(first, append=len(raw))
        parts, counts, ids = [], [], []
        for p in np.flatnonzero(size > LONG):
            ids.append(self._long(raw[first[p] : first[p] + size[p]])[1])
            parts.append([p])
            counts.append([len(ids[-1])])
        short = np.flatnonzero(size <= LONG)
        starts = np.zeros(len(size), np.int64)
        starts[short] = np.cumsum(size[short] + 2) - size[short] - 2
        ends = starts[short] + size[short] + 2
        tokens = np.full(int(ends[-1]) if len(ends) else 0, NONE << RANK_AT | PAD)
        rank = np.full(len(raw), NONE)
        rank[:-1][~cut[1:]] = self.byte_pairs[pair[~cut[1:]]]
        place = np.arange(len(raw)) - first[part] + 1
        here = (size <= LONG)[part]
        tokens[(starts[part] + place)[here]] = (rank << RANK_AT | place << ID_BITS | self.byte_ids[raw])[here]
        table = pa.table({"w": short, "x": pa.LargeListArray.from_arrays(np.append(0, ends), tokens)})
        edges = np.flatnonzero(np.diff(ends // (2 * BATCH_BYTES))) + 1  # one word alone can have many parts
        for lo, hi in zip([0, *edges], [*edges, len(short)], strict=True):
            rows = table.slice(lo, hi - lo)
            while len(rows):
                self.db.register("word_tokens", rows)
                got = self.db.sql(ENCODE).to_arrow_table()
                self.db.unregister("word_tokens")
                ready = got.filter(got.column("done"))
                x = ready.column("x").combine_chunks()
                own_ids = x.flatten().to_numpy() & PAD
                parts.append(ready.column("w").to_numpy())
                counts.append(x.value_lengths().to_numpy() - 2)
                ids.append(own_ids[own_ids != PAD])
                rows = got.filter(pc.invert(got.column("done"))).select(["w", "x"])
        parts, counts, ids = np.concatenate(parts).astype(np.int64), np.concatenate(counts).astype(np.int64), np.concatenate(ids).astype(np.int32)
        turned = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(counts)), ids).take(pa.array(np.argsort(parts)))
        return turned.flatten().to_numpy(), np.bincount(own[first][parts], counts, len(lens)).astype(np.int64)

    def _long(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places at which the tokens of one long part start, and their ids."""
        held = np.zeros(256, bool)
        held[raw] = True
        reach = int(self.sizes[~(self.has & np.packbits(~held)).any(axis=1)].max())
        place, ids, over = np.arange(len(raw)), self.byte_ids[raw], False
        while not over:
            steps = max(1, min(STEPS, LONG_ROWS // len(place)))
            self.db.register("word_bytes", pa.table({"k": place, "id": pa.array(ids, pa.int32())}))
            got = self.db.sql(ENCODE_LONG.format(steps=steps, reach=reach)).to_arrow_table()
            self.db.unregister("word_bytes")
            place, ids, over = got.column("p").to_numpy(), got.column("id").to_numpy(), bool(got.column("done").to_numpy()[0])
        return place, ids

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        raw, sizes = self._decode(np.concatenate([np.zeros(0, np.int32), *ids]), counts)
        return [raw[end - n : end] for n, end in zip(sizes, np.cumsum(sizes), strict=True)]

    def _decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of lists of ids that lie one behind the other, and how many each has."""
        sizes = np.zeros(len(counts), np.int64)
        if not len(ids):
            return b"", sizes
        self.db.register("tokens", pa.table({"w": np.repeat(np.arange(len(counts)), counts), "p": np.arange(len(ids)), "id": ids.astype(np.int32)}))
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        digits, starts = laid(got.column("hex").combine_chunks().cast(pa.large_binary()))
        sizes[counts > 0] = np.diff(starts) // 2
        return bytes.fromhex(digits.tobytes().decode()), sizes

    def learn(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words among those kept; new ones are encoded and decoded, in queries of bounded size."""
        self.turn += 1
        sizes = sum(np.diff(laid(x)[1]) for x in (self.words, self.ids, self.raw)) + WORD_BYTES
        if sizes.sum() > MAX_BYTES:
            order = np.argsort(-self.used, kind="stable")
            keep = pa.array(np.sort(order[np.cumsum(sizes[order]) <= MAX_BYTES // 2]))
            self.words, self.used = self.words.take(keep), self.used[keep.to_numpy()]
            self.ids = self.ids.take(keep)
            self.raw = self.raw.take(keep)
        known = pc.index_in(words, value_set=self.words)
        at = known.fill_null(-1).to_numpy().astype(np.int64)
        new = words.filter(known.is_null())
        at[at < 0] = len(self.words) + np.arange(len(new))
        raw, starts = laid(new)
        coded, decoded = [], []
        edges = np.flatnonzero(np.diff(starts[1:] // BATCH_BYTES)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(new)], strict=True):
            ids, counts = self._encode(raw[starts[lo] : starts[hi]], np.diff(starts[lo : hi + 1]))
            coded.append(binary(ids.astype("<i4"), counts * 4))
            decoded.append(binary(*self._decode(ids, counts)))
        self.words = pa.concat_arrays([self.words, new])  # one by one: each has its old and new form at once
        self.ids = pa.concat_arrays([self.ids, *coded])
        self.raw = pa.concat_arrays([self.raw, *decoded])
        self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[at] = self.turn
        return at


def offsets(values: pa.Array) -> np.ndarray:
    """Where each string, binary value or list starts in what lies below, and where the last one ends; not copied."""
    if not len(values):
        return np.zeros(1, np.int64)
    wide = any(f(values.type) for f in (pa.types.is_large_string, pa.types.is_large_binary, pa.types.is_large_list))
    return np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1]


def laid(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings or binary values one behind the other, and where each starts and the last one ends."""
    starts = offsets(values)
    data = values.buffers()[2] if len(values) else None
    return np.frombuffer(data or b"", np.uint8)[starts[0] : starts[-1]], starts.astype(np.int64) - starts[0]


def text_ends(lists: pa.Array) -> np.ndarray:
    """Bytes of the words up to each list's end; the words' own offsets are not copied."""
    starts = offsets(lists.flatten())
    words = offsets(lists)
    return starts[words[1:] - words[0]].astype(np.int64) - starts[0]


def stretches(ends: np.ndarray, size: int, rows: int) -> Iterator[tuple[int, int]]:
    """Cuts rows, whose texts end at these bytes, into stretches of about ``size`` bytes and at most ``rows`` rows."""
    edges = [0, *(np.flatnonzero(np.diff(ends // size)) + 1), len(ends)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield from ((k, min(k + rows, hi)) for k in range(lo, hi, rows))


def binary(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Values of these sizes that lie one behind the other."""
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64)), pa.py_buffer(data)])


@cache
def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path)


def split_words(text: Column, pattern: str) -> Column:
    """The matches of the tokenizer's pattern in turn (with Unicode blanks, as the pattern means them)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def encode_decode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_decoded: bool | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, token_ids][, decoded]) of every row's whole text; ``with_decoded``: as ``with_ids`` unless given."""
    with_decoded = with_ids if with_decoded is None else with_decoded
    base = docs.select(id_col, split_words(F.col(text_col), pattern).alias("__words"))
    kind = base.schema[id_col].dataType.simpleString()
    extra = ", token_ids array<int>" * with_ids + ", decoded binary" * with_decoded

    def run(batches):
        own = codec(vocab_path)
        for b in batches:
            ends = text_ends(b.column("__words"))
            for lo, hi in stretches(ends, TEXT_BYTES, b.num_rows):
                part = b.slice(lo, hi - lo)
                flat = part.column("__words").flatten().dictionary_encode()
                places = own.learn(flat.dictionary.cast(pa.large_string()))
                words = offsets(part.column("__words"))
                words = words - words[0]
                for first, last in stretches(ends[lo:hi], ROWS_BYTES, ROWS):
                    at = pa.array(places[flat.indices[words[first] : words[last]].to_numpy()])
                    yield coded(own, part.column(id_col).slice(first, last - first), at, words[first : last + 1] - words[first])

    def coded(own, keys, at, ends):
        ids, starts = laid(own.ids.take(at))
        x = starts[ends]
        hashes = [hashlib.sha256(ids[lo:hi]).hexdigest() for lo, hi in zip(x[:-1], x[1:], strict=True)]
        raw, starts = laid(own.raw.take(at))
        t = starts[ends]
        decoded = [hashlib.sha256(raw[lo:hi]).hexdigest() for lo, hi in zip(t[:-1], t[1:], strict=True)]
        cols = [keys, pa.array(np.diff(x) // 4), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(x // 4, pa.int32()), ids.view("<i4")))
            names.append("token_ids")
        if with_decoded:
            cols.append(binary(raw, np.diff(t)).cast(pa.binary()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(cols, names)

    return base.mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
