import base64
import collections
import hashlib
import html.parser
import math
import random
import re
import time
import tracemalloc
import types
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideframe.llm import byte_bpe, chat_format, common, decontaminate, jaccard_join, line_dedup, quality_rules, token_files, tree_score, url_rules
from strideframe.llm import html_text
from strideframe.llm.html_text import extract_text, page_text

from . import plain

DOCS = "doc_id long, text string"
VOCAB = P.path("byte_bpe_50k.tiktoken")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---- line dedup ----


def test_line_dedup_edges(edge_docs, edge_rows):
    out = line_dedup.dedup_lines(edge_docs)
    assert set(out.columns) == set(edge_docs.columns)
    assert rows_of(out, "doc_id", "text", "n_lines", "n_dropped") == sorted(plain.line_dedup(edge_rows), key=repr)


def test_line_dedup_null_ids_ties_and_many_batches(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (None, line + "\nx"), (3, line), (3, line), (2, "short\nshort"), (9, line.upper() + "\n" + line)]
    for batches in (1, 7):
        out = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), batches=batches)
        assert rows_of(out, "doc_id", "text", "n_lines", "n_dropped") == sorted(plain.line_dedup(rows), key=repr)


def test_line_runs_hold_each_line_once(spark):
    index = line_dedup.LineRuns(spark, common.shared_dir(spark), fanout=2)
    for k in range(4):
        index.add(spark.createDataFrame([(h, h, k) for h in range(k, k + 3)], "h1 long, h2 long, doc_id long"))
    assert [len(level) for level in index.levels] == [0, 0, 1]
    assert rows_of(index.totals(), "h1", "n", "last_doc") == sorted([(0, 1, 0), (1, 2, 1), (2, 3, 2), (3, 3, 3), (4, 2, 3), (5, 1, 3)], key=repr)


def test_line_dedup_empty_table(nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0


# ---- byte-level BPE ----


def own_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(edge_docs, edge_rows):
    enc = own_encoding()
    want = [(i, enc.encode_ordinary(t or "")) for i, t in edge_rows]
    got = byte_bpe.encode_decode(edge_docs, VOCAB, P.PATTERN, with_ids=True)
    assert rows_of(got.select("doc_id", "token_ids"), "doc_id", "token_ids") == sorted(want, key=repr)
    digest = {(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), plain.sha(t or "")) for (i, x), (_, t) in zip(want, edge_rows, strict=True)}
    assert {tuple(r)[:4] for r in got.collect()} == digest


def test_bpe_every_code_point_block(spark):
    enc = own_encoding()
    rows = [(a, "".join(chr(c) for c in range(a, a + 512) if not 0xD800 <= c < 0xE000)) for a in range(1, 0x3400, 512)]
    got = byte_bpe.encode_decode(spark.createDataFrame(rows, DOCS), VOCAB, P.PATTERN, with_ids=True)
    assert {r.doc_id: r.token_ids for r in got.collect()} == {i: enc.encode_ordinary(t) for i, t in rows}


def test_bpe_long_and_random_words(monkeypatch):
    """Words of any length take the same query, also where it ends before they do."""
    codec, enc, rnd = byte_bpe.codec(VOCAB), own_encoding(), random.Random(3)
    words = [b"ab" * 5000, "é".encode() * 3000, b"=" * 9000, b"thethethat" * 900, b"x" * 30_000, b" " * 4001]
    words += ["".join(rnd.choice("aeiothns") for _ in range(rnd.randrange(1, 90))).encode() for _ in range(300)]
    words += ["".join(rnd.choice("ab=é日") for _ in range(rnd.randrange(1, 30))).encode() for _ in range(300)]
    want = [enc._core_bpe.encode_single_piece(w) for w in words]
    assert [x.tolist() for x in codec.encode(words)] == want
    monkeypatch.setattr(byte_bpe, "ENCODE", byte_bpe.ENCODE.replace(f"step < {byte_bpe.STEPS}", "step < 2").replace(f"step = {byte_bpe.STEPS}", "step = 2"))
    assert [x.tolist() for x in codec.encode(words)] == want


def test_bpe_long_words_take_many_places_at_once(monkeypatch):
    """Random and periodic words, cut into long parts from 30 bytes on, against tiktoken."""
    codec, enc, rnd = byte_bpe.codec(VOCAB), own_encoding(), random.Random(5)
    monkeypatch.setattr(byte_bpe, "LONG", 30)
    words = []
    for _ in range(120):
        letters = rnd.choice(["ab", "the", "aeiothns", "=-", "abcdefghijklmnopqrstuvwxyz", "=-*#", "ing", "erstion", "  \n\t", "0123456789", "ÃÂ"])
        unit = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12)))
        words.append((unit * rnd.randrange(1, 60) + "".join(rnd.choice(letters) for _ in range(rnd.randrange(300))))[:700].encode())
    want = [enc._core_bpe.encode_single_piece(w) for w in words]
    assert [x.tolist() for x in codec.encode(words)] == want
    monkeypatch.setattr(byte_bpe, "LONG_ROWS", 1000)  # a step or so for each query
    assert [x.tolist() for x in codec.encode(words[:40])] == want[:40]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "aeiothns", "a", "thethethat"])
def test_bpe_time_of_a_long_word(letters):
    codec, enc, rnd = byte_bpe.codec(VOCAB), own_encoding(), random.Random(6)
    word = (letters * 4000 if letters == "thethethat" else "".join(rnd.choice(letters) for _ in range(40_000))).encode()
    began = time.time()
    got = codec.encode([word])[0].tolist()
    assert time.time() - began < 15 and got == enc._core_bpe.encode_single_piece(word)


def test_bpe_time_of_many_words():
    """A step costs a word's contraction, not a pass over all its tokens (8 s and more where it was one)."""
    codec, enc, rnd = byte_bpe.codec(VOCAB), own_encoding(), random.Random(8)
    words = [(" " + "".join(rnd.choice(["th", "re", "an", "ing", "es", "tion", "ñ", "ou", "h"]) for _ in range(rnd.randrange(2, 8)))).encode() for _ in range(200_000)]
    took = []
    for _ in range(2):
        began = time.process_time()
        got = codec.encode(words)
        took.append(time.process_time() - began)
    assert min(took) < 4.5
    assert [x.tolist() for x in got[:20_000]] == [enc._core_bpe.encode_single_piece(w) for w in words[:20_000]]


def test_bpe_time_of_words_of_hundreds_of_bytes():
    """They go through one query together (0.25 s each where every one had its own)."""
    codec, enc, rnd = byte_bpe.codec(VOCAB), own_encoding(), random.Random(11)
    words = ["".join(rnd.choice("aeiothns") for _ in range(rnd.randrange(257, 900))).encode() for _ in range(40)]
    began = time.process_time()
    got = codec.encode(words)
    assert time.process_time() - began < 4 and [x.tolist() for x in got] == [enc._core_bpe.encode_single_piece(w) for w in words]


class CountedTables:
    """A database that counts the tables given to it."""

    def __init__(self, db):
        self.db, self.n = db, 0

    def register(self, *a):
        self.n += 1
        return self.db.register(*a)

    def __getattr__(self, name):
        return getattr(self.db, name)


def test_bpe_known_words_are_not_coded_again(monkeypatch):
    """3 MB of distinct words, as a task has them, are coded once; what is kept is bounded and changes no result."""
    rnd = random.Random(9)
    words = list({" " + "".join(rnd.choice("aeiothnsr") for _ in range(9)) for _ in range(300_000)})
    part = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([words[k::3000] for k in range(3000)])], ["doc_id", "__words"])
    codec = byte_bpe.Codec(VOCAB)
    codec.db = CountedTables(codec.db)
    monkeypatch.setattr(byte_bpe, "codec", lambda path: codec)
    monkeypatch.setattr(byte_bpe, "split_words", lambda *a: types.SimpleNamespace(alias=lambda name: None))
    monkeypatch.setattr(byte_bpe, "F", types.SimpleNamespace(col=lambda name: None))
    kind = types.SimpleNamespace(dataType=types.SimpleNamespace(simpleString=lambda: "bigint"))
    docs = types.SimpleNamespace(select=lambda *a: docs, schema={"doc_id": kind}, mapInArrow=lambda f, schema: f)
    run = byte_bpe.encode_decode(docs, VOCAB, P.PATTERN)
    first = pa.Table.from_batches(run([part]))
    coded = codec.db.n
    assert coded > 0 and pa.Table.from_batches(run([part])).equals(first) and codec.db.n == coded
    enc = own_encoding()
    assert first.column("n_tokens").to_pylist() == [len(enc.encode_ordinary("".join(words[k::3000]))) for k in range(3000)]
    monkeypatch.setattr(byte_bpe, "MAX_BYTES", 2_000_000)
    for k in range(0, 3000, 500):
        assert pa.Table.from_batches(run([part.slice(k, 500)])).equals(first.slice(k, 500))
        assert len(codec.words) * byte_bpe.WORD_BYTES < 2_000_000 + 50_000 * byte_bpe.WORD_BYTES
    assert codec.db.n > coded


#: Tells the peak of what Arrow takes from it; it outlives all arrays.
POOL = pa.proxy_memory_pool(pa.default_memory_pool())


def test_bpe_memory_of_many_words(monkeypatch):
    """A worker's Arrow and NumPy memory beside the batch stays below 32 bytes for each of its words."""
    codec, default = byte_bpe.Codec(VOCAB), pa.default_memory_pool()
    codec.learn(pa.array([" a", " be"], pa.large_string()))
    monkeypatch.setattr(byte_bpe, "codec", lambda path: codec)
    monkeypatch.setattr(byte_bpe, "split_words", lambda *a: types.SimpleNamespace(alias=lambda name: None))
    monkeypatch.setattr(byte_bpe, "F", types.SimpleNamespace(col=lambda name: None))
    kind = types.SimpleNamespace(dataType=types.SimpleNamespace(simpleString=lambda: "bigint"))
    docs = types.SimpleNamespace(select=lambda *a: types.SimpleNamespace(schema={"doc_id": kind}, mapInArrow=lambda run, schema: run))
    run = byte_bpe.encode_decode(docs, VOCAB, P.PATTERN, with_ids=True)
    rows, n = 1500, 1000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(rows)), "__words": pa.array([[" a", " be"] * (n // 2)] * rows, pa.list_(pa.string()))})
    want = own_encoding().encode_ordinary(" a be" * (n // 2))
    pa.set_memory_pool(POOL)
    tracemalloc.start()
    try:
        total = 0
        for out in run(iter([batch.slice(100)])):  # from row 100: places within a larger array
            assert out.column("token_ids")[0].as_py() == want
            assert out.column("doc_id")[0].as_py() == 100 + total
            total += out.num_rows
        peak = POOL.max_memory() + tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(default)
    assert total == rows - 100
    assert peak < 32 * total * n


def test_bpe_equal_ranks_go_from_the_left(tmp_path):
    """Vocabularies at random, in which a token comes from several pairs and from tokens of higher rank."""
    rnd = random.Random(10)
    for n in range(8):
        tokens = list({bytes(rnd.choice(b"abc"[: 2 + n % 2]) for _ in range(rnd.randrange(2, 6))) for _ in range(60)})
        rnd.shuffle(tokens)
        ranks = {t: k for k, t in enumerate([*(bytes([b]) for b in range(256)), *tokens])}
        (tmp_path / f"{n}").write_text("".join(f"{base64.b64encode(t).decode()} {k}\n" for t, k in ranks.items()))
        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = [w for _ in range(300) if (w := bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 60)))) not in ranks]
        codec = byte_bpe.Codec(str(tmp_path / f"{n}"))
        got = codec.encode(words)
        assert [x.tolist() for x in got] == [enc._core_bpe.encode_single_piece(w) for w in words]
        assert codec.decode(got) == words


def test_bpe_empty_table(nothing):
    assert byte_bpe.encode_decode(nothing, VOCAB, P.PATTERN).count() == 0


# ---- n-gram Jaccard join ----


def near_rows(seed, groups=14, size=7):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("aeiou") + str(rnd.randrange(60))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(groups):
        own = [word() for _ in range(rnd.choice([3, 6, 30, 90, 160]))] + (passage if g % 2 else [])
        for _ in range(rnd.randrange(1, size)):
            w = list(own)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = word()
            rows.append((len(rows) + 1, " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_equals_all_pairs(spark, monkeypatch, small):
    if small:  # groups take many blocks, tasks emit often, many shingles are common
        for name, value in {"UNIT": 30, "_HOLD": 50, "LOCAL": 1, "COMMON": 3}.items():
            monkeypatch.setattr(jaccard_join, name, value)
    rows = near_rows(5 + small)
    got = jaccard_join.near_classes(spark.createDataFrame(rows, DOCS))
    want = plain.components(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == {(i, len(plain.shingles(t)), want[i]) for i, t in rows}


def test_jaccard_edges(edge_docs, edge_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_classes(edge_docs).collect()}
    want = plain.components(dict(edge_rows).items())
    assert got == {i: (len(plain.shingles(t)), want[i]) for i, t in edge_rows}


def test_jaccard_ends_when_every_long_list_is_closed(spark):
    """The only large group is 40 near copies that all link."""
    words = [f"w{k}" for k in range(100)]
    rows = [(k + 1, " ".join([*words[: 2 * k], f"own{k}", *words[2 * k + 1 :]])) for k in range(40)]
    got = jaccard_join.near_classes(spark.createDataFrame(rows, DOCS))
    assert {r.doc_id: r.component_id for r in got.collect()} == plain.components(rows)


def test_jaccard_sets_of_all_sizes_meet(spark, monkeypatch):
    """A group of sets of several sizes: 14 sets of 62 shingles and two of 65 that share 56."""
    monkeypatch.setattr(jaccard_join, "n_shuffle", lambda _: 97)  # with few partitions they may meet by chance
    words = [f"w{k}" for k in range(60)]
    rows = [(k + 1, " ".join([*words, *(f"own{k}-{j}" for j in range(6 if k < 14 else 9))])) for k in range(16)]
    got = jaccard_join.near_classes(spark.createDataFrame(rows, DOCS))
    assert {r.doc_id: r.component_id for r in got.collect()} == plain.components(rows)


@pytest.mark.parametrize("unit", [300, 2_000_000])
def test_jaccard_large_group_of_many_components(spark, monkeypatch, unit):
    """Near copies of one text that lie too far apart to link all, in blocks or in one; and an id with two texts."""
    monkeypatch.setattr(jaccard_join, "UNIT", unit)
    rnd = random.Random(unit)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(60)] = f"own{rnd.randrange(30)}"
        rows.append((k, " ".join(w)))
    got = jaccard_join.near_classes(spark.createDataFrame(rows, DOCS))
    want = plain.components(rows)
    assert len(set(want.values())) > 3
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    two = [(5, "a b c d e f g"), (7, "a b c d e f g"), (7, "h i j k l m n"), (6, "h i j k l m n")]
    assert {(r.doc_id, r.component_id) for r in jaccard_join.near_classes(spark.createDataFrame(two, DOCS)).collect()} == {(5, 5), (7, 5), (6, 5)}


def test_jaccard_null_ids_and_empty_table(spark, nothing):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "lonely"), (2, "A b c d e f")]
    assert rows_of(jaccard_join.near_classes(spark.createDataFrame(rows, DOCS)), "doc_id", "component_id") == sorted([(None, 2), (4, 2), (None, None), (2, 2)], key=repr)
    assert jaccard_join.near_classes(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1), st.lists(st.sets(st.integers(0, 40), min_size=1), max_size=12))
def test_divide_skip_equals_counting(query, others):
    got = jaccard_join.divide_skip(np.array(sorted(query), np.uint64), [np.array(sorted(o), np.uint64) for o in others])
    assert got == [k for k, o in enumerate(others) if 100 * len(query & o) >= 75 * len(query | o)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99)], "a long, b long")
    got = {r.node: r.root for r in jaccard_join.components(edges, common.shared_dir(spark)).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99}


# ---- context-tree scoring ----


def plain_scores(rows, depth):
    """Context-tree weighting with dictionaries and recursion."""
    end = b"\n"
    norm = [b" ".join(w.encode() for w in plain.WORD.findall(plain.lower(t))) + end for _, t in rows]
    train = [n for n, (i, _) in zip(norm, rows, strict=True) if not tree_score.held_out(i)]
    counts = collections.defaultdict(lambda: [0, 0])

    def decisions(text):
        data = end * depth + text
        for k in range(depth, len(data)):
            for j in range(8):
                yield data[k - depth : k], (1 << j) | (data[k] >> (8 - j)), data[k] >> (7 - j) & 1

    kids = collections.defaultdict(set)
    for t in train:
        for ctx, node, bit in decisions(t):
            for d in range(depth + 1):
                counts[ctx[depth - d :], node][bit] += 1
                if d:
                    kids[ctx[depth - d + 1 :], node].add(ctx[depth - d :])
    lg = math.lgamma
    kt = lambda c: lg(c[0] + 0.5) + lg(c[1] + 0.5) - lg(c[0] + c[1] + 1) - math.log(math.pi)
    memo = {}

    def weighted(ctx, node):
        if (ctx, node) not in memo:
            own = kt(counts[ctx, node])
            if len(ctx) < depth:
                below = sum(weighted(c, node) for c in kids[ctx, node])
                own = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            memo[ctx, node] = own
        return memo[ctx, node]

    def prob(ctx, node, bit, d):
        c = counts.get((ctx[depth - d :], node))
        if c is None or not sum(c):
            return None
        own = (c[bit] + 0.5) / (sum(c) + 1)
        deeper = prob(ctx, node, bit, d + 1) if d < depth else None
        if deeper is None:
            return own
        stop = math.exp(kt(c) + math.log(0.5) - weighted(ctx[depth - d :], node))
        return stop * own + (1 - stop) * deeper

    return [sum(math.log10(prob(c, n, b, 0) or 0.5) for c, n, b in decisions(t)) for t in norm]


def test_tree_scores_equal_the_plain_tree(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "That", "sat", "on", "mats"]) for _ in range(rnd.randrange(25)))) for i in range(40)] + [(90, None), (91, "unseen é words")]
    want = plain_scores(rows, tree_score.DEPTH)
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in tree_score.score_texts(df).collect()}
    assert [got[i].score for i, _ in rows] == pytest.approx(want, rel=1e-9)
    tok = lambda t: [*plain.WORD.findall(plain.lower(t)), None]
    c = collections.Counter(w for i, t in rows if not tree_score.held_out(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tok(t)), sum(c[w] > 0 for w in tok(t)), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)))
    monkeypatch.setattr(tree_score, "CHUNK_BYTES", 150)  # many chunks and slots, and small blocks of the tree, give the same
    monkeypatch.setattr(tree_score, "SLOTS", 2)
    monkeypatch.setattr(tree_score, "BLOCK_GRAMS", 20)
    again = {r.doc_id: r for r in tree_score.score_texts(df).collect()}
    assert [again[i].score for i, _ in rows] == pytest.approx(want, rel=1e-9)
    assert [again[i].n_known for i, _ in rows] == [got[i].n_known for i, _ in rows]


def test_end_token_is_no_word():
    words = [b"\0end", b"end", b"x"]
    keys, lens = tree_score.token_keys([b" ".join(words), b""])
    assert lens.tolist() == [4, 1] and keys[3] == keys[4] and keys[3] not in keys[:3]


def test_repeated_rows_each_have_a_score(spark):
    rows = [(1, "one two"), (1, "one two"), (2, "two"), (2, "two"), (2, "two")]
    out = tree_score.score_texts(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in out) == [1, 1, 2, 2, 2] and len({(r.doc_id, r.score) for r in out}) == 2


def test_tree_counts_and_packing():
    rng = np.random.default_rng(4)
    for size in (1, 7, 70_000, 200_000):
        grams = rng.integers(0, 1 << 48, size // 3 + 1)[rng.integers(0, size // 3 + 1, size)]
        train = rng.random(size) < 0.7
        k, n = tree_score._gram_counts(grams, train)
        want = collections.Counter(grams[train].tolist())
        assert k.tolist() == sorted(set(grams.tolist())) and n.tolist() == [want[g] for g in k.tolist()]
        assert tree_score._look_up(k, k.astype(float), grams).tolist() == grams.astype(float).tolist()
        hashes = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, size))
        assert tree_score._unpack_keys(tree_score._pack_keys(hashes)).tolist() == hashes.tolist()


def test_tree_scores_edges(spark, edge_docs, edge_rows, nothing):
    got = tree_score.score_texts(edge_docs).collect()
    assert {r.doc_id for r in got} == {i for i, _ in edge_rows}
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert tree_score.score_texts(nothing).count() == 0
    assert tree_score.score_texts(spark.createDataFrame([(None, "a"), (None, None)], DOCS)).count() == 2


# ---- token files ----


def test_token_files_round_trip(spark, edge_docs, edge_rows, tmp_path):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    files = token_files.write_tokens(edge_docs, P.path("word_bpe_49k.json"), f"file://{tmp_path}/t", length=64)
    files = common.staged(files, f"file://{tmp_path}/files")
    got = token_files.read_documents(spark, files).orderBy("start").collect()
    start = 0
    assert [r.doc_id for r in got] == sorted(i for i, _ in edge_rows)
    text = dict(edge_rows)
    stream = []
    for r in got:
        ids = [*tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    read = []
    for f in sorted(files.collect()):
        reader = token_files.Reader(f.ids_path)
        for k in range(len(reader)):
            ids, mask = reader[k]
            assert len(ids) == len(mask) == 64
            read += ids[mask].tolist()
    assert read == stream
    assert not reader.batches[0].column("ids").flatten().to_numpy().flags.owndata  # a view of the mapped file


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_token_files_partitions_ascend(spark, n):
    """Ids ascend over the partitions, and an id that fills several is spread over them."""
    rnd = random.Random(n)
    rows = [(rnd.choice([None, 5, 5, 5, rnd.randrange(1000)]), f"text {k}") for k in range(2000)]
    got = token_files._dealt(spark.createDataFrame(rows, "id long, text string"), n).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(((r.id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
    low = lambda i: -(2**63) if i is None else i
    ends = {}
    for r in got:
        a, b = ends.get(r.p, (low(r.id), low(r.id)))
        ends[r.p] = min(a, low(r.id)), max(b, low(r.id))
    spans = [ends[p] for p in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    if n >= 7:
        assert max(sum(r.p == p for r in got) for p in ends) < 2.5 * 2000 / n + 100


def test_token_files_null_ids_and_empty_table(spark, nothing, tmp_path):
    df = spark.createDataFrame([(None, "b"), (1, None), (None, "a")], DOCS)
    files = common.staged(token_files.write_tokens(df, P.path("word_bpe_49k.json"), f"file://{tmp_path}/a"), f"file://{tmp_path}/fa")
    assert [r.doc_id for r in token_files.read_documents(spark, files).orderBy("start").collect()] == [None, None, 1]
    files = common.staged(token_files.write_tokens(nothing, P.path("word_bpe_49k.json"), f"file://{tmp_path}/b"), f"file://{tmp_path}/fb")
    assert token_files.read_documents(spark, files).count() == 0


# ---- decontamination ----


def test_leaks_equal_all_alignments(spark, edge_docs):
    rnd = random.Random(3)
    items = [(k, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rnd.randrange(30)) for _ in range(12))) for k in range(5)] + [(7, None), (8, ""), (9, "short")]
    docs = []
    for d in range(40):
        x = list(rnd.choice(items[:5])[1])
        for _ in range(rnd.randrange(14)):
            j = rnd.randrange(len(x))
            x[j : j + rnd.randrange(2)] = rnd.choice(["", "q", " z"])
        docs.append((d, "some words before\n" * rnd.randrange(3) + "".join(x).upper() + " and after"))
    docs += [(50, None), (51, "")]
    want = set()
    for i, t in items:
        t = decontaminate.normal(t)
        k = min(int(0.1 * len(t)), (len(t) - 8) // 8)
        want |= {(d, i, e) for d, x in docs if len(t) >= 8 and (e := plain.edits(t, decontaminate.normal(x))) <= k}
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontaminate.find_leaks(df, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_leaked(df, bench).collect()} == {d for d, _ in docs} - {d for d, _, _ in want}
    assert decontaminate.drop_leaked(edge_docs, bench).schema == edge_docs.schema


def test_leaks_in_blocks_and_pieces_and_empty(spark, nothing, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    rnd = random.Random(4)
    long = " ".join("w" + str(rnd.randrange(10**6)) for _ in range(300))
    bench = spark.createDataFrame([(1, long), (2, "another passage of the benchmark that is fairly long"), (3, "yet another one which is not in any of them")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x " + long[700:1500]), (2, "clean text of no importance whatsoever"), (3, "see: another passage of the Benchmark that is\n fairly long.")], DOCS)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()} == {(1, 1), (3, 2)}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaked(df, bench.limit(0)).count() == 3
    assert decontaminate.find_leaks(nothing, bench).count() == 0


@pytest.mark.parametrize("size", [5, 8, 511, 512, 513, 1500])
@pytest.mark.parametrize("window", [None, 512])
def test_leaks_of_texts_of_every_length(size, window):
    """Against all alignments: whole texts, or any of their windows."""
    rnd = random.Random(size)
    words = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(100)) for _ in range(n))
    item = words(600)[:size].strip().ljust(size, "x") if size > 8 else "ab cd"[:size].ljust(size, "y")
    texts = [words(20) + " " + item + " " + words(20), words(300), words(9) + " " + item[: len(item) // 2], item, "x" + item + "x", words(3) + " " + item[: size - size // 15]]
    got = {(o, i): e for o, i, e in decontaminate.Index([(4, item), (5, "")], 0.1, window).find(texts)}
    want = {}
    if size < decontaminate.Q:
        want = {(o, 4): 0 for o, t in enumerate(texts) if f" {item} " in f" {t} "}
    else:
        m = min(window or size, size)
        k = min(int(0.1 * m), (m - 8) // 8)
        for o, t in enumerate(texts):
            for at in sorted({*range(0, size - m, m // 8), size - m}):
                e = plain.edits(item[at : at + m], t)
                if e <= k:
                    want[o, 4] = min(e, want.get((o, 4), e))
    assert got == want and (0, 4) in got and (1, 4) not in got


def test_leak_index_of_long_texts_is_small():
    import tracemalloc

    rnd = np.random.RandomState(1)
    items = [(k, "".join(map(chr, rnd.randint(97, 122, 5000)))) for k in range(100)]
    tracemalloc.start()
    index = decontaminate.Index(items, 0.1, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.m) == 100 and peak < 4 * (1 << 20) + 75 * 500_000  # a block of 2,000,000 characters: about 150 MB


# ---- HTML ----


def test_html_layout():
    html = """<head><title>no</title></head><h1>Top  <b>line</b></h1><p>one<p>two <br>three<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>
    <table><tr><th>Name<th>Qty<tr><td>apples &amp; pears<td>3<tr><td colspan=2>wide</table><pre>  k
   j</pre><div style="display: none">no</div><span hidden>no</span>end<script>var t="</p>";</script> after<!-- no -->"""
    assert page_text(html) == (
        "Top line\n\none\n\ntwo\nthree\n\n- a\n- b\n   3. x\n   4. y\n- c\n\nName           | Qty\napples & pears | 3\nwide\n\n  k\n   j\n\nend after"
    )


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/= \"'abdilprtuv&;!-\n", max_size=120))
def test_html_never_fails(source):
    assert isinstance(page_text(source), str)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><thead><th>A<th>B</thead><tbody><td>x</td><td>y</td></tbody></table>", "A | B\nx | y"),
        ("<table><td>x<td>y<tr><td>z</table>", "x | y\nz"),
        ("<table><tr><form action=a><td>x</td><td>y</td></form></tr></table>", "x | y"),
        ("<table><tr><div><td>x</td></div></tr></table>", "x"),
        ("<div><table><tbody>one<tr><p>two</p><td>x</td></tr></tbody></table></div>", "one\n\ntwo\n\nx"),
        ("<table><caption>top<tr><td>x<table><td>in</table></table>", "top\nx\n\nin"),
    ],
)
def test_html_tables_lose_nothing(html, text):
    assert page_text(html) == text


def test_html_gives_all_text_of_any_tags():
    """Random tags, none of them hidden: every text comes out."""
    rnd = random.Random(11)
    names = "table thead tbody tfoot tr td th caption colgroup col form div p b ul li select option center h1 q dl dd pre span a".split()
    for _ in range(3000):
        parts = [f"<{rnd.choice(['', '', '/'])}{rnd.choice(names)}>" if rnd.random() < 0.75 else f" w{k}z " for k in range(rnd.randrange(4, 40))]
        source = "".join(parts)
        text = page_text(source)
        assert [w for w in source.replace("<", " <").split() if w[0] == "w" and w not in text] == [], source


@pytest.mark.parametrize("style", ["backface-visibility: hidden", "-webkit-backface-visibility:hidden;color:red", "x-display:none", "display:none;display:block", "display:block!important;display:none", "background:url('a;display:none')", "/*display:none*/", "overflow:hidden"])
def test_html_styles_that_hide_nothing(style):
    assert page_text(f'<div style="{style}">shown</div>end') == "shown\nend"


@pytest.mark.parametrize("style", ["display:none", "color:red; DISPLAY : None ", "visibility:hidden", "visibility:collapse", "display:none!important;display:block", "display:/**/none", "background:url(a;b);display:none"])
def test_html_styles_that_hide(style):
    assert page_text(f'<div style="{style}">not</div>end') == "end"


def test_html_renders_svg_and_math():
    assert page_text("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b") == "a x=1 b"
    assert page_text("<svg><title>no</title><desc/><style>no</style><text>one</text><text>two</text><path d=m /><desc>no</desc></svg>end") == "one two end"
    assert page_text("<svg><foreignObject><p>in</p><desc>it</desc></foreignObject><script href=x /></svg>end") == "in\n\nitend"


def test_html_edges(spark):
    rows = [(1, None, "t"), (2, "", None), (3, "<div>" * 30_000 + "deep", "t"), (4, "a < b & c &bogus; <", "t"), (None, "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "t"), (6, "<p>x</div></p></table>y", "t")]
    out = extract_text(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert {r.page_id: r.text for r in out.collect()} == {1: "", 2: "", 3: "deep", 4: "a < b & c &bogus; <", None: "a | b\n  | c", 6: "x\n\ny"}
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


# ---- chats ----


def chat_expectation(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t), r or "", x or ""))
    out = {}
    for c, ts in by.items():
        ts = sorted(ts)
        out[c] = ([(r, x) for _, r, x in ts], "".join(x for _, r, x in ts if r == "assistant"))
    return out


def chats(seed=1):
    rnd = random.Random(seed)
    odd = ["", None, "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a\\b <\\\\| <", "|>\n<|", "é 日本 " * 9]
    rows = []
    for c in range(25):
        first = int(c % 3 == 0)
        rows += [(c, 0, "system", "be brief " * rnd.randrange(9))] * first
        rows += [(c, k + 1, "user" if k % 2 == 0 else "assistant", rnd.choice(odd + [" ".join(["w"] * rnd.randrange(60))] * 4)) for k in range(rnd.randrange(14))]
    return rows + [(None, None, None, None), (30, 1, "assistant", "tie"), (30, 1, "assistant", "tie"), (30, None, "we%ird\n<role", "x"), (31, 0, "system", "alone"), (32, 0, "user", "v " * 5000)]


@pytest.mark.parametrize("budget", [40, 512])
def test_chats_read_back(spark, budget):
    rows = chats()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.format_chats(df, budget=budget, history_budget=budget // 4)
    back = {r.conv_id: r for r in chat_format.read_chats(windows).collect()}
    want = chat_expectation(rows)
    assert set(back) == set(want)
    for c, (turns, loss) in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == turns
        assert back[c].loss_text == loss
    lens = {r.conv_id: r.n for r in windows.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n")).collect()}
    assert {c: b.formatted_chars for c, b in back.items()} == lens


def test_chats_windows_keep_system_and_budget(spark):
    rows = [(1, 0, "system", "s s s")] + [(1, k, "user" if k % 2 else "assistant", "w " * 10) for k in range(1, 20)]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=80, history_turns=2, history_budget=30).orderBy("window").collect()
    assert len(got) > 3
    for r in got:
        assert r.text.startswith("<|im_start|>system\ns s s<|im_end|>\n")
        assert len(plain.WORD.findall(r.text)) <= 80
        assert (r.n_repeated > 1) == (r.window > 0)
        spans = [r.text[m.start : m.start + m.len] for m in r.loss]
        assert all(s == "w " * 10 for s in spans)
        assert len(spans) == r.text.count("<|im_start|>assistant") - sum(x.startswith("assistant") for x in r.text.split("<|im_start|>")[1 : r.n_repeated + 1])


def test_chats_empty(spark):
    assert chat_format.read_chats(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---- URLs ----


URLS = ["http://WWW.Example.com/en/x", "https://a.b.net/es/1?q=/fr/", "ftp://net/fr/", "http://notnet/es/", "x", None, "", "http://", "http://com", "http://com/", "http://a.com?x", "http://example.com/en", "http://example.com/en/#t", "http://x.example.com/en/deep/er", "://h.net/es/", "http://a..com/", "http://a.org/en/"]


@pytest.mark.parametrize("max_broadcast", [100_000, 0])
def test_urls_equal_plain_rules(spark, max_broadcast):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("b.net", "/es/1", "allow"), (None, "/", "block"), ("org", None, "block"), ("org", "/", None), ("example.com", "/en/", "block")]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(URLS * 2)] + [(None, URLS[0], None)], "page_id long, url string, host string")

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, after = plain.lower(rest[:cut]), rest[cut:]
        path = after[: min((after.find(c) for c in "?#" if c in after), default=len(after))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and p and v and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    got = url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), max_broadcast=max_broadcast)
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted([(k, *want(u)) for k, u in enumerate(URLS * 2)] + [(None, *want(URLS[0]))], key=repr)


def test_urls_empty(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    assert [r.verdict for r in url_rules.judge_urls(pages, none).collect()] == ["allow"]
    assert url_rules.judge_urls(pages.limit(0), none).count() == 0


# ---- quality rules ----


def test_stats_equal_plain(edge_docs, edge_rows):
    got = rows_of(quality_rules.text_stats(edge_docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted([(i, *plain.stats(t)) for i, t in edge_rows], key=repr)


def test_rules_learn_held_out_documents(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    good = lambda: " ".join(word() for _ in range(120))
    junk = lambda: " ".join(word() + rnd.choice(["***", "###"]) for _ in range(120))
    loud = lambda: " ".join(word().upper() for _ in range(120))
    rows = [(i, [good, good, good, junk, loud][i % 5]()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 < 3)) for i in range(200)] + [(0, None), (999, 0), (None, 1)], "doc_id long, quality int")
    df = spark.createDataFrame(rows + [(400, "too short"), (401, None), (402, "la la la " * 60)], DOCS)
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(df, labels).collect()}
    assert all(got[i] == (False, i % 5 < 3) for i in range(300))
    assert got[400] == got[401] == got[402] == (True, False)
    kept = quality_rules.keep_good(df.withColumn("kept", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "kept"] and {r.doc_id for r in kept.collect()} == {i for i in range(300) if i % 5 < 3}


def test_rules_edges(spark, edge_docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.keep_good(edge_docs, none).columns == edge_docs.columns
    assert quality_rules.judge(nothing, none).count() == 0
    assert quality_rules.fit_rules({"a": np.zeros(0)}, np.zeros(0, bool)) == []


# ---- SQL ----


def test_oracles_run_on_duckdb(tmp_path):
    from strideframe.llm.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert duckdb.sql("select 1").fetchall() == [(1,)]


# ---- HTML, against a second parser ----


class Texts(html.parser.HTMLParser):
    """All text outside hidden elements, by the standard library's parser and a plain stack."""

    def __init__(self):
        super().__init__()
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag not in html_text.VOID:
            self.stack.append((tag, tag in html_text.HIDDEN or "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()))
        if tag in html_text.BLOCK or tag in ("br", "td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass
        if tag in html_text.BLOCK or tag in ("td", "th"):
            self.out.append(" ")

    def handle_data(self, data):
        if not any(h for _, h in self.stack):
            self.out.append(data)


def test_every_visible_word_of_the_pages_comes_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    marks = re.compile(r"-|\||[0-9]+\.")
    texts = {r.page_id: r.text for r in extract_text(pages.select("page_id", "html")).collect()}
    for r in pages.collect():
        p = Texts()
        p.feed(r.html or "")
        p.close()
        keep = lambda words: collections.Counter(w for w in words if not marks.fullmatch(w))
        assert keep(plain.WORD.findall("".join(p.out))) == keep(plain.WORD.findall(texts[r.page_id])), r.page_id


@pytest.mark.parametrize("source", ["<a " * 200_000, "<a '" * 200_001 + ">", '<a "<a" ' * 200_000 + '"', "<a " * 200_000 + "'>", "<div>" * 20_000 + "</span>" * 20_000, "<!--" * 200_000])
def test_broken_pages_are_read_in_one_pass(source):
    began = time.time()
    html_text.page_text(source)
    assert time.time() - began < 10


@pytest.mark.parametrize("head, many", [("<span><table><tr><td>", ("<b>", "</span>")), ("<dd><dl>", ("<b>", "<dt></dt>")), ("<table><tr><td>", ("<b>", "<table></table>")), ("<svg>", ("<g>", "<path/>")), ("<table>", ("x<tr>",))])
def test_deep_pages_are_read_in_one_pass(head, many):
    """A page of about 1 MB, whose open elements are not walked for each tag."""
    began = time.time()
    html_text.parse(head + "".join(x * 80_000 for x in many))
    assert time.time() - began < 5


def test_what_browsers_hold_back():
    assert page_text("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>") == "漢kan"
    assert page_text("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"
    assert page_text("<details><summary>S</summary>more<summary>x</summary></details><details open><summary>T</summary>seen</details>") == "S\nT\nseen"
    assert page_text("<table><tr><td>漢字</td><td>a</td></tr><tr><td>abcd</td><td>b</td></tr><tr><td>e\u0301</td><td>c</td></tr></table>").split("\n") == ["漢字 | a", "abcd | b", "e\u0301    | c"]


def test_inherited_visibility():
    assert html_text.page_text("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>") == "yes"
    assert html_text.page_text("<table style='visibility:collapse'><tr><td>a</td><td style='visibility:visible'>b</td></tr></table>").split() == ["|", "b"]
    assert html_text.page_text("<p style='display:none'>a<b style='visibility:visible'>b</b></p>c") == "c"


# ---- the queries themselves ----


@pytest.mark.parametrize("name, table, key", [("op1", "documents", "doc_id"), ("op2", "documents", "doc_id"), ("op5", "documents", "doc_id"), ("op8", "conversations", "conv_id"), ("op10", "documents", "doc_id")])
def test_queries_return_a_row_for_each_key(spark, name, table, key):
    from strideframe.llm import queries

    query = next(f for n, f in queries.QUERIES.items() if n.startswith(name + "_"))
    rows = [r[key] for r in query(spark, "/root/testdata/sf0.001").select(key).collect()]
    want = {r[0] for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(key).collect()}
    assert len(rows) == len(set(rows)) and set(rows) - {-1} == want
