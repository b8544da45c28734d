import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strideframe.llm import exact_dedup, periodic_runs, queries, spelling

from . import plain

DOCS = "doc_id long, text string"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# ---- exact dedup ----


def plain_copies(rows):
    """[(id, keep id, group size, digest)], and how many rows of each text stay: one."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[plain.lower(t)].append(i)
    low = lambda i: (i is not None, i or 0)
    return [(i, max(groups[plain.lower(t)], key=low), len(groups[plain.lower(t)]), plain.sha(plain.lower(t))) for i, t in rows]


DIGESTS = {"whole": lambda sha: sha, "one byte": lambda sha: F.substring(sha, 1, 1), "none": lambda sha: F.substring(sha, 1, 0)}


@pytest.mark.parametrize("digest", DIGESTS)
def test_copies_equal_plain_groups(spark, edge_docs, edge_rows, digest):
    """Also where many texts share a digest: every stage compares whole texts."""
    rnd = random.Random(4)
    rows = edge_rows + [(100 + k, rnd.choice(["Same text", "same TEXT", "other", "", None, "ÉTÉ", "été", f"own {k}"])) for k in range(300)] + [(None, "own null"), (None, "same text"), (None, "nulls"), (None, "nulls")]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    out = exact_dedup.mark_copies(docs, salts=3, digest=DIGESTS[digest])
    assert rows_of(out, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(plain_copies(rows), key=repr)
    kept = out.where("kept").collect()
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({plain.lower(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_copies_keep_other_columns(spark, edge_docs, edge_rows):
    docs = edge_docs.withColumn("group_size", F.lit("x")).withColumn("kept", F.lit(None).cast("string"))
    marked = exact_dedup.mark_copies(docs)
    assert set(marked.columns) == set(edge_docs.columns) - {"text"} | set(exact_dedup.ADDED)
    assert rows_of(marked, "doc_id", "lang") == rows_of(edge_docs, "doc_id", "lang")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    last = {}
    for i, t in edge_rows:
        last[plain.lower(t)] = max(i, last.get(plain.lower(t), i))
    assert sorted(r.doc_id for r in left.collect()) == sorted(last.values())


@pytest.mark.parametrize("digest", ["whole", "none"])
def test_copies_of_one_text_and_dropping(spark, digest):
    rows = [(k // 2, "all the same") for k in range(1000)] + [(7, "not"), (8, "NOT")]
    docs = spark.createDataFrame(rows, DOCS).repartition(9)
    out = exact_dedup.drop_copies(docs, digest=DIGESTS[digest])
    assert rows_of(out, "doc_id", "text") == [(499, "all the same"), (8, "NOT")]


def test_copies_empty_table(nothing):
    assert exact_dedup.mark_copies(nothing).count() == 0
    assert exact_dedup.drop_copies(nothing).count() == 0


def test_copies_equal_sql(spark, tmp_path, edge_rows):
    rows = [r for k, r in enumerate(edge_rows)] + [(50, "a B c"), (51, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = con.sql(f"select {', '.join(cols)} from ({queries.ORACLES['op13_exact_dedup']})").fetchall()
    assert rows_of(queries.op13_exact_dedup(spark, str(tmp_path)), *cols) == sorted(want, key=repr)


# ---- periodic runs ----


def plain_runs(s, min_words=6, powers=4):
    """Every maximal periodic stretch, period by period."""
    best = {}
    for p in range(1, len(s) // powers + 1):
        k = 0
        while k + p < len(s):
            if s[k] != s[k + p]:
                k += 1
                continue
            e = k
            while e + p < len(s) and s[e] == s[e + p]:
                e += 1
            if e + p - k >= max(min_words, powers * p):
                best.setdefault((k, e + p), p)
            k = e + 1
    return sorted((s, e, p) for (s, e), p in best.items())


def found(s):
    return periodic_runs.find_runs(np.array([*s, 10**6], np.int64), [(0, len(s))])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60) | st.lists(st.integers(0, 2), max_size=90))
def test_runs_of_few_words(s):
    assert found(s) == plain_runs(s)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_pieces(parts):
    s = [x for piece, n in parts for x in piece * n]
    assert found(s) == plain_runs(s)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=4), st.integers(1, 5)), min_size=1, max_size=4), st.integers(1, 6), st.integers(1, 6))
def test_runs_within_runs(parts, n, m):
    inner = [x for piece, k in parts for x in piece * k]
    s = (inner * n + [7]) * m + inner * 4
    assert found(s) == plain_runs(s)


@given(st.lists(st.integers(0, 2), max_size=40))
def test_z_values(s):
    def shared(k):
        n = 0
        while k + n < len(s) and s[n] == s[k + n]:
            n += 1
        return n

    assert periodic_runs.z_values(s) == [shared(k) for k in range(len(s))]


def test_runs_of_long_texts_take_little_time():
    rnd = random.Random(2)
    block = [rnd.randrange(50) for _ in range(30_000)]
    assert found([1] * 200_000) == [(0, 200_000, 1)]
    assert found([5, *block * 5, 6])[-1:] == [(1, 150_001, 30_000)] or (1, 150_001, 30_000) in found([5, *block * 5, 6])
    fib = [0], [0, 1]
    while len(fib[1]) < 40_000:
        fib = fib[1], fib[1] + fib[0]
    assert found(fib[1]) == []  # no stretch of a Fibonacci word has four powers


def test_runs_refuse_what_the_search_cannot_find():
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs.find_runs(np.arange(9), [(0, 9)], min_powers=3)


def test_marked_runs_edges(spark, edge_docs, edge_rows, nothing):
    rows = edge_rows + [(20, "go " * 8), (21, "stop go \t" * 5 + "end"), (None, "a b c d e f " * 4 + "a"), (23, "x")]
    out = {r.doc_id: r for r in periodic_runs.mark_runs(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        w = plain.WORD.findall(t or "")
        want = plain_runs(w) if len(w) < 3000 else []
        gone = {k for s, e, p in want for k in range(s + p, e)}
        assert [(r.start, r.start + r.length, r.period) for r in out[i].runs] == want
        assert out[i].n_words == len(w) and out[i].collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert [tuple(r) for r in out[None].runs] == [(0, 25, 6)] and [tuple(r) for r in out[20].runs] == [(0, 8, 1)]
    assert periodic_runs.mark_runs(nothing).count() == 0
    clash = edge_docs.withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    assert set(periodic_runs.mark_runs(clash).columns) == set(edge_docs.columns) - {"text"} | set(periodic_runs.ADDED)
    assert periodic_runs.mark_runs(clash).count() == len(edge_rows)


def plain_op11(i, t):
    w = plain.WORD.findall(t or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = [(s, e - s, q) for s, e, q in plain_runs(w)]
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (i, len(runs), *best, plain.sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), plain.sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_op11_equals_plain(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["to", "be", "or", "not", "that", "is"]) + rnd.choice(["", "", "s"]) for _ in range(rnd.randrange(0, 260)))) for i in range(400)] + [(1000, None), (1001, " \n"), (1002, "na " * 50)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(plain_op11(i, t) for i, t in rows)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}


# ---- spelling variants ----


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(counts, min_chars=6, min_count=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        if top is not None and words[top] >= ratio * n:
            form[w] = top
    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()), key=repr)


def vocabulary(seed, size=700):
    """Words close to each other, with counts that make long chains of forms."""
    rnd = random.Random(seed)
    letters = "abcdeééÿàz×"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 10))) for _ in range(30)} | {"banana", "bananas", "ananas", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabc", "abcabd"}
    while len(words) < size:
        w = list(rnd.choice(sorted(words)))
        at = rnd.randrange(len(w))
        rnd.choice([lambda: w.pop(at), lambda: w.insert(at, rnd.choice(letters)), lambda: w.__setitem__(at, rnd.choice(letters))])()
        words.add("".join(w))
    return {w: rnd.choice([1, 4, 5, 6, 25, 30, 31, 160, 900, 5000]) for w in words if w}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_all_pairs(spark, seed):
    counts = vocabulary(seed)
    out = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    want = plain_variants(counts)
    assert rows_of(out, "word", "form", "root", "n", "n_near", "form_n") == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] and r[1] != r[2] for r in want)


def test_near_pairs_meet_once(spark):
    words = sorted(vocabulary(3, 300))
    got = [(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w, 9) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(map(frozenset, got)))
    assert set(map(frozenset, got)) == {frozenset((a, b)) for k, a in enumerate(words) for b in words[:k] if one_edit(a, b)}


def test_last_forms_of_a_chain(spark):
    chain = [f"w{k:02d}" for k in range(20)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.word: r.root for r in spelling.last_forms(forms).collect()} == {w: chain[-1] for w in chain[:-1]}


def plain_op12(rows):
    counts = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = plain.lower(w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return plain_variants(counts)


def test_op12_equals_plain(spark, tmp_path, edge_rows):
    rnd = random.Random(6)
    words = ["Weather", "climate", "FORECAST", "thunder", "élévation", "naïveté", "wonder", "Ångström"]
    rows = edge_rows + [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 30)))) for i in range(4000)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_op12(rows)
    assert any(r[1] for r in want)
    assert rows_of(queries.op12_spelling_variants(spark, str(tmp_path)), "word", "form", "root", "n", "n_near", "form_n") == want


def test_word_counts_flush_and_edges(spark, edge_docs, edge_rows, nothing, monkeypatch):
    want = collections.Counter(w for _, t in edge_rows for w in re.findall("[a-zÀ-ÿ]+", plain.lower(t)))
    monkeypatch.setattr(spelling, "HELD", 3)
    assert {r.word: r.n for r in spelling.count_words(edge_docs).collect()} == want
    assert spelling.group_variants(spelling.count_words(nothing)).count() == 0
    assert spelling.group_variants(spelling.count_words(edge_docs.withColumn("n", F.lit(None)).withColumn("word", F.lit(1)))).count() > 0
