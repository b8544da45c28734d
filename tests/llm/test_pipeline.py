import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from strideframe.llm import decontaminate
from strideframe.llm.byte_bpe import load_ranks

from . import plain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(2, 9)))
    text = lambda n=150: "\n".join(" ".join(word() for _ in range(10)) for _ in range(n // 10))
    passage = " ".join(word() for _ in range(40))
    line = "a line of licence text that many documents share"
    docs = []
    for i in range(60):
        t = text()
        if i % 10 == 3:
            t = " ".join(w + "***" for w in t.split())
        if i % 10 == 5:
            t += "\n" + line
        if i % 20 == 7:
            t += "\n" + passage
        docs.append(t)
    docs[21] = docs[20] + " extra"
    docs[22] = docs[20].replace(" ", "  ", 1)
    rows = [(i, t, "en", None if i % 4 else "src0", len(t)) for i, t in enumerate(docs)] + [(90, None, None, None, None), (91, "short", "en", "s", 5)]
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, passage


def test_stages_and_result(spark, corpus):
    root, rows, passage = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]
    left = [(i, t) for i, t, *_ in rows if i < 60 and i % 10 != 3]
    left = [(i, t) for i, t, _, _ in plain.line_dedup(left)]
    group = plain.components(left)
    left = [(i, t) for i, t in left if group[i] == i]
    left = [(i, t) for i, t in left if decontaminate.normal(passage) not in decontaminate.normal(t)]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.token_ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, root).collect()}
    assert got == {i: (enc.encode_ordinary(t), plain.sha(t)) for i, t in left}


def test_stages_keep_columns_and_take_empty_tables(spark, corpus):
    root, _, _ = corpus
    docs = spark.createDataFrame([], COLUMNS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        assert out.count() == 0
        if k < 4:
            assert out.columns == docs.columns
