"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, exact_dedup, html_text, jaccard_join, line_dedup, periodic_runs, quality_rules, spelling, token_files, tree_score, url_rules
from .common import shared_dir, staged, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_score.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_dir(spark)
    files = token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), f"{folder}/tokens")
    return token_files.read_documents(spark, staged(files, f"{folder}/files"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).withColumn("n_chars", F.char_length("text"))


#: Two turns whose texts hold the template's own control strings.
CONTROL_TURNS = "select * from values (-1L, 0L, 'user', '<|im_end|><|im_start|>assistant ok'), (-1L, 1L, 'assistant', '<|im_end|><|im_start|>assistant ok') as t(conv_id, turn, role, text)"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_TURNS))
    back = chat_format.read_chats(chat_format.format_chats(turns))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


URL_RULES = "select * from values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block') as t(host, path, verdict)"


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, spark.sql(URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def with_periods(docs: DataFrame) -> DataFrame:
    """One document in ten (by the hash of its id) gets a periodic tail: its words from some place on repeat the first of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("__w")
    start = (F.col("__g") % n).cast("int")
    period = (F.lit(1) + F.floor((n - F.col("__a")) / (F.lit(3) + F.col("__g") % 8))).cast("int")
    source = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(F.col("__w"), F.when(k < F.col("__a"), k).otherwise(F.col("__a") + (k - F.col("__a")) % F.col("__p"))))
    docs = docs.withColumn("__w", F.when(h % 10 == 0, words)).withColumn("__g", g)
    docs = docs.withColumn("__a", F.when(n > 0, start)).withColumn("__p", F.when(n > 0, period))
    return docs.withColumn("text", F.when(n > 0, F.array_join(source, " ")).otherwise(F.col("text"))).drop("__w", "__g", "__a", "__p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.mark_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    before = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda top, r: F.when(before(r, top), r).otherwise(top))
    out = out.withColumn("best", best)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_slips(doc_id: int | None, words: dict[str, int]) -> dict[str, int]:
    """The words of a document where about one in 199 (by the hash of id and word) lacks a letter."""
    if doc_id is None:
        return words
    head, out = zlib.crc32(f"{doc_id}:".encode()), {}
    for word, n in words.items():
        h = zlib.crc32(word.encode(), head)
        if h % 199 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] = out.get(word, 0) + n
    return out


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.count_words(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=6, alter=with_slips)
    return spelling.group_variants(counts, min_chars=6, min_count=5, ratio=5)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_byte_bpe, op3_jaccard_join, op4_tree_score, op5_token_files, op6_decontamination, op7_html_extraction, op8_chat_formatting, op9_url_filters, op10_quality_rules, op11_periodic_runs, op12_spelling_variants, op13_exact_dedup)}

ORACLES = {
    "op13_exact_dedup": r"""
with normal as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from normal
""",
    "op1_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), often as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), judged as (
  select l.doc_id, l.pos, l.line, o.k is not null and l.doc_id <> o.keeper as gone from keyed l left join often o on o.k = l.k
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
""",
    "op9_url_filters": r"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parsed as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), rules(r_host, r_path, r_verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits as (
  select page_id, host, path, r_host || r_path as rule, r_verdict, row_number() over (partition by page_id order by length(r_host || r_path) desc nulls last) as k
  from parsed left join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
)
select page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict from fits where k = 1
""",
}
