"""Exact deduplication by skew-safe combining (DataFrame operations only).

Texts are equal when they are identical after A-Z are lower-cased. Every grouping is by the digest *and* the whole
normalised text, so that two texts that share a digest never meet in a group:

1. locally: each map task combines its own equal texts before anything is shuffled;
2. salted: a digest that holds a thousandth of the rows or more is dealt by (digest, salt), the salt being that of
   the map task, so each task sends one row of a hot text and each (digest, salt) merges (tasks / salts) rows;
3. globally: the salts' winners of hot digests are combined, again by whole text. Other digests have one salt.

What comes of it is one narrow row for each text that more than one document has. Documents find it by digest, which
is enough where the groups have shown that all texts of the digest are the same; digests with several texts, if
there are any, are looked up by their whole texts.

Defined results: a null text counts as empty, all empty texts are equal; a null id is smaller than any other; of rows
alike in text and id one stays; texts are compared whole at any length; an empty table gives an empty result; columns
named like the added ones are replaced, other columns stay. The input is read twice and must give the same rows
(``drop_copies`` writes it down first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, staged

#: A digest is hot from a share of 1 / SHARES of all rows on, so that at most SHARES digests are: those are broadcast.
SHARES = 1000
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]
TAG = "__tag"


def _found(rows: DataFrame, groups: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """``rows`` with what ``groups`` has for their digest; the hot digests' groups (at most SHARES) are broadcast."""
    hot = F.broadcast(hot)
    often, rest = rows.join(hot, "digest", "left_semi"), rows.join(hot, "digest", "left_anti")
    return often.join(F.broadcast(groups.join(hot, "digest", "left_semi")), "digest", how).unionByName(rest.join(groups.join(hot, "digest", "left_anti"), "digest", how))


def _mark(docs: DataFrame, id_col: str, text_col: str, salts: int, digest) -> DataFrame:
    """``docs``, which have a TAG, without the text and with ADDED."""
    spark = docs.sparkSession
    root = shared_dir(spark)
    others = [c for c in docs.columns if c not in (TAG, id_col, text_col, *ADDED)]
    packed = F.struct(*others) if others else F.lit(None).cast("int")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(TAG).alias("tag"), F.col(id_col).alias("id"), packed.alias("others"), norm.alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    texts = texts.withColumn("digest", digest(F.col("sha")))
    rows = staged(texts.drop("norm", "digest"), f"{root}/rows").withColumn("digest", digest(F.col("sha")))

    total = rows.count()
    hot = staged(rows.groupBy("digest").count().where((F.col("count") > 1) & (F.col("count") * SHARES >= total)).select("digest"), f"{root}/hot")

    # The local combination is the partial aggregation of the same groupBy.
    salted = texts.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))))
    merged = salted.groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = staged(merged.select("digest", "salt", F.when(F.col("salt").isNotNull(), F.col("norm")).alias("norm"), "keep_id", "n"), f"{root}/merged")
    whole = merged.where("salt is not null").groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")).drop("norm")
    by_text = merged.where("salt is null").select("digest", "keep_id", "n").unionByName(whole)
    by_digest = by_text.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = staged(by_digest.where("n > 1"), f"{root}/groups")

    clash = groups.where("texts > 1").select("digest")
    alone = groups.where("texts = 1").select("digest", "keep_id", "n")
    top = _found(rows, alone, hot, "inner").where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.max("tag").alias("keep_tag"))
    alone = staged(alone.join(top, "digest"), f"{root}/alone")
    out = ["tag", "id", "others", "sha", "keep_id", "n", "keep_tag"]
    if clash.isEmpty():
        marked = _found(rows, alone, hot, "left").select(*out)
    else:  # several texts share a digest: their rows are grouped and found by the whole text
        clash = staged(clash, f"{root}/clash")
        same = staged(texts.join(clash, "digest", "left_semi"), f"{root}/same")
        by = ["digest", "norm"]
        own = same.groupBy(*by).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        last = same.join(own, by).where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy(*by, "keep_id", "n").agg(F.max("tag").alias("keep_tag"))
        marked = _found(rows.join(clash, "digest", "left_anti"), alone, hot, "left").select(*out).unionByName(same.join(last, by).select(*out))

    return marked.select(
        F.col("tag").alias(TAG),
        F.col("id").alias(id_col),
        *[F.col("others")[c].alias(c) for c in others],
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.coalesce("n", F.lit(1)) == 1) | (F.col("tag") == F.col("keep_tag"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest=lambda sha: sha) -> DataFrame:
    """A row for each row of ``docs``: its columns but the text, keep_id (the largest id that has an equal text),
    group_size (rows of equal text), kept (this row stays) and text_sha256 (of the normalised text).

    ``digest`` makes the grouping key of the SHA-256; results do not depend on it.
    """
    return _mark(docs.withColumn(TAG, F.monotonically_increasing_id()), id_col, text_col, salts, digest).drop(TAG)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest=lambda sha: sha) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one of the largest id."""
    tagged = staged(docs.withColumn(TAG, F.monotonically_increasing_id()), f"{shared_dir(docs.sparkSession)}/tagged")
    gone = _mark(tagged.select(TAG, id_col, text_col), id_col, text_col, salts, digest).where(~F.col("kept")).select(TAG)
    return tagged.join(gone, TAG, "left_anti").drop(TAG)
