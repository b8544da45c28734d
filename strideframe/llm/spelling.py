"""Grouping of spelling variants: letter-parity masks in three bands.

A word's mask has a bit for each letter (a-z and U+00C0 to U+00FF: 90), set where the word holds the letter an odd
number of times. One inserted or deleted letter flips one bit and one replaced letter two, so of three bands of 30 bits
one at least is equal in both words. Words are joined on equal bands with a filter on length: for each smaller length m,
words of m letters meet words of m or m + 1. A band alone would meet a fixed share of all pairs of words, so a key also
holds one half of the word: one edit leaves the first m // 2 letters or the last m - m // 2 as they are. A pair meets
under up to six keys and is taken under the first of them only; masks that differ in more bits are put off before
the words themselves are compared.

A word of L letters has fewer than 90 (2 L + 2) near words, so no word's group is large whatever the corpus. A word's
form is its near word of largest count; forms are followed to the last by pointer doubling, for a form's count
is a multiple of the word's, which bounds the chain by the logarithm of the largest count.

Defined results: a null or empty text has no words; repeated rows count each time; a text without letters gives
nothing; an empty table gives an empty result; words are cut from whole texts of any length; other columns are ignored.
Ties between near words go to the smallest in code-point order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged, tidy

#: Distinct words that a task counts before it hands its counts on.
HELD = 200_000
BANDS = 3


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, alter: Callable | None = None) -> DataFrame:
    """(word, n) of all runs of at least ``min_chars`` letters in the texts, A-Z lower-cased; tasks add up their own first.

    ``alter``, where given, gets an id and a Counter of the words of its text and returns the Counter to use.
    """
    word = re.compile("[a-zÀ-ÿ]{%d,}" % min_chars)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                own = Counter(word.findall(text.as_py().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                held.update(own if alter is None else alter(doc.as_py(), own))
                if len(held) > HELD:
                    yield batch(held)
                    held = Counter()
        if held:
            yield batch(held)

    return base.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mask(word, band: int):
    """The parity of the letters whose place in the alphabet of 90 leaves ``band`` when divided by BANDS, as bits."""
    place = lambda c: F.ascii(c) - F.when(F.ascii(c) < 128, F.lit(97)).otherwise(F.lit(0xC0 - 26))
    bit = lambda c: F.when(place(c) % BANDS == band, F.call_function("shiftleft", F.lit(1), (place(c) / BANDS).cast("int"))).otherwise(F.lit(0))
    return F.aggregate(F.split(word, ""), F.lit(0), lambda acc, c: acc.bitwiseXOR(bit(c)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) once for each two words of ``words`` (word, n; distinct) that one edit parts."""
    base = words.select("word", "n", F.char_length("word").alias("len"), F.array(*[_mask(F.col("word"), k) for k in range(BANDS)]).alias("mask"))
    base = staged(base, f"{shared_dir(words.sparkSession)}/masks")

    def keyed(df: DataFrame) -> DataFrame:
        """A row for each band and half of the word, as one of a pair whose shorter word has m letters."""
        df = df.withColumn("half", F.expr("array(substring(word, 1, m div 2), right(word, m - m div 2))"))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.lit(s).alias("side"), F.xxhash64("m", F.lit(k), F.lit(s), F.col("mask")[k], F.col("half")[s]).alias("key")) for k in range(BANDS) for s in (0, 1)]))
        return df.select("*", each.alias("at")).select("word", "n", "len", "m", "mask", "half", "at.*")

    short = keyed(base.withColumn("m", F.col("len"))).alias("a")
    long = keyed(base.withColumn("m", F.explode(F.array(F.col("len"), F.col("len") - 1)))).alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    flips = sum(F.bit_count(a("mask")[k].bitwiseXOR(b("mask")[k])) for k in range(BANDS))
    equal = [a("mask")[k] == b("mask")[k] for k in range(BANDS)]
    first_band = F.when(equal[0], 0).when(equal[1], 1).when(equal[2], 2)
    first_side = F.when(a("half")[0] == b("half")[0], 0).when(a("half")[1] == b("half")[1], 1)
    met = short.join(long, (a("key") == b("key")) & (a("m") == b("m")) & (a("band") == b("band")) & (a("side") == b("side")) & ((b("len") == a("len") + 1) | ((b("len") == a("len")) & (a("word") < b("word")))))
    met = met.where((flips <= 2 - (b("len") - a("len"))) & (a("band") == first_band) & (a("side") == first_side))
    return met.where(F.levenshtein(a("word"), b("word"), 1) == 1).select(a("word").alias("a"), a("n").alias("a_n"), b("word").alias("b"), b("n").alias("b_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, in rounds that double the steps."""
    spark = forms.sparkSession
    root, k = shared_dir(spark), 0
    at = staged(forms.select("word", F.col("form").alias("root")), f"{root}/0")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{root}/{k + 1}")
        at, k = after.select("word", "root"), k + 1
        if after.where("moved").isEmpty():
            return at


def group_variants(counts: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """For each word of ``counts`` (word, n) of enough letters and occurrences: word, form, root, n, n_near, form_n.

    n_near counts the words one edit away. The form is the one of largest n, if that is at least ``ratio`` times the
    word's own; the root is where forms lead in the end.
    """
    root = shared_dir(counts.sparkSession)
    words = staged(counts.where((F.char_length("word") >= min_chars) & (F.col("n") >= min_count)), f"{root}/words")
    pairs = staged(near_pairs(words), f"{root}/pairs")
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    fits = F.col("form_n") >= ratio * F.col("n")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    judged = staged(judged, f"{root}/judged")
    ends = last_forms(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
