"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

The index of known lines is a set of *runs*: bucketed tables, hashed and sorted by the 128-bit line
hash, so a merge join with a run moves and sorts only the new batch. Every batch is pre-aggregated
to one row per line and merge-anti-joined with the runs: lines that no run has become a new run at
level 0; lines already known only add to their count, in a delta run. When a level holds ``fanout``
runs they are merged into one of the next level, so a batch meets O(log batches) runs.

Defined results: a null or empty text is one empty line; rows of one id are one document, and all of
them keep the lines whose largest id it is; null ids are one document, smaller than any other; lines
shorter than ``min_chars`` code points after normalising are never dropped; an empty table gives an
empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, discard, n_shuffle, shared_dir, staged

KEY = ["h1", "h2"]


def line_key(line):
    """A line without blanks at either end, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """An index of line hashes with counts and largest ids, kept as levelled sorted runs."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = 2, buckets: int | None = None):
        self.spark, self.root, self.fanout = spark, root, fanout
        self.buckets = buckets or n_shuffle(spark)
        self.levels: list[list[DataFrame]] = []
        self.deltas: list[DataFrame] = []
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []  # run files are named by the identity of their frames, which so stay alive

    def _write(self, rows: DataFrame) -> DataFrame:
        """A run: one sorted file for each bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY).write.format("parquet").option("path", f"{self.root}/{name}").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name))
        run = self.spark.table(name)
        self.paths[id(run)] = f"{self.root}/{name}"
        self.held.append(run)
        return run

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, doc_id), one row for each document and line key."""
        new = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_doc"))
        fresh, known = new, None
        for run in self.runs():
            seen = run.select(*KEY)
            hit = new.join(seen, KEY, "left_semi")
            fresh, known = fresh.join(seen, KEY, "left_anti"), hit if known is None else known.unionByName(hit)
        if known is not None:
            self.deltas.append(self._write(known))
        self._push(self._write(fresh), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._rows(self.levels[level]))
            self.levels[level] = []
            self._push(merged, level + 1)

    def _rows(self, runs: list[DataFrame]) -> DataFrame:
        """All rows of some runs, read as plain files (a union of bucketed scans would wrongly count as one bucketing)."""
        return self.spark.read.schema(runs[0].schema).parquet(*[self.paths[id(run)] for run in runs])

    def drop(self) -> None:
        """Forget all runs and delete their files."""
        for path in self.paths.values():
            self.spark.sql(f"drop table if exists {path.rsplit('/', 1)[1]}")
            discard(self.spark, path)
        self.levels, self.deltas, self.paths, self.held = [], [], {}, []

    def totals(self) -> DataFrame:
        """(h1, h2, n, last_doc) of every known line: runs hold a key once, deltas add to it."""
        return self._rows(self.runs() + self.deltas).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last_doc").alias("last_doc"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and n_lines and n_dropped.

    A line found in at least ``min_docs`` documents stays only in the largest id that holds it.
    ``batches`` is how many parts of the table are added to the index in turn.
    """
    spark = docs.sparkSession
    root = shared_dir(spark)
    doc_id, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    row = F.xxhash64(doc_id, text)  # rows alike in id and text lose the same lines
    occ = (
        docs.select(doc_id.alias("doc_id"), row.alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    )
    occ.write.partitionBy("batch").parquet(f"{root}/lines")
    occ = spark.read.schema(occ.schema).parquet(f"{root}/lines")

    index = LineRuns(spark, root, fanout)
    for k in range(batches):
        index.add(occ.where(F.col("batch") == k).select(*KEY, "doc_id").distinct())
    often = staged(index.totals().where(F.col("n") >= min_docs), f"{root}/often")
    index.drop()

    # At most 1000 lines can each hold a thousandth of the index; those are broadcast, so no task gets a hot line's rows.
    total = often.agg(F.sum("n")).first()[0] or 0
    hot_at = max(total // 1000, 1000)
    hot, rest = often.where(F.col("n") >= hot_at), often.where(F.col("n") < hot_at)
    drops = occ.join(F.broadcast(hot), KEY).unionByName(occ.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(rest, KEY))
    drops = drops.where(F.coalesce(F.col("doc_id") < F.col("last_doc"), F.col("last_doc").isNotNull())).groupBy("row").agg(F.collect_set("pos").alias("__gone"))

    # The lines are cut before the join, so that what follows reads them by position from a column.
    cut = docs.drop("n_lines", "n_dropped").withColumns({"__row": row, "__lines": F.split(text, "\n", -1)}).drop(text_col)
    n = F.size("__lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(F.col("__gone"), F.array().cast("array<int>")))
    joined = cut.join(drops.withColumnRenamed("row", "__row").hint("shuffle_hash"), "__row", "left")
    out = joined.withColumns(
        {
            text_col: F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda k: F.get(F.col("__lines"), k)), "\n")),
            "n_lines": n.cast("long"),
            "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        }
    )
    return out.select(*docs.drop("n_lines", "n_dropped").columns, "n_lines", "n_dropped")
