"""Shared helpers of the training-data operators.

Work files go to the folder that ``spark.checkpoint.dir`` names, which all executors share.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word or pad a line: tab, line feed, vertical tab, form feed, carriage return, space.
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset in one process (tests), one is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strideframe-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once as Parquet and read again: cuts lineage and survives a lost executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of work files that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """A-Z lower-cased; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- vectorised words inside Arrow batches -------------------------------------------------


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch into runs of rows of about ``max_bytes`` of text: (first row, UTF-8 texts; null is empty)."""
    first, size, run = 0, 0, []
    for k, t in enumerate(batch.column(column)):
        t = (t.as_py() or "").encode("utf-8", "surrogatepass")
        if run and size + len(t) > max_bytes:
            yield first, run
            first, size, run = k, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """How many words (runs of other than BLANKS) each text has, for all words in turn their place among the distinct ones, and these."""
    import pyarrow.compute as pc

    cut = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.large_string(), safe=False))
    flat = cut.flatten().dictionary_encode()
    words = flat.dictionary.cast(pa.large_binary()).to_pylist()
    at = flat.indices.to_numpy().astype(np.int64)
    lens = np.asarray(cut.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if b"" in words:  # blanks at an end leave an empty word
        gone = words.index(b"")
        real = at != gone
        ends = np.concatenate([[0], np.cumsum(real)])[np.cumsum(lens)]
        lens, at = np.diff(ends, prepend=0), at[real]
        at -= at > gone
        del words[gone]
    return lens, at, words


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of other than BLANKS) of the texts in turn, and the words of each text."""
    import xxhash

    lens, at, words = split_words(texts)
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[at], lens


def shingle_hashes(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width``-word shingle of each text (fewer words: the whole sequence as one), and how many each has."""
    h, lens = word_hashes(texts)
    step = np.uint64(0x9E3779B97F4A7C15)
    counts = np.where(lens >= width, lens - width + 1, np.minimum(lens, 1))
    first = np.cumsum(lens) - lens
    at = np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    acc = padded[at]
    for k in range(1, width):
        acc *= step
        acc += padded[at + k]
    own = np.cumsum(counts) - counts
    for size in range(1, width):  # whole texts of fewer words
        short = np.flatnonzero(lens == size)
        x = np.full(len(short), size, np.uint64)
        for k in range(size):
            x = x * step + padded[first[short] + k]
        acc[own[short]] = x
    return mix(acc), counts


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by ``keys``, cut anew so that each holds only whole groups of equal keys."""
    held: list[pa.RecordBatch] = []

    def joined(parts):
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
        cut = int(other[-1]) + 1 if len(other) else 0  # where the last group of the batch starts
        if cut:
            yield joined([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield joined(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield joined(held)


def release() -> None:
    """Give memory that a worker no longer uses back to the system, as workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy(run):
    """``run`` (batches to batches) that ends by giving memory back."""

    def own(batches):
        yield from run(batches)
        release()

    return own


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's LONG."""
    return pa.array(x.view(np.int64))
