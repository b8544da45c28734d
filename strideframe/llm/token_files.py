"""Token ids in Arrow stream files of equal-length sequences.

A file is an Arrow IPC stream whose batches hold two fixed-size lists of ``length`` items for each
sequence: ``ids`` and ``mask`` (false where the last sequence of the file is padded). Ids of a document are
followed by the end id, documents follow each other in ascending id order without gaps, and the byte place
of any sequence is plain arithmetic, so a reader maps the file and takes sequences without copying. The
file's schema metadata holds the vocabulary, the length and the end id; an index file beside it holds each document's id, first position
and length within the file.

The table is range-partitioned by document id; each task writes one file under a name of its own and renames
it when whole, so a repeated task leaves one copy. Files go to a folder all executors share.

Defined results: a null or empty text is the end id alone; rows of equal id are in the order of their
texts' hashes; null ids come first; an empty table writes no file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_shuffle, pieces, split_words

MAX_WORDS = 1_200_000
CLOSING = b".,;:!?"
ROWS = 256  # sequences of a batch

FILES = "part int, first long, last long, n_docs long, n_ids long, ids_path string, index_path string"


class WordEncoder:
    """A ``tokenizers`` vocabulary that never joins across blanks, with the ids of words kept: about MAX_WORDS, in a newer and an older half."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, ...]:
        """A word as the tokenizer's own splitting has it: closing marks part from an ASCII letter or digit before them."""
        core = word.rstrip(CLOSING)
        return (core, word[len(core) :]) if 0 < len(core) < len(word) and core[-1:].isalnum() else (word,)

    def _look_up(self, words: Iterable[bytes]) -> list[bytes]:
        """Moves words of the older half to the newer; returns those of neither."""
        new = []
        for w in words:
            if w not in self.known:
                ids = self.older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    self.known[w] = ids
        return new

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text: of its words in turn."""
        if len(self.known) > MAX_WORDS // 2:
            self.older, self.known = self.known, {}
        cut, places, words = split_words(texts)
        missing = self._look_up(words)
        if missing:
            marked = {w: self._parts(w) for w in missing if w[-1] in CLOSING}
            new = list({w for w in missing if w not in marked}.union(self._look_up({p for ps in marked.values() for p in ps})))
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
            self.known.update(zip(new, [array("I", e.ids).tobytes() for e in got], strict=True))
            self.known.update([(w, self.known[ps[0]] + self.known[ps[1]]) for w, ps in marked.items() if len(ps) == 2])
        own = [self.known[w] for w in words]
        flat = np.frombuffer(b"".join(own), np.uint32)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        first, size = (np.cumsum(size) - size)[places], size[places]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
        return np.split(ids, ends[np.cumsum(cut)[:-1]])


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _schema(length: int, wide: bool, end_id: int) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "end_id": str(end_id)})


class _Writer:
    """Fills sequences and writes them in batches of ROWS."""

    def __init__(self, fs, path: str, length: int, wide: bool, end_id: int):
        self.schema, self.length = _schema(length, wide, end_id), length
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        full = self.length * ROWS
        if self.held >= full:
            flat = np.concatenate(self.parts)
            for at in range(0, len(flat) - full + 1, full):
                self._batch(flat[at : at + full], full)
            rest = flat[len(flat) // full * full :]
            self.parts, self.held = [rest], len(rest)

    def _batch(self, flat: np.ndarray, n: int) -> None:
        rows = -(-n // self.length)
        ids = np.zeros(rows * self.length, self.schema.field("ids").type.value_type.to_pandas_dtype())
        ids[:n] = flat
        mask = np.arange(len(ids)) < n
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._batch(np.concatenate(self.parts), self.held)
        self.out.close()
        self.sink.close()


LEAST = -(2**63)  # what null ids count as


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """(id, text) in ``n`` partitions whose ids ascend. The bounds are quantiles of the ids alone, so no text is read for them.

    An id that fills several partitions (it is then several of the bounds) is spread over them by the hash of its texts.
    """
    own = F.coalesce("id", F.lit(LEAST))
    bounds = rows.select(own.alias("id")).agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    if not bounds:
        return rows.coalesce(1)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    known = F.array(*[F.lit(b) for b in bounds])

    def below(fits):
        """How many bounds fit, by binary search: they ascend."""
        step = lambda at, size: F.when((at + size <= len(bounds)) & fits(F.get(F.col("__bounds"), at + size - 1)), at + size).otherwise(at)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)

    placed = rows.withColumn("__bounds", known).withColumn("__low", below(lambda b: b < own)).withColumn("__high", below(lambda b: b <= own))
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    part = F.col("__low") + F.when(F.col("__high") > F.col("__low"), F.floor(share * (F.col("__high") - F.col("__low") + 1)).cast("int")).otherwise(0)
    return placed.withColumn("__part", part).drop("__bounds", "__low", "__high").repartitionById(n, "__part").select("id", "text")


def write_tokens(docs: DataFrame, vocab_path: str, folder: str, length: int = 1024, end_id: int = 2, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write; returns one row for each file (FILES), in document order by ``part``.

    ``wide`` stores ids as 32 bits; 16 do for vocabularies of up to 65,536.
    """
    largest = max(encoder(vocab_path).largest, end_id)
    if not wide and largest > 65535:
        raise ValueError(f"id {largest} takes more than 16 bits: write with wide=True")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = _dealt(base, n_shuffle(docs.sparkSession)).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own = encoder(vocab_path)
        fs, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)
        names = [f"{root}/{part:06d}.{kind}" for kind in ("ids.arrows", "index.arrows")]
        temp = [f"{n}.{uuid.uuid4().hex}.tmp" for n in names]
        out, ids, starts, lens, at = None, [], [], [], 0
        for b in batches:
            for first, texts in pieces(b, "text"):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = _Writer(fs, temp[0], length, wide, end_id)
                got = own(texts)
                ids += b.column("id").slice(first, len(texts)).to_pylist()
                for x in got:
                    starts.append(at)
                    lens.append(len(x) + 1)
                    at += len(x) + 1
                    out.add(x)
                    out.add(np.array([end_id], np.uint32))
        if out is None:
            return
        out.close()
        index = pa.table({"id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n": pa.array(lens, pa.int64())})
        with fs.open_output_stream(temp[1]) as sink, pa.ipc.new_stream(sink, index.schema) as w:
            w.write_table(index)
        for a, b in zip(temp, names, strict=True):
            fs.move(a, b)
        uri = folder.rstrip("/")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [ids[0]], "last": [ids[-1]], "n_docs": [len(ids)], "n_ids": [at], "ids_path": [f"{uri}/{part:06d}.ids.arrows"], "index_path": [f"{uri}/{part:06d}.index.arrows"]})

    return dealt.mapInArrow(run, FILES)


def _open(path: str):
    """A file as an Arrow input: mapped if local, so that reading takes no copy."""
    fs, local = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    return pa.memory_map(local) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(local)


def sequences(path: str) -> Iterator[tuple[np.ndarray, pa.BooleanArray]]:
    """(ids as rows x length, mask) of each batch; ids are a view of the file where it is mapped."""
    with _open(path) as source, pa.ipc.open_stream(source) as batches:
        for b in batches:
            lists = b.column("ids")
            yield lists.flatten().to_numpy().reshape(len(lists), lists.type.list_size), b.column("mask").flatten()


class Reader:
    """Random access to the sequences of a mapped file."""

    def __init__(self, path: str):
        self.source = _open(path)
        self.batches = list(pa.ipc.open_stream(self.source))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.batches[k // ROWS]
        lists, mask, k = b.column("ids"), b.column("mask"), k % ROWS
        n = lists.type.list_size
        return lists.flatten().to_numpy()[k * n : (k + 1) * n], mask.flatten().slice(k * n, n).to_numpy(zero_copy_only=False)


def read_documents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files.

    ``files`` has one row for each file; the ids before each file are summed from their counts.
    """
    rows = sorted(files.select("part", "n_ids", "ids_path", "index_path").collect())
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    bases = np.concatenate([[0], np.cumsum([r.n_ids for r in rows])[:-1]]).tolist()
    jobs = spark.createDataFrame([(r.ids_path, r.index_path, b) for r, b in zip(rows, bases, strict=True)], "ids_path string, index_path string, base long").repartition(len(rows))

    def run(batches):
        for b in batches:
            for job in b.to_pylist():
                with _open(job["index_path"]) as source:
                    index = pa.ipc.open_stream(source).read_all()
                ends = np.cumsum(index.column("n").to_numpy())
                crcs, k, at, crc = [], 0, 0, 0
                for ids, mask in sequences(job["ids_path"]):
                    flat = ids.reshape(-1)[: mask.true_count].astype("<u4")
                    lo = 0
                    while lo < len(flat):
                        hi = min(len(flat), int(ends[k]) - at)
                        crc = zlib.crc32(flat[lo:hi], crc)
                        if hi == int(ends[k]) - at:
                            crcs.append(crc)
                            k, crc = k + 1, 0
                        lo = hi
                    at += len(flat)
                yield pa.RecordBatch.from_arrays([index.column("id").combine_chunks(), pa.array(index.column("start").to_numpy() + job["base"]), index.column("n").combine_chunks(), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return jobs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
