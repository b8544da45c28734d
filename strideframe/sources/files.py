"""Readers and writers of recordings: NumPy arrays, calibrations, annotations, audio, wide CSV."""

from __future__ import annotations

import io
import math
import tomllib
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.contact import rodrigues


class NpyDataSource(DataSource):
    """``spark.read.format("npy").load(path)``: points of a (frames, joints, 3) array, a partition for each run of frames.

    Options: path, seq_id (default: the path), slab (frames of a partition). NaN becomes null. Readers map the file, so a
    partition reads its own frames only; the path must be open to all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "seq_id string, frame int, joint int, x double, y double, z double"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


class Slab(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.slab = options["path"].removeprefix("file://").removeprefix("file:"), int(options.get("slab", 4096))
        self.seq_id = options.get("seq_id", self.path)

    def partitions(self):
        n = np.load(self.path, mmap_mode="r").shape[0]
        return [Slab(a, min(a + self.slab, n)) for a in range(0, n, self.slab)]

    def read(self, partition):
        a = np.asarray(np.load(self.path, mmap_mode="r")[partition.start : partition.end], float)
        f, k, _ = a.shape
        flat = a.reshape(-1, 3)
        cols = [pa.array([self.seq_id] * len(flat)), pa.array(np.repeat(np.arange(partition.start, partition.end, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), f))]
        cols += [pa.array(np.nan_to_num(flat[:, d]), mask=np.isnan(flat[:, d])) for d in range(3)]
        yield pa.RecordBatch.from_arrays(cols, ["seq_id", "frame", "joint", "x", "y", "z"])


def read_npy(spark: SparkSession, path: str, seq_id: str | None = None) -> DataFrame:
    spark.dataSource.register(NpyDataSource)
    reader = spark.read.format("npy").option("path", path)
    return (reader.option("seq_id", seq_id) if seq_id else reader).load()


def write_npy(points: DataFrame, path: str, joints: int) -> None:
    """One sequence as a (frames, joints, 3) array; a sequence is what one file holds, so it is gathered in order."""
    pdf = points.select("frame", "joint", "x", "y", "z").toPandas()
    out = np.full((int(pdf["frame"].max()) + 1 if len(pdf) else 0, joints, 3), np.nan)
    out[pdf["frame"], pdf["joint"]] = pdf[["x", "y", "z"]].to_numpy(float)
    np.save(path, out)


def write_wide_csv(points: DataFrame, path: str, joints: int) -> None:
    """``frame,kp0_x,kp0_y,...`` with four decimals and blanks for missing values."""
    value = lambda j, c: F.max(F.when((F.col("joint") == j) & F.col(c).isNotNull(), F.format_string("%.4f", c))).alias(f"kp{j}_{c}")
    points.groupBy("frame").agg(*[value(j, c) for j in range(joints) for c in "xyz"]).orderBy("frame").write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def read_calibration(spark: SparkSession, text: str) -> DataFrame:
    """(cam, name, k, rt, p, width, height) of a TOML calibration: tables with matrix, rotation, translation, size [h, w]."""
    data = tomllib.loads(text)
    tables = data.get("cameras", data)
    rows = []
    for cam, key in enumerate(sorted(k for k, v in tables.items() if isinstance(v, dict) and "matrix" in v)):
        c = tables[key]
        k, rt = np.array(c["matrix"], float), np.column_stack([rodrigues(c["rotation"]), np.array(c["translation"], float)])
        h, w = c.get("size", [0, 0])
        rows.append((cam, str(c.get("name", key)), k.ravel().tolist(), rt.ravel().tolist(), (k @ rt).ravel().tolist(), int(w), int(h)))
    return spark.createDataFrame(rows, "cam int, name string, k array<double>, rt array<double>, p array<double>, width int, height int")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(camera, timestamp, pose, joint, u, v, score) of JSON files {frames: [{camera, timestamp, poses: [{id, points_2d, scores}]}]}."""
    schema = "frames array<struct<camera:string,timestamp:double,poses:array<struct<id:int,points_2d:array<array<double>>,scores:array<double>>>>>"
    poses = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("frames").alias("f")).select("f.camera", "f.timestamp", F.posexplode("f.poses").alias("pose", "p"))
    points = poses.select("camera", "timestamp", F.coalesce("p.id", "pose").alias("pose"), "p.scores", F.posexplode("p.points_2d").alias("joint", "uv"))
    return points.select("camera", "timestamp", "pose", "joint", F.get("uv", 0).alias("u"), F.get("uv", 1).alias("v"), F.get("scores", F.col("joint")).alias("score"))


def pcm(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, first channel scaled to a peak of 1) of a WAV file of 8, 16, 24 or 32 bits; silence if it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return 0, np.zeros(0)
    if width == 3:  # widened to 32 bits, the sign with it
        raw = np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).tobytes()
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 3: "<i4", 4: "<i4"}[width]).reshape(-1, channels)[:, 0].astype(float)
    x = x - 128 if width == 1 else x
    return rate, x / np.abs(x).max() if len(x) and np.abs(x).max() > 0 else x


def read_audio_energy(spark: SparkSession, path: str, window_ms: float = 10.0) -> DataFrame:
    """(path, win, e): short-time energy of WAV files, a task reading whole files."""

    def run(pdfs):
        for pdf in pdfs:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                rate, x = pcm(content)
                n = max(1, math.floor(rate * window_ms / 1000)) if rate else 1
                k = len(x) // n
                yield pd.DataFrame({"path": p, "win": np.arange(k), "e": (x[: k * n].reshape(k, n) ** 2).mean(1) if k else np.zeros(0)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, win long, e double")


def best_people(detections: DataFrame, least: float = 0.3) -> DataFrame:
    """Detections (frame, cam, kpts array of (x, y, score)) whose mean body score reaches ``least``, ranked by it in each view."""
    from pyspark.sql import Window

    body = F.slice("kpts", 1, 17)
    mean = F.aggregate(body, F.lit(0.0), lambda a, k: a + k["score"]) / F.size(body)
    rank = F.row_number().over(Window.partitionBy("frame", "cam").orderBy(F.desc("confidence"), "det_pos"))
    return detections.withColumn("confidence", mean).where(F.col("confidence") >= least).withColumn("rank", rank)


def to_553(points: DataFrame) -> DataFrame:
    """Points of the 133-point layout as the 553-point one: body joints by the fixed map, hands and face by place; the rest missing."""
    from ..layouts import COCO_TO_BODY, SEGMENTS_133, SEGMENTS_553, joints

    rows = list(COCO_TO_BODY.items())
    for s in ("right_hand", "left_hand", "face"):
        (a, e), (b, _) = SEGMENTS_133[s], SEGMENTS_553[s]
        rows += [(a + k, b + k) for k in range(e - a)]
    spark = points.sparkSession
    dim = F.broadcast(spark.createDataFrame(rows, "joint int, target int"))
    mapped = points.join(dim, "joint").select("seq_id", "frame", F.col("target").alias("joint"), "x", "y", "z")
    spine = points.select("seq_id", "frame").distinct().join(F.broadcast(joints(spark).select("joint")), how="cross")
    return spine.join(mapped, ["seq_id", "frame", "joint"], "left")
