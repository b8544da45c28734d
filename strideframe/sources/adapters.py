"""Views of the driver's tables as motion-capture data: channels, skeletons, time stamps, detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Body joints that the 21 points of an embedding stand for.
BODY21 = [0, 7, 8, 9, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 10]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, frame, t, v): each user's event values; errors are missing samples."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq_id"),
        (F.row_number().over(w) - 1).cast("int").alias("frame"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"),
        F.when(F.col("event_type") != "error", F.col("value").cast("double")).alias("v"),
    ).withColumn("t", F.col("us") / 1e6).drop("us")


def skeleton(spark: SparkSession, sf_dir: str, body: bool = True) -> DataFrame:
    """(seq_id, frame, joint, x, y, z) in mm from the embeddings, a sequence for each label; near-zero x is a missing point."""
    w = Window.partitionBy("label").orderBy("vec_id")
    names = F.array(*[F.lit(j) for j in (BODY21 if body else range(21))])
    frames = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("seq_id"), (F.row_number().over(w) - 1).cast("int").alias("frame"), "embedding")
    rows = frames.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20))))
    at = lambda d: F.get("embedding", F.col("k") * 3 + d).cast("double") * 1000
    seen = F.abs(at(0)) >= 5
    return rows.select("seq_id", "frame", F.get(names, F.col("k")).cast("int").alias("joint"), *[F.when(seen, at(d)).alias(c) for d, c in enumerate("xyz")])


def cam_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cam, frame, t): time stamps by event type."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("cam"), (F.row_number().over(w) - 1).cast("int").alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, cam, det_pos, cx, cy, w, h, conf) from line items."""
    w = Window.partitionBy("frame", "cam").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return (
        _table(spark, sf_dir, "lineitem")
        .withColumn("frame", F.col("l_orderkey"))
        .withColumn("cam", (F.col("l_linenumber") % 3).cast("int"))
        .select("frame", "cam", (F.row_number().over(w) - 1).cast("int").alias("det_pos"), (F.col("l_quantity") * 20).cast("double").alias("cx"), (F.col("l_extendedprice") / 100).cast("double").alias("cy"), (F.col("l_quantity") + 40).cast("double").alias("w"), (F.col("l_quantity") * 2 + 60).cast("double").alias("h"), F.abs(F.col("l_discount") * 10).cast("double").alias("conf"))
    )


#: Literal 3x4 projections (row-major) of three cameras that look at the skeletons.
CAMERAS = [
    (0, [800.0, 0.0, 320.0, 1600000.0, 0.0, 800.0, 240.0, 1200000.0, 0.0, 0.0, 1.0, 5000.0]),
    (1, [700.0, 0.0, 320.0, 1800000.0, 0.0, 700.0, 240.0, 1100000.0, 0.1, 0.0, 1.0, 5200.0]),
    (2, [750.0, 0.0, 320.0, 1500000.0, 0.0, 750.0, 240.0, 1250000.0, 0.0, 0.1, 1.0, 5400.0]),
]


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERAS, "cam int, p array<double>")


def obs2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, cam, frame, joint, u, v, conf): the skeletons seen by CAMERAS."""
    from ..functions.geometry import project

    pts = skeleton(spark, sf_dir).join(F.broadcast(cameras(spark)), how="cross")
    u, v = project("p", "x", "y", "z")
    return pts.select("seq_id", "cam", "frame", "joint", u.alias("u"), v.alias("v"), ((F.pmod(F.col("joint") * 7 + F.col("frame") * 3 + F.col("cam") * 5, F.lit(10)) + 1) / 10.0).alias("conf"))


#: Frames of a clip of the scene that all skeletons act in.
CLIP = 20


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, frame, cam, det_pos, joint, u, v, conf, person): the skeletons as people in one room, in clips of CLIP frames;
    each camera numbers its detections in an order of its own."""
    return obs2d(spark, sf_dir).where("u is not null and v is not null").select(
        F.floor(F.col("frame") / CLIP).cast("long").alias("seq_id"),
        (F.col("frame") % CLIP).alias("frame"),
        "cam",
        F.pmod(F.col("seq_id") * 3 + F.col("cam") * 7, F.lit(10)).cast("int").alias("det_pos"),
        "joint",
        "u",
        "v",
        "conf",
        F.col("seq_id").alias("person"),
    )
