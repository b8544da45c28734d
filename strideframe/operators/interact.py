"""Joins between actors, detections and markers."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou, valid


def contact_pairs(points: DataFrame, near: float = 0.05) -> DataFrame:
    """(frame, actor_a, actor_b, joint_a, joint_b, dist): joints of two actors closer than ``near``.

    An equi-join on (frame, grid cell): a point is in its cell of edge ``near``, its partner's copies are in the 27 cells around, so no
    frame is paired out as a whole.
    """
    cell = {f"g{c}": F.floor(F.col(c) / near).cast("long") for c in "xyz"}
    a = points.where(valid()).withColumns(cell)
    around = F.array(*[F.struct(*[F.lit(d).alias(f"d{c}") for c, d in zip("xyz", s, strict=True)]) for s in itertools.product((-1, 0, 1), repeat=3)])
    b = a.withColumn("s", F.explode(around)).select("frame", F.col("seq_id").alias("actor_b"), F.col("joint").alias("joint_b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *[(F.col(f"g{c}") + F.col(f"s.d{c}")).alias(f"g{c}") for c in "xyz"])
    both = a.withColumnsRenamed({"seq_id": "actor_a", "joint": "joint_a"}).join(b, ["frame", "gx", "gy", "gz"]).where("actor_a < actor_b")
    dist = F.sqrt(sum(F.pow(F.col(c) - F.col(f"b{c}"), 2) for c in "xyz"))
    return both.withColumn("dist", dist).where(F.col("dist") < near).select("frame", "actor_a", "actor_b", "joint_a", "joint_b", "dist")


def interpenetration(points: DataFrame, near: float = 0.15, share: float = 0.3) -> DataFrame:
    """(frame, actor_a, actor_b, overlap_fraction): actor pairs with ``share`` of a's joints within ``near`` of some joint of b."""
    close = contact_pairs(points, near).groupBy("frame", "actor_a", "actor_b").agg(F.countDistinct("joint_a").alias("k"))
    size = points.where(valid()).groupBy("frame", F.col("seq_id").alias("actor_a")).agg(F.count(F.lit(1)).alias("n"))
    return close.join(size, ["frame", "actor_a"]).withColumn("overlap_fraction", F.col("k") / F.col("n")).where(F.col("overlap_fraction") >= share).select("frame", "actor_a", "actor_b", "overlap_fraction")


def detection_ious(dets: DataFrame) -> DataFrame:
    """(frame, cam, i, j, iou) of overlapping boxes of one camera and frame."""
    box = dets.select("frame", "cam", "det_pos", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))
    b = box.select("frame", "cam", F.col("det_pos").alias("j"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = box.withColumnRenamed("det_pos", "i").join(b, ["frame", "cam"]).where("i < j")
    return pairs.select("frame", "cam", "i", "j", iou("x1", "y1", "x2", "y2", "bx1", "by1", "bx2", "by2").alias("iou")).where("iou > 0")


def nearest_marker(markers: DataFrame, bodies: DataFrame, gate: float = 120.0) -> DataFrame:
    """Each marker (frame, cam, marker_id, mx, my) bound to the nearest body (frame, cam, person, tx, ty) within ``gate`` pixels."""
    both = markers.join(bodies, ["frame", "cam"]).withColumn("dist", F.sqrt(F.pow(F.col("mx") - F.col("tx"), 2) + F.pow(F.col("my") - F.col("ty"), 2))).where(F.col("dist") <= gate)
    k = F.row_number().over(Window.partitionBy("frame", "cam", "marker_id").orderBy("dist", "person"))
    return both.withColumn("k", k).where("k = 1").select("frame", "cam", "marker_id", "person", "dist")


def marker_votes(bindings: DataFrame) -> DataFrame:
    """(marker, actor, votes): the actor most bindings of a marker name, if at least two do or there is one binding."""
    counts = bindings.groupBy("marker", "actor").agg(F.count(F.lit(1)).alias("votes"), F.min("cam").alias("first_cam"))
    total = counts.groupBy("marker").agg(F.sum("votes").alias("total"), F.min_by(F.struct("actor", "votes"), F.struct(-F.col("votes"), "first_cam", "actor")).alias("best"))
    return total.where("best.votes >= 2 or total = 1").select("marker", "best.actor", "best.votes")


def torso_centre(points: DataFrame, left_shoulder: int = 11, right_shoulder: int = 12, left_hip: int = 23, right_hip: int = 24) -> DataFrame:
    """(seq_id, frame, x, y, z): the shoulders' midpoint, else the hips'."""
    at = lambda j, c: F.max(F.when((F.col("joint") == j) & valid(), F.col(c)))
    return points.groupBy("seq_id", "frame").agg(*[F.coalesce((at(left_shoulder, c) + at(right_shoulder, c)) / 2, (at(left_hip, c) + at(right_hip, c)) / 2).alias(c) for c in "xyz"])


def bounding_boxes(obs: DataFrame, pad: float = 15.0) -> DataFrame:
    """(seq_id, cam, frame, x1, y1, x2, y2) around the keypoints that are there and not at the origin."""
    seen = obs.where("u is not null and v is not null and not (u = 0 and v = 0)")
    return seen.groupBy("seq_id", "cam", "frame").agg(F.greatest(F.min("u") - pad, F.lit(0.0)).alias("x1"), F.greatest(F.min("v") - pad, F.lit(0.0)).alias("y1"), (F.max("u") + pad).alias("x2"), (F.max("v") + pad).alias("y2"))


def detection_counts(dets: DataFrame, conf: float = 0.5) -> DataFrame:
    """One row: frames between the first and last, detections at or over ``conf``, persons a frame, empty frames."""
    n = dets.groupBy("frame").agg(F.count_if(F.col("conf") >= conf).alias("n"))
    frames = F.max("frame").cast("long") - F.min("frame") + 1
    return n.agg(frames.alias("frames"), F.sum("n").alias("detections"), (F.sum("n") / frames).alias("mean_persons"), F.max("n").alias("max_persons"), (frames - F.count_if(F.col("n") > 0)).alias("empty_frames")).where("frames is not null")
