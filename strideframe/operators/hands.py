"""Hands and face: tracking quality, and filling a poorly tracked hand from another tracker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid
from .windows import by, median, moves


def _apart(a: str, b: str) -> Column:
    return F.sqrt(sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"))


def _severity(score: Column) -> Column:
    return F.when(score < 60, "poor").when(score < 80, "moderate").otherwise("good")


def _range(*columns: str) -> Column:
    return F.greatest(*[F.max(c) for c in columns]) - F.least(*[F.min(c) for c in columns]) if len(columns) > 1 else F.max(columns[0]) - F.min(columns[0])


def hand_quality(points: DataFrame, wrist: int, hand: list[int]) -> DataFrame:
    """Per sequence: coverage, frames whose hand is out of proportion to its distance from the wrist, jitter, a score of 100 and its class.

    Proportion is the hand's mean spread by its mean distance from the wrist, wrong below 0.3 and above 3. Jitter is the mean step of a frame in
    which more than three points moved between valid places.
    """
    at = points.where((F.col("joint") == wrist) & valid()).select("seq_id", "frame", *[F.col(c).alias(f"w{c}") for c in "xyz"])
    own = points.where(F.col("joint").isin(hand))
    there = own.where(valid())
    centre = there.groupBy("seq_id", "frame").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    near = there.withColumnsRenamed({c: f"p{c}" for c in "xyz"}).join(centre, ["seq_id", "frame"]).join(at, ["seq_id", "frame"])
    shape = near.groupBy("seq_id", "frame").agg(F.avg(_apart("p", "m")).alias("spread"), F.avg(_apart("p", "w")).alias("dist"))
    ratio = F.col("spread") / F.col("dist")
    wrong = shape.where((F.col("dist") > 0) & (F.col("spread") > 0) & ((ratio < 0.3) | (ratio > 3.0))).groupBy("seq_id").agg(F.count(F.lit(1)).alias("boundary_frames"))
    steps = moves(own).groupBy("seq_id", "frame").agg(F.count_if(valid()).alias("n"), F.count("step").alias("k"), F.avg("step").alias("step"))
    step = F.when(F.col("k") > 3, F.col("step"))
    sums = steps.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("frames"), (F.avg("n") / len(hand) * 100).alias("coverage"), F.coalesce(F.avg(step), F.lit(0.0)).alias("mean_jitter"), F.coalesce(F.percentile(step, F.lit(0.95)), F.lit(0.0)).alias("p95_jitter")
    )
    both = sums.join(wrong, "seq_id", "left").withColumn("boundary_frames", F.coalesce("boundary_frames", F.lit(0)))
    score = (
        100.0
        - F.when(F.col("coverage") < 50, (50 - F.col("coverage")) * 0.5).otherwise(0.0)
        - F.when(F.col("mean_jitter") > 20, (F.col("mean_jitter") - 20) * 0.3).otherwise(0.0)
        - F.when(F.col("boundary_frames") > F.col("frames") * 0.1, 15.0).otherwise(0.0)
    )
    both = both.withColumn("score", F.greatest(score, F.lit(0.0)))
    return both.select("seq_id", "coverage", "boundary_frames", (F.col("boundary_frames") / F.col("frames") * 100).alias("boundary_rate"), "mean_jitter", "p95_jitter", "score", _severity(F.col("score")).alias("severity"))


def face_quality(points: DataFrame, face: list[int], nose: int = 0, flat_points: int = 10, jitter_points: int = 100, jitter_pairs: int = 50) -> DataFrame:
    """Per sequence: coverage, depth by width and frames in which the face collapses, wander about the nose, jitter, a score of 100 and its class."""
    own = points.where(F.col("joint").isin(face))
    steps = moves(own).groupBy("seq_id", "frame").agg(
        F.count_if(valid()).alias("n"),
        *[F.avg(F.when(valid(), F.col(c))).alias(f"c{c}") for c in "xyz"],
        _range("z").alias("deep"),
        _range("x", "y").alias("wide"),
        F.count("step").alias("k"),
        F.avg("step").alias("step"),
    )
    w = by(["seq_id"])
    steps = steps.withColumns({"before": F.lag("n").over(w), "depth": F.when(F.col("n") > flat_points, F.col("deep") / F.greatest(F.col("wide"), F.lit(1e-6)))})
    tip = points.where((F.col("joint") == nose) & valid()).select("seq_id", "frame", *[F.col(c).alias(f"n{c}") for c in "xyz"])
    steps = steps.join(tip, ["seq_id", "frame"], "left").withColumn("off", _apart("c", "n"))
    jitter = F.when((F.col("n") > jitter_points) & (F.col("before") > jitter_points) & (F.col("k") > jitter_pairs) & (F.col("step") > 0), F.col("step"))
    depth = F.when(F.col("depth") > 0, F.col("depth"))
    sums = steps.groupBy("seq_id").agg(
        (F.avg("n") / len(face) * 100).alias("coverage"),
        F.coalesce(F.avg(depth), F.lit(0.0)).alias("mean_depth"),
        F.count_if(depth < 0.05).alias("collapsed"),
        F.when(F.count("off") > 5, F.stddev_pop("off")).otherwise(0.0).alias("nose_wander"),
        F.coalesce(F.avg(jitter), F.lit(0.0)).alias("mean_jitter"),
    )
    score = (
        100.0
        - F.when(F.col("coverage") < 50, (50 - F.col("coverage")) * 0.5).otherwise(0.0)
        - F.least(F.col("collapsed") * 2, F.lit(30))
        - F.when(F.col("nose_wander") > 30, F.least((F.col("nose_wander") - 30) * 0.5, F.lit(20.0))).otherwise(0.0)
        - F.when(F.col("mean_jitter") > 15, F.least((F.col("mean_jitter") - 15) * 0.5, F.lit(15.0))).otherwise(0.0)
    )
    sums = sums.withColumn("score", F.greatest(score, F.lit(0.0)))
    return sums.select("seq_id", "coverage", "mean_depth", "collapsed", "nose_wander", "mean_jitter", "score", _severity(F.col("score")).alias("severity"))


def hand_frames(points: DataFrame, hand: list[int]) -> DataFrame:
    """(seq_id, frame, quality, whole): share of points that are there, less where the hand leaps by many times its median motion."""
    w = by(["seq_id", "joint"])
    own = points.where(F.col("joint").isin(hand))
    step = F.sqrt(sum(F.coalesce(F.pow(F.col(c) - F.lag(c).over(w), 2), F.lit(0.0)) for c in "xyz"))
    frames = own.withColumn("step", F.when(F.lag("frame").over(w).isNotNull(), step)).groupBy("seq_id", "frame").agg((F.count_if(valid()) / len(hand)).alias("share"), (F.count_if(valid()) == len(hand)).alias("whole"), F.sum("step").alias("moved"))
    usual = frames.groupBy("seq_id").agg(median("moved").alias("usual"))
    usual = F.when(F.col("usual") > 0, F.col("usual")).otherwise(1.0), usual
    smooth = F.coalesce(F.greatest(1 - F.col("moved") / (usual[0] * 5 + 1e-8), F.lit(0.0)), F.lit(1.0))
    return frames.join(usual[1], "seq_id").select("seq_id", "frame", (F.col("share") * smooth).alias("quality"), "whole")


def blend_hands(points: DataFrame, other: DataFrame, confidence: DataFrame, hand: list[int], limit: float = 0.3, width: int = 5) -> DataFrame:
    """``points`` with the hand of another tracker where the own one is poor or has gaps and the other is sure of its own.

    ``confidence`` is (seq_id, frame, conf) of the other. After a taken-over run, from the second frame on, the weight of the other is k / (width + 1) in
    the k-th of up to ``width`` frames. A point that one tracker lacks counts as the origin in the blend; one that both lack is missing.
    """
    frames = hand_frames(points, hand).join(confidence, ["seq_id", "frame"])
    frames = frames.withColumn("use", (F.col("conf") > limit) & ((F.col("quality") < limit) | ~F.col("whole")))
    past = F.last(F.when(F.col("use"), F.col("frame")), ignorenulls=True).over(by(["seq_id"]).rowsBetween(-(width + 1), 0))
    k = F.col("frame") - past - 1
    weight = F.when(F.col("use"), 1.0).when(k.between(1, width), k / (width + 1.0))
    frames = frames.select("seq_id", "frame", weight.alias("weight")).where("weight > 0")
    theirs = other.where(F.col("joint").isin(hand)).select("seq_id", "frame", "joint", *[F.col(c).alias(f"o{c}") for c in "xyz"])
    mixed = theirs.join(frames, ["seq_id", "frame"])
    both = points.join(mixed, ["seq_id", "frame", "joint"], "left")
    here, there = valid(), valid("ox", "oy", "oz")

    def blended(c: str) -> Column:
        mix = (1 - F.col("weight")) * F.when(here, F.col(c)).otherwise(0.0) + F.col("weight") * F.when(there, F.col(f"o{c}")).otherwise(0.0)
        return F.when(F.col("weight").isNull(), F.col(c)).when(here | there, mix).alias(c)

    return both.select("seq_id", "frame", "joint", *[blended(c) for c in "xyz"])
