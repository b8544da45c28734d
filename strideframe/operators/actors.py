"""Several people: what each camera sees of an actor over time, and their 3-D points.

Detections' keypoints are (seq_id, frame, cam, det_pos, joint, u, v, conf); memberships say which detections of a frame are
one actor (seq_id, frame, cam, det_pos, actor_id); tracks give actors an identity over time (seq_id, frame, actor_id, global_id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from .cameras import view_arrays

FRAME = ["seq_id", "frame"]


def tracked_only(memberships: DataFrame, tracks: DataFrame) -> DataFrame:
    """The memberships of actors that have an identity in their frame."""
    return memberships.join(tracks.where("global_id is not null").select(*FRAME, "actor_id"), [*FRAME, "actor_id"], "left_semi")


def actor_views(memberships: DataFrame, tracks: DataFrame) -> DataFrame:
    """(seq_id, frame, global_id, cam, det_pos): the detection of each identity in each camera; of two in one camera the later."""
    named = tracked_only(memberships, tracks).join(tracks.where("global_id is not null").select(*FRAME, "actor_id", "global_id"), [*FRAME, "actor_id"])
    return named.groupBy(*FRAME, "global_id", "cam").agg(F.max("det_pos").alias("det_pos"))


def actor_boxes(keypoints: DataFrame, memberships: DataFrame, reference: int = 0, conf: float = 0.3, least: int = 3) -> DataFrame:
    """What trackers take: (seq_id, frame, actor_id, x1, y1, x2, y2, conf, feature) of an actor in the reference camera, else in its first.

    The feature is the keypoints sure enough, in the unit of the box and ordered by joint; null where there are fewer than ``least``.
    """
    seen = keypoints.where((F.col("conf") >= conf) & F.col("u").isNotNull() & F.col("v").isNotNull())
    one = memberships.groupBy(*FRAME, "actor_id").agg(F.min_by(F.struct("cam", "det_pos"), F.struct((F.col("cam") != reference).alias("other"), "cam", "det_pos")).alias("at")).select(*FRAME, "actor_id", "at.cam", "at.det_pos")
    points = seen.join(one, [*FRAME, "cam", "det_pos"])
    box = points.groupBy(*FRAME, "actor_id").agg(F.min("u").alias("x1"), F.min("v").alias("y1"), F.max("u").alias("x2"), F.max("v").alias("y2"), F.avg("conf").alias("conf"), F.array_sort(F.collect_list(F.struct("joint", "u", "v"))).alias("ps"))
    unit = lambda p: F.array((p["u"] - F.col("x1")) / F.greatest(F.col("x2") - F.col("x1"), F.lit(1.0)), (p["v"] - F.col("y1")) / F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0)))
    return box.withColumn("feature", F.when(F.size("ps") >= least, F.flatten(F.transform("ps", unit)))).drop("ps")


def triangulate_actors(keypoints: DataFrame, views: DataFrame, cameras: DataFrame, min_cams: int = 2, reject: float | None = None) -> DataFrame:
    """(seq_id, global_id, frame, joint, x, y, z, err, mean_err, n_cams): every identity's points from the cameras that see it.

    ``cameras`` is (cam, p). Views weigh as they are sure. ``err`` is the reprojection error in the first camera used,
    ``mean_err`` that over all. With ``reject``, while a view is off by more pixels than that and more than ``min_cams``
    are left, the one goes without which the others agree best. Points of fewer than ``min_cams`` views are left out.
    """
    seen = keypoints.where(F.col("u").isNotNull() & F.col("v").isNotNull()).join(views, [*FRAME, "cam", "det_pos"]).join(F.broadcast(cameras.select("cam", "p")), "cam")
    view = F.struct("cam", "u", "v", F.coalesce("conf", F.lit(0.0)).alias("w"), "p")
    rows = seen.groupBy("seq_id", "global_id", "frame", "joint").agg(F.array_sort(F.collect_list(view)).alias("views")).where(F.size("views") >= min_cams)
    keys = ["seq_id", "global_id", "frame", "joint"]
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            if b.num_rows:
                p, uv, w, there = view_arrays(b.column("views"))
                x, err, used = numeric.triangulate_robust(p, uv, w, there, reject, min_cams)
                first = err[np.arange(len(x)), np.argmax(used, axis=1)]
                mean = np.where(used, np.nan_to_num(err), 0).sum(1) / used.sum(1)
                out = [*x.T, np.where(np.isnan(x[:, 0]), np.nan, first), np.where(np.isnan(x[:, 0]), np.nan, mean)]
                yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(np.nan_to_num(v), mask=np.isnan(v)) for v in out] + [pa.array(used.sum(1), pa.int32())], [*keys, "x", "y", "z", "err", "mean_err", "n_cams"])

    return rows.mapInArrow(run, f"{kinds}, x double, y double, z double, err double, mean_err double, n_cams int")


def actor_summary(points: DataFrame, views: DataFrame) -> DataFrame:
    """(seq_id, global_id, frames, visible_share, mean_err, mean_joints) of each identity.

    Visible are the frames in which some camera has it, whether or not points came of them.
    """
    visible = views.groupBy("seq_id", "global_id").agg(F.countDistinct("frame").alias("frames"))
    whole = views.groupBy("seq_id").agg(F.countDistinct("frame").alias("all_frames"))
    stats = points.groupBy("seq_id", "global_id").agg(F.avg("err").alias("mean_err"), F.count("x").alias("n"))
    return visible.join(whole, "seq_id").join(stats, ["seq_id", "global_id"], "left").select("seq_id", "global_id", "frames", (F.col("frames") / F.col("all_frames")).alias("visible_share"), "mean_err", (F.coalesce("n", F.lit(0)) / F.col("frames")).alias("mean_joints"))
