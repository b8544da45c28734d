"""Two cameras at a time: whole poses matched by epipolar distance and likeness, how sure the matches are, and how they fare
where people are close.

Detections are keypoints (keys, cam, det_pos, joint, u, v, conf); ``keys`` name a frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.geometry import sampson_distance
from .cameras import few_rows

PAIR = ["cam_a", "cam_b"]


def pose_costs(dets: DataFrame, pairs: dict[tuple[int, int], np.ndarray], keys: tuple[str, ...] = ("frame",), conf: float = 0.3, limit: float = 5.0, scale: float = 50.0) -> DataFrame:
    """(keys, cam_a, cam_b, i, j, epi, likeness, sure, cost) of detections of two cameras whose mean Sampson distance is at most ``limit``.

    Joints count that both are sure of. Likeness is exp(-mean pixel distance / scale); ``sure`` the mean confidence of
    both detections; the cost is the distance times (2 - likeness).
    """
    rows = [(a, b, [float(x) for x in f.ravel()]) for (a, b), f in pairs.items()]
    dim = F.broadcast(dets.sparkSession.createDataFrame(rows, "cam_a int, cam_b int, f array<double>"))
    known = dets.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    mean = dets.groupBy(*keys, "cam", "det_pos").agg(F.avg("conf").alias("sure"))
    own = known.where(F.col("conf") > conf).select(*keys, "cam", "det_pos", "joint", "u", "v")
    a = own.withColumnsRenamed({"cam": "cam_a", "det_pos": "i", "u": "ua", "v": "va"}).join(dim, "cam_a")
    b = own.withColumnsRenamed({"cam": "cam_b", "det_pos": "j", "u": "ub", "v": "vb"})
    far = F.sqrt((F.col("ua") - F.col("ub")) * (F.col("ua") - F.col("ub")) + (F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb")))
    epi = sampson_distance([F.get("f", F.lit(k)) for k in range(9)], "ua", "va", "ub", "vb")
    both = a.join(b, [*keys, "joint", "cam_b"]).groupBy(*keys, *PAIR, "i", "j").agg(F.avg(epi).alias("epi"), F.exp(-F.avg(far) / scale).alias("likeness")).where(F.col("epi") <= limit)
    for side, pos in (("cam_a", "i"), ("cam_b", "j")):
        both = both.join(mean.withColumnsRenamed({"cam": side, "det_pos": pos, "sure": f"sure_{pos}"}), [*keys, side, pos])
    return both.withColumn("sure", (F.col("sure_i") + F.col("sure_j")) / 2).withColumn("cost", F.col("epi") * (2 - F.col("likeness"))).select(*keys, *PAIR, "i", "j", "epi", "likeness", "sure", "cost")


def match_poses(dets: DataFrame, pairs: dict[tuple[int, int], np.ndarray], keys: tuple[str, ...] = ("frame",), conf: float = 0.3, limit: float = 5.0, sure_from: float = 0.6, filler: float = 1000.0) -> DataFrame:
    """(keys, cam_a, cam_b, i, j, cost, confidence, ambiguous): the matches of least total cost of every camera pair and frame.

    A match costs less than ``limit``. Its confidence weighs the detections' own (0.3), the epipolar distance as a share
    of the limit (0.4) and likeness (0.3); below ``sure_from`` it is ambiguous. A row of the assignment is a frame of a
    camera pair, and a call solves a whole batch, some rows at a time.
    """
    costs = pose_costs(dets, pairs, keys, conf, limit)
    edges = costs.groupBy(*keys, *PAIR).agg(F.collect_list(F.struct("i", "j", "cost", "epi", "likeness", "sure")).alias("edges"))
    kinds = ", ".join(f"{k} {dets.schema[k].dataType.simpleString()}" for k in keys)
    names = ["i", "j", "cost", "epi", "likeness", "sure"]

    def run(batches):
        for b in few_rows(batches):
            at, out = [], []
            for row, es in enumerate(b.column("edges").to_pylist()):
                left, right = sorted({e["i"] for e in es}), sorted({e["j"] for e in es})
                place = {p: k for k, p in enumerate(left)}, {p: k for k, p in enumerate(right)}
                cost, which = np.full((len(left), len(right)), np.inf), {}
                for e in es:
                    k = place[0][e["i"]], place[1][e["j"]]
                    cost[k], which[k] = e["cost"], e
                hit = [which[k] for k in numeric.assign(cost, filler) if cost[k] < limit]
                at += [row] * len(hit)
                out += hit
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k).take(pick) for k in (*keys, *PAIR)] + [pa.array([e[n] for e in out], pa.int32() if n in "ij" else pa.float64()) for n in names], [*keys, *PAIR, *names])

    found = edges.mapInArrow(run, f"{kinds}, cam_a int, cam_b int, i int, j int, cost double, epi double, likeness double, sure double")
    confidence = 0.3 * F.col("sure") + 0.4 * F.greatest(F.lit(0.0), 1 - F.col("epi") / limit) + 0.3 * F.col("likeness")
    return found.withColumn("confidence", confidence).select(*keys, *PAIR, "i", "j", "cost", "confidence", (F.col("confidence") < sure_from).alias("ambiguous"))


def unmatched(dets: DataFrame, matches: DataFrame, pairs: list[tuple[int, int]], keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(keys, cam_a, cam_b, cam, det_pos): detections that a camera pair leaves without a match, in frames that both cameras have."""
    each = dets.select(*keys, "cam", "det_pos").distinct()
    dim = F.broadcast(dets.sparkSession.createDataFrame(pairs, "cam_a int, cam_b int"))
    cams = each.select(*keys, "cam").distinct()
    frames = cams.withColumnRenamed("cam", "cam_a").join(dim, "cam_a").join(cams.withColumnRenamed("cam", "cam_b"), [*keys, "cam_b"])
    sides = [(side, pos) for side, pos in (("cam_a", "i"), ("cam_b", "j"))]
    asked = [each.withColumnsRenamed({"cam": side, "det_pos": pos}).join(frames, [*keys, side]).join(matches.select(*keys, *PAIR, pos), [*keys, *PAIR, pos], "left_anti").select(*keys, *PAIR, F.col(side).alias("cam"), F.col(pos).alias("det_pos")) for side, pos in sides]
    return asked[0].unionByName(asked[1])


def pair_statistics(dets: DataFrame, matches: DataFrame, pairs: list[tuple[int, int]], keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(cam_a, cam_b, frames, matches, per_frame, confident, ambiguous, unmatched) of frames that both cameras have."""
    cams = dets.select(*keys, "cam").distinct()
    dim = F.broadcast(dets.sparkSession.createDataFrame(pairs, "cam_a int, cam_b int"))
    frames = cams.withColumnRenamed("cam", "cam_a").join(dim, "cam_a").join(cams.withColumnRenamed("cam", "cam_b"), [*keys, "cam_b"]).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("frames"))
    found = matches.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("matches"), F.count_if(~F.col("ambiguous")).alias("confident"), F.count_if("ambiguous").alias("ambiguous"))
    rest = unmatched(dets, matches, pairs, keys).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("unmatched"))
    out = frames.join(found, PAIR, "left").join(rest, PAIR, "left").fillna(0, ["matches", "confident", "ambiguous", "unmatched"])
    return out.select(*PAIR, "frames", "matches", (F.col("matches") / F.col("frames")).alias("per_frame"), "confident", "ambiguous", "unmatched")


def crossing_statistics(matches: DataFrame, people: DataFrame, keys: tuple[str, ...] = ("frame",), near: float = 1000.0) -> DataFrame:
    """(crossing, total, confident, ambiguous, confident_percent) of matches in frames whose nearest two people (keys, person, x, y, z) are
    closer than ``near`` and in the others; frames of fewer than two people are left out."""
    other = people.select(*keys, F.col("person").alias("other"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    apart = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "xyz"))
    least = people.join(other, list(keys)).where("person < other").groupBy(*keys).agg((F.min(apart) < near).alias("crossing"))
    found = matches.join(least, list(keys)).groupBy("crossing").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ambiguous")).alias("confident"), F.count_if("ambiguous").alias("ambiguous"))
    return found.withColumn("confident_percent", 100 * F.col("confident") / F.col("total"))
