"""Reports of a whole recording: detector drift, calibration health, what deblurring may gain, two trackers against each other.

Sequences are keyed by ``seq_id``; statistics of a sequence are aggregates joined back by it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.geometry import project, valid
from .windows import by, corr, moves


def flag_counts(flags: DataFrame) -> DataFrame:
    """(seq_id, category, severity, n, frames) of outlier flags; null category or severity counts all of them."""
    return flags.cube("seq_id", "category", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame").alias("frames"), F.grouping("seq_id").alias("g")).where("g = 0").drop("g")


# ---- detector drift ----


def detection_metrics(dets: DataFrame) -> DataFrame:
    """(seq_id, frame, n_detections, confidence, min_confidence, max_confidence, mean_area, completeness) of detections (seq_id, frame, w, h, conf).

    Without keypoints a detection counts as complete.
    """
    area = F.greatest(F.lit(1.0), F.col("w") * F.col("h"))
    frames = dets.groupBy("seq_id", "frame").agg(F.count(F.lit(1)).alias("n_detections"), F.bround(F.avg("conf"), 4).alias("confidence"), F.bround(F.min("conf"), 4).alias("min_confidence"), F.bround(F.max("conf"), 4).alias("max_confidence"), F.bround(F.avg(area), 1).alias("mean_area"))
    return frames.withColumn("completeness", F.lit(1.0))


def skeleton_metrics(points: DataFrame) -> DataFrame:
    """(seq_id, frame, n_detections, confidence, completeness) of skeletons: the share of points there are; a frame without any has no detection."""
    share = F.count_if(valid()) / F.count(F.lit(1))
    return points.groupBy("seq_id", "frame").agg((F.count_if(valid()) > 0).cast("long").alias("n_detections"), F.bround(share, 4).alias("confidence"), F.bround(share, 4).alias("completeness"))


def drift_report(metrics: DataFrame, first: int = 30, last: int = 50, limits: tuple[float, float, float] = (0.15, 0.20, 0.30)) -> DataFrame:
    """Per sequence: frames, means of the first frames and of the last, alerts by severity, the drift score and its level.

    From the frame on that completes the first ones, a metric that fell by more than its limit against their mean is an
    alert, by more than twice that a high one. Sequences with fewer frames have no baseline, alerts or score.
    """
    names = {"confidence": (limits[0], 0.01), "completeness": (limits[1], 0.01), "n_detections": (limits[2], 0.0)}
    # Only the ends of a sequence are ranked (Spark drops the rest before the rows of a sequence meet); the frames are judged where they lie.
    ends = lambda order, n: metrics.withColumn("k", F.row_number().over(Window.partitionBy("seq_id").orderBy(order))).where(F.col("k") <= n)
    base = ends(F.asc("frame"), first).groupBy("seq_id").agg(F.count(F.lit(1)).alias("nb"), F.max("frame").alias("since"), *[F.avg(c).alias(f"base_{c}") for c in names]).where(F.col("nb") == first).drop("nb")
    now = ends(F.desc("frame"), last).groupBy("seq_id").agg(*[F.bround(F.avg(c), 4).alias(f"now_{c}") for c in ("confidence", "completeness")])
    both = metrics.join(F.broadcast(base), "seq_id", "left")  # a row for each sequence
    drop = {c: (F.col(f"base_{c}") - F.col(c)) / (F.greatest(F.lit(least), F.col(f"base_{c}")) if least else F.when(F.col(f"base_{c}") > 0, F.col(f"base_{c}"))) for c, (_, least) in names.items()}
    high = sum(F.coalesce((drop[c] > 2 * limit).cast("int"), F.lit(0)) for c, (limit, _) in names.items())
    every = sum(F.coalesce((drop[c] > limit).cast("int"), F.lit(0)) for c, (limit, _) in names.items())
    after = F.col("frame") >= F.col("since")
    judged = both.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.first(f"base_{c}").alias(f"base_{c}") for c in names],
        F.coalesce(F.sum(F.when(after, high)), F.lit(0)).cast("long").alias("high_alerts"),
        F.coalesce(F.sum(F.when(after, every - high)), F.lit(0)).cast("long").alias("moderate_alerts"),
    )
    out = judged.join(now.withColumnRenamed("seq_id", "of"), F.col("seq_id").eqNullSafe(F.col("of"))).select("seq_id", "frames", *[f"base_{c}" for c in names], "now_confidence", "now_completeness", "high_alerts", "moderate_alerts")
    score = F.bround(F.round(F.abs(F.col("base_confidence") - F.col("now_confidence")) * 50 + F.abs(F.col("base_completeness") - F.col("now_completeness")) * 50, 9), 3)
    out = out.withColumn("score", F.coalesce(score, F.lit(0.0)))
    s = F.col("score")
    return out.withColumn("level", F.when(s < 0.05, "stable").when(s < 0.15, "minor").when(s < 0.30, "moderate").otherwise("significant"))


# ---- calibration health ----


def trajectory_roughness(points: DataFrame) -> DataFrame:
    """(seq_id, frame, v): the mean change of speed of the points from one step to the next, 0 in the first and last frame."""
    w = by(["seq_id", "joint"])
    after = F.lead("step").over(w)
    frames = moves(points).withColumn("change", F.abs(after - F.col("step"))).groupBy("seq_id", "frame").agg(F.avg("change").alias("v"))
    ends = points.groupBy("seq_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return frames.join(ends, "seq_id").select("seq_id", "frame", F.when((F.col("frame") == F.col("a")) | (F.col("frame") == F.col("b")), 0.0).otherwise(F.col("v")).alias("v"))


def _against_first(errors: DataFrame, window: int) -> DataFrame:
    """Errors with the mean and deviation of the first ``window`` frames (of all, where there are no more)."""
    known = errors.where("v is not null")
    ranked = known.withColumn("k", F.row_number().over(by(["seq_id"]))).join(known.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")), "seq_id")
    base = ranked.where(F.col("k") <= window).groupBy("seq_id").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(1e-8)).alias("sd"))
    return ranked.join(base, "seq_id")


def drift_signals(errors: DataFrame, window: int = 30, sigmas: float = 3.0) -> DataFrame:
    """(seq_id, start, length, severity): runs of frames over the first ones' mean + sigmas * deviation; severity is in deviations."""
    judged = _against_first(errors, window)
    high = judged.where(F.col("v") > F.col("mean") + sigmas * F.col("sd")).withColumn("run", F.col("k") - F.row_number().over(by(["seq_id"])))
    return high.groupBy("seq_id", "run").agg(F.min("frame").alias("start"), F.count(F.lit(1)).alias("length"), F.max((F.col("v") - F.col("mean")) / F.col("sd")).alias("severity")).drop("run")


def calibration_health(errors: DataFrame, window: int = 30, sigmas: float = 3.0) -> DataFrame:
    """(seq_id, status, mean_error, trend, signals, severity) of errors (seq_id, frame, v).

    The trend compares the halves of the recording, by a fifth; a signal of over twice ``sigmas`` makes it unreliable.
    """
    judged = _against_first(errors, window)
    half = F.floor(F.col("n") / 2)
    mean = lambda when: F.avg(F.when(when, F.col("v")))
    stats = judged.groupBy("seq_id").agg(F.avg("v").alias("mean_error"), F.first("n").alias("n"), mean(F.col("k") <= half).alias("a"), mean(F.col("k") > half).alias("b"))
    found = drift_signals(errors, window, sigmas).groupBy("seq_id").agg(F.count(F.lit(1)).alias("signals"), F.max("severity").alias("severity"))
    trend = F.when(F.col("n") <= window, "stable").when(F.col("b") > F.col("a") * 1.2, "increasing").when(F.col("b") < F.col("a") * 0.8, "decreasing").otherwise("stable")
    status = F.when(F.col("severity") > 2 * sigmas, "unreliable").when(F.col("signals") > 0, "drift_detected").otherwise("ok")
    return stats.join(found, "seq_id", "left").select("seq_id", status.alias("status"), "mean_error", trend.alias("trend"), F.coalesce("signals", F.lit(0)).alias("signals"), "severity")


# ---- deblurring ----


def deblur_impact(scores: DataFrame) -> DataFrame:
    """(seq_id, n, correlation, p_value, threshold, advice) of frames' sharpness and tracking quality (seq_id, frame, v, q).

    The threshold is the upper quartile of the sharpness of the frames in the lowest quarter of quality. Correlations of
    all sequences get their p-values in Arrow batches. A sequence without a correlation is not recommended for deblurring.
    """
    rows = scores.where("v is not null and q is not null")
    stats = rows.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), corr("v", "q").alias("r"), F.percentile("q", F.lit(0.25)).alias("q25"), F.percentile("v", F.lit(0.25)).alias("v25"))
    low = rows.join(stats.select("seq_id", "q25"), "seq_id").where("q < q25").groupBy("seq_id").agg(F.percentile("v", F.lit(0.75)).alias("low75"))
    both = stats.join(low, "seq_id", "left").select("seq_id", "n", F.col("r").alias("correlation"), F.coalesce("low75", "v25").alias("threshold"))
    kind = scores.schema["seq_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            p = [None if r is None else numeric.pearson_p(r, n) for r, n in zip(b.column("correlation").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None or x != x else x for x in p], pa.float64())], [*b.schema.names, "p_value"])

    out = both.mapInArrow(run, f"seq_id {kind}, n long, correlation double, threshold double, p_value double")
    r = F.abs("correlation")
    advice = F.when((r > 0.5) & (F.col("p_value") < 0.05), "deblur likely helps").when((r > 0.25) & (F.col("p_value") < 0.1), "marginal benefit").otherwise("not recommended")
    return out.withColumn("advice", advice)


# ---- two trackers ----


def cross_tracker(a: DataFrame, b: DataFrame, cameras: DataFrame, width: float = 640.0, height: float = 480.0) -> DataFrame:
    """(seq_id, cam, a_error, b_error, distance, agreement, suspect): two trackers' points seen by every camera (cam, p).

    Errors are mean distances from the image centre in hundredths of the longer side, over points within the image;
    ``distance`` is that of the two projections in pixels. Agreement of the recording is one less the greatest camera's
    distance as a share of the diagonal. A camera is suspect where both errors exceed the upper quartile of all errors.
    """
    eye = lambda df, x: df.where(valid() & (F.col("z") > 1e-8)).join(F.broadcast(cameras.select("cam", "p")), how="cross").select("seq_id", "frame", "joint", "cam", *_seen(x))
    both = eye(a, "a").join(eye(b, "b"), ["seq_id", "frame", "joint", "cam"], "full")
    inside = lambda x: (F.col(f"{x}u") >= 0) & (F.col(f"{x}u") < width) & (F.col(f"{x}v") >= 0) & (F.col(f"{x}v") < height)
    apart = lambda du, dv: F.sqrt(du * du + dv * dv)
    error = lambda x: F.avg(F.when(inside(x), apart(F.col(f"{x}u") - width / 2, F.col(f"{x}v") - height / 2) / max(width, height) * 0.01))
    cams = both.groupBy("seq_id", "cam").agg(error("a").alias("a_error"), error("b").alias("b_error"), F.avg(apart(F.col("au") - F.col("bu"), F.col("av") - F.col("bv"))).alias("distance"))
    errors = cams.select("seq_id", F.explode(F.array("a_error", "b_error")).alias("e"))
    limit = errors.groupBy("seq_id").agg(F.coalesce(F.percentile("e", F.lit(0.75)), F.lit(0.0)).alias("limit"))
    most = cams.groupBy("seq_id").agg(F.max("distance").alias("most"))
    agreement = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("most") / (width**2 + height**2) ** 0.5)), F.lit(0.0))
    suspect = F.coalesce((F.col("a_error") > F.col("limit")) & (F.col("b_error") > F.col("limit")), F.lit(False))
    return cams.join(limit, "seq_id").join(most, "seq_id").select("seq_id", "cam", "a_error", "b_error", "distance", agreement.alias("agreement"), suspect.alias("suspect"))


def _seen(x: str) -> list:
    """Pixels of a point in front of the camera, named by ``x``."""
    u, v = project("p", "x", "y", "z")
    depth = F.get("p", F.lit(8)) * F.col("x") + F.get("p", F.lit(9)) * F.col("y") + F.get("p", F.lit(10)) * F.col("z") + F.get("p", F.lit(11))
    return [F.when(depth > 1e-8, u).alias(f"{x}u"), F.when(depth > 1e-8, v).alias(f"{x}v")]


def cross_tracker_advice(report: DataFrame) -> DataFrame:
    """(seq_id, suspects, agreement, finding) of ``cross_tracker``: suspect cameras, else low agreement, else nothing."""
    out = report.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.when(F.col("suspect"), F.col("cam")))).alias("suspects"), F.first("agreement").alias("agreement"))
    return out.withColumn("finding", F.when(F.size("suspects") > 0, "calibration").when(F.col("agreement") < 0.5, "synchronisation or identity").otherwise("none"))
