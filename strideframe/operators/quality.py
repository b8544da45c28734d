"""Recording-quality diagnostics of skeletons, time stamps and detections.

Each takes and returns DataFrames; a report is one row for each sequence. Statistics of a whole sequence are an
aggregate joined back by ``seq_id``, never a window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import layouts
from ..functions.geometry import severity, valid
from .bones import lengths
from .windows import by, corr, islands, median, moves


def outlier_flags(points: DataFrame, nan_ratio: float = 0.3, velocity: float = 50.0, stretch: float = 0.5, jitter: float = 20.0, pairs: list[tuple[int, int]] = layouts.OUTLIER_BONES) -> DataFrame:
    """(seq_id, frame, category, severity, score) of suspicious frames.

    Missing points, teleports, stretched bones, acceleration bursts, sudden appearance and disappearance. Left-right
    asymmetry about a pair's own midpoint is zero by construction, so it adds no rows.
    """
    w = by(["seq_id", "joint"])
    p = moves(points).withColumns({f"n{c}": F.when(F.lead("frame").over(w) == F.col("frame") + 1, F.lead(c).over(w)) for c in "xyz"})
    accel = F.sqrt(sum(F.pow(F.col(f"n{c}") - 2 * F.col(c) + F.col(f"p{c}"), 2) for c in "xyz"))
    frames = p.withColumn("accel", accel).groupBy("seq_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull() & F.col("y").isNull() & F.col("z").isNull()).alias("missing"), F.max("step").alias("step"), F.max("accel").alias("accel"))
    frames = frames.withColumn("was", F.when(F.lag("frame").over(by(["seq_id"])) == F.col("frame") - 1, F.lag("missing").over(by(["seq_id"]))))
    ratio = F.col("missing") / F.col("n")
    flag = lambda when, category, level, score: F.when(when, F.struct(F.lit(category).alias("category"), level.alias("severity"), score.cast("double").alias("score")))
    plain = F.lit("moderate")
    flags = frames.select(
        "seq_id",
        "frame",
        F.explode(
            F.array_compact(
                F.array(
                    flag(ratio > nan_ratio, "nan_ratio", severity(ratio, (0.8, "critical"), (0.5, "high"), otherwise="moderate"), ratio * 10),
                    flag(F.col("step") > velocity, "velocity_spike", severity("step", (3 * velocity, "critical"), otherwise="high"), F.col("step") / velocity),
                    flag(F.col("accel") > jitter, "jitter_burst", severity("accel", (3 * jitter, "high"), otherwise="moderate"), F.col("accel") / jitter),
                    flag((F.col("was") > 0.8 * F.col("n")) & (F.col("missing") < 0.3 * F.col("n")), "sudden_appearance", plain, F.lit(5.0)),
                    flag((F.col("was") < 0.3 * F.col("n")) & (F.col("missing") > 0.8 * F.col("n")), "sudden_disappearance", plain, F.lit(5.0)),
                )
            )
        ).alias("f"),
    ).select("seq_id", "frame", "f.*")
    own = lengths(points, pairs).where("length is not null")
    med = own.groupBy("seq_id", "ord").agg(median("length").alias("med")).where("med >= 1e-6")
    bones = own.join(med, ["seq_id", "ord"]).groupBy("seq_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("length") - F.col("med")) / F.col("med") > stretch).alias("bad")).where("bad >= 2")
    return flags.unionByName(bones.select("seq_id", "frame", F.lit("bone_stretch").alias("category"), F.when(F.col("bad") / F.col("n") > 0.3, "high").otherwise("moderate").alias("severity"), F.col("bad").cast("double").alias("score")))


def worst_frames(flags: DataFrame, top: int = 10) -> DataFrame:
    """The frames of each sequence with the highest sum of scores (ties: the earlier frame)."""
    sums = flags.groupBy("seq_id", "frame").agg(F.round(F.sum("score"), 6).alias("score"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("score"), "frame"))).where(F.col("rank") <= top)


def frame_drops(points: DataFrame, fps: float = 30.0, limit: float = 5000.0, jump: float = 100.0) -> DataFrame:
    """Per sequence: bursts of empty frames, jumps, excessive speed, and the confidence that frames were dropped."""
    step = moves(layouts.body(points)).groupBy("seq_id", "frame").agg(F.count_if(valid()).alias("n_valid"), F.count("step").alias("n"), F.avg("step").alias("mean"), F.max("step").alias("most"))
    w = by(["seq_id"])
    ok = (F.col("n_valid") >= 10) & (F.lag("n_valid").over(w) >= 10) & (F.lag("frame").over(w) == F.col("frame") - 1) & (F.col("n") >= 5)
    step = step.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumns({"speed": F.when(F.col("ok"), F.col("mean") * fps).otherwise(0.0), "most": F.when(F.col("ok"), F.col("most")).otherwise(0.0)})
    bursts = islands(step, ["seq_id"], F.col("n_valid") == 0).groupBy("seq_id").agg(F.count(F.lit(1)).alias("bursts"))
    moving = F.when(F.col("speed") > 0, F.col("speed"))
    stats = step.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("n_valid") == 0).alias("empty_frames"),
        F.count_if(F.col("most") > jump).alias("jumps"),
        F.count_if((F.col("speed") > limit) & (F.col("n_valid") >= 10)).alias("too_fast"),
        F.when(F.count(moving) > 10, median(moving)).otherwise(0.0).alias("median_speed"),
        F.when(F.count(moving) > 10, F.percentile(moving, F.lit(0.95))).otherwise(0.0).alias("p95_speed"),
    )
    both = stats.join(bursts, "seq_id", "left").withColumn("bursts", F.coalesce("bursts", F.lit(0)))
    signs = (F.col("bursts") >= 2).cast("int") + (F.col("jumps") > F.col("frames") * 0.01).cast("int") + (F.col("p95_speed") > 0.8 * limit).cast("int")
    return both.withColumn("confidence", F.element_at(F.array(F.lit(0.0), F.lit(0.3), F.lit(0.6), F.lit(0.9)), signs + 1))


def timestamp_drops(stamps: DataFrame, fps: float = 30.0, tolerance_ms: float = 2.0) -> DataFrame:
    """Per camera: the unit of its stamps, intervals over the ideal, and interval statistics in ms."""
    gaps = stamps.withColumn("gap", F.col("t") - F.lag("t").over(by(["cam"]))).where("gap is not null")
    unit = gaps.groupBy("cam").agg(median("gap").alias("med")).withColumn("scale", F.when(F.col("med") > 10, 1.0).otherwise(1000.0))
    ms = gaps.join(unit, "cam").withColumn("ms", F.col("gap") * F.col("scale"))
    ideal = 1000.0 / fps
    return ms.groupBy("cam").agg(F.count(F.lit(1)).alias("intervals"), F.count_if(F.col("ms") > ideal + tolerance_ms).alias("drops"), F.avg(F.when(F.col("ms") > 0, F.col("ms"))).alias("mean_ms"), F.stddev_pop(F.when(F.col("ms") > 0, F.col("ms"))).alias("std_ms"), F.max("ms").alias("max_ms"))


def shared_drops(stamps: DataFrame, fps: float = 30.0, tolerance_ms: float = 2.0) -> DataFrame:
    """(frame, n_cams, kind): frames dropped by several cameras are correlated, by one specific."""
    gaps = stamps.withColumn("gap", F.col("t") - F.lag("t").over(by(["cam"]))).where("gap is not null")
    unit = gaps.groupBy("cam").agg(median("gap").alias("med"))
    ms = gaps.join(unit, "cam").where(F.col("gap") * F.when(F.col("med") > 10, 1.0).otherwise(1000.0) > 1000.0 / fps + tolerance_ms)
    counts = ms.groupBy("frame").agg(F.count(F.lit(1)).alias("n_cams"))
    return counts.withColumn("kind", F.when(F.col("n_cams") >= 2, "correlated").otherwise("specific"))


def fused_drops(motion: DataFrame, stamps: DataFrame) -> DataFrame:
    """(seq_id, confidence, source) from drops seen in motion (seq_id, confidence) and in time stamps (seq_id, drops, confidence), where there are any."""
    both = motion.select("seq_id", F.col("confidence").alias("m")).join(stamps.select("seq_id", "drops", F.col("confidence").alias("t")), "seq_id", "left")
    moved, dropped = F.col("m") > 0.3, F.col("drops") > 0
    fused = F.when(F.col("drops").isNull(), F.col("m")).when(dropped & moved, F.least(F.lit(0.99), F.greatest("t", "m") + 0.03)).when(dropped, F.col("t")).when(moved, F.col("m") * 0.7).otherwise(F.greatest("t", "m"))
    source = F.when(F.col("drops").isNull(), "motion_only").when(dropped & moved, "both_agree").when(dropped, "timestamps_only").when(moved, "motion_only_possible_artifact").otherwise("neither")
    return both.select("seq_id", fused.alias("confidence"), source.alias("source"))


def desync(points: DataFrame) -> DataFrame:
    """Per sequence: depth jitter against planar jitter, its tie to speed, and a severity."""
    d = [F.col(c) - F.col(f"p{c}") for c in "xyz"]
    step = moves(layouts.body(points)).withColumns({"xy": F.sqrt(d[0] * d[0] + d[1] * d[1]), "dz": F.abs(d[2])})
    frames = step.groupBy("seq_id", "frame").agg(F.count_if(valid()).alias("n_valid"), F.count("step").alias("n"), F.avg(F.when(F.col("step").isNotNull(), F.col("xy"))).alias("xy"), F.avg(F.when(F.col("step").isNotNull(), F.col("dz"))).alias("dz"), F.avg("step").alias("speed"))
    w = by(["seq_id"])
    ok = (F.col("n_valid") > 10) & (F.lag("n_valid").over(w) > 10) & (F.lag("frame").over(w) == F.col("frame") - 1) & (F.col("n") >= 5)
    frames = frames.withColumn("ok", ok).where("ok").withColumn("ratio", F.col("dz") / F.greatest(F.col("xy"), F.lit(1e-8)))
    stats = frames.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), median("ratio").alias("median_ratio"), F.avg("ratio").alias("mean_ratio"), F.percentile("speed", F.lit(0.75)).alias("p75"), F.percentile("speed", F.lit(0.25)).alias("p25"), corr("speed", "ratio").alias("speed_corr"))
    ends = frames.join(stats.select("seq_id", "p75", "p25"), "seq_id").groupBy("seq_id").agg(median(F.when(F.col("speed") > F.col("p75"), F.col("ratio"))).alias("fast_ratio"), median(F.when(F.col("speed") < F.col("p25"), F.col("ratio"))).alias("slow_ratio"))
    out = stats.where("n >= 10").join(ends, "seq_id").select("seq_id", "n", "median_ratio", "mean_ratio", F.coalesce("fast_ratio", "median_ratio").alias("fast_ratio"), F.coalesce("slow_ratio", "median_ratio").alias("slow_ratio"), F.coalesce("speed_corr", F.lit(0.0)).alias("speed_corr"))
    level = F.when((F.col("median_ratio") > 2.5) | (F.col("speed_corr") > 0.5), "high").when((F.col("median_ratio") > 1.5) | (F.col("speed_corr") > 0.3), "moderate").otherwise("low")
    return out.withColumn("severity", level)


def side_asymmetry(points: DataFrame) -> DataFrame:
    """Per sequence: missing rate, jitter between consecutive valid samples, and depth noise of both sides."""
    left = F.col("joint").isin(*layouts.SIDES["left"])
    own = points.where(left | F.col("joint").isin(*layouts.SIDES["right"])).withColumn("side", F.when(left, "left").otherwise("right"))
    rate = own.groupBy("seq_id", "side").agg((F.count_if(F.col("x").isNull()) / F.count(F.lit(1)) * 100).alias("nan_rate"))
    w = by(["seq_id", "joint"])
    step = own.where(valid()).withColumn("step", F.sqrt(sum(F.pow(F.col(c) - F.lag(c).over(w), 2) for c in "xyz")))
    jitter = step.groupBy("seq_id", "side").agg(F.avg("step").alias("jitter"))
    noise = own.groupBy("seq_id", "side", "joint").agg(F.count("z").alias("n"), F.stddev_pop("z").alias("sd")).where("n > 10").groupBy("seq_id", "side").agg(F.avg("sd").alias("depth_noise"))
    sides = rate.join(jitter, ["seq_id", "side"], "left").join(noise, ["seq_id", "side"], "left").fillna(0.0, ["jitter", "depth_noise"])
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
    wide = sides.groupBy("seq_id").agg(*[pick(c, s) for s in ("left", "right") for c in ("nan_rate", "jitter", "depth_noise")])
    diff = {c: F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) for c in ("nan_rate", "jitter", "depth_noise")}
    level = F.when((diff["nan_rate"] > 15) | (diff["jitter"] > 15) | (diff["depth_noise"] > 30), "high").when((diff["nan_rate"] > 5) | (diff["jitter"] > 5) | (diff["depth_noise"] > 10), "moderate").otherwise("low")
    worse = F.when(F.col("left_nan_rate") + F.col("left_jitter") > F.col("right_nan_rate") + F.col("right_jitter"), "left").otherwise("right")
    return wide.withColumns({"worse_side": worse, "severity": level})


def quality_by_position(points: DataFrame, bins: int = 5) -> DataFrame:
    """Per sequence and equal bin of the nose's x: frames, rate of incomplete frames, and jitter between frames of the bin."""
    nose = points.where("joint = 0 and x is not null").select("seq_id", "frame", F.col("x").alias("nx"))
    ends = nose.groupBy("seq_id").agg(F.min("nx").alias("lo"), F.max("nx").alias("hi"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= bins * 5)
    at = F.least(F.floor((F.col("nx") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    binned = nose.join(ends, "seq_id").withColumn("bin", at)
    own = layouts.body(points).join(binned.select("seq_id", "frame", "bin"), ["seq_id", "frame"])
    w = Window.partitionBy("seq_id", "joint", "bin").orderBy("frame")
    step = own.withColumn("step", F.sqrt(sum(F.pow(F.col(c) - F.lag(c).over(w), 2) for c in "xyz")))
    frames = step.groupBy("seq_id", "bin", "frame").agg(F.max((~valid()).cast("int")).alias("gap"), F.count("step").alias("n"), F.avg("step").alias("jitter"))
    return frames.groupBy("seq_id", "bin").agg(F.count(F.lit(1)).alias("frames"), (F.avg("gap") * 100).alias("nan_rate"), F.coalesce(F.avg(F.when(F.col("n") > 3, F.col("jitter"))), F.lit(0.0)).alias("mean_jitter")).where("frames >= 3")


def motion_intensity(points: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Frames whose mean step to the next frame is over mean + sigmas * deviation: (seq_id, frame, mean_step)."""
    step = moves(points).groupBy("seq_id", (F.col("frame") - 1).alias("frame")).agg(F.avg("step").alias("mean_step")).where("mean_step is not null")
    stats = step.groupBy("seq_id").agg((F.avg("mean_step") + sigmas * F.stddev_pop("mean_step")).alias("limit"))
    return step.join(stats, "seq_id").where("mean_step > limit").select("seq_id", "frame", "mean_step")


def blurred(scores: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Per sequence: the threshold mean - sigmas * deviation of blur scores, 5th and 95th percentile, frames below."""
    stats = scores.groupBy("seq_id").agg((F.avg("v") - sigmas * F.stddev_pop("v")).alias("threshold"), F.percentile("v", F.lit(0.05)).alias("p5"), F.percentile("v", F.lit(0.95)).alias("p95"))
    low = scores.join(stats, "seq_id").groupBy("seq_id").agg(F.count_if(F.col("v") < F.col("threshold")).alias("n_blurred"))
    return stats.join(low, "seq_id")


def texture_risk(points: DataFrame, fps: float = 30.0) -> DataFrame:
    """(seq_id, region, quality, jitter, finding): how steady and how jerky a body region is against the others.

    Quality is the mean of one less the region's displacement as a share of its largest; jitter the mean change of speed of its joints. A region
    of high jitter (mean + 1.5 deviations) is interference if its quality is low too (mean - 1), else an artifact; quality below 0.3 is low.
    """
    spark = points.sparkSession
    region = spark.createDataFrame([(j, r) for r, js in layouts.REGIONS.items() for j in js], "joint int, region string")
    own = moves(points).join(F.broadcast(region), "joint")
    w = by(["seq_id", "joint"])
    own = own.withColumn("change", F.abs(F.col("step") - F.when(F.lag("frame").over(w) == F.col("frame") - 1, F.lag("step").over(w))) * fps)
    disp = own.groupBy("seq_id", "region", "frame").agg(F.avg("step").alias("disp")).where("disp is not null")
    most = disp.groupBy("seq_id", "region").agg(F.max("disp").alias("most"))
    steady = F.when(F.col("most") > 1e-8, 1 - F.least(F.col("disp") / F.col("most"), F.lit(1.0))).otherwise(1.0)
    quality = disp.join(most, ["seq_id", "region"]).groupBy("seq_id", "region").agg(F.avg(steady).alias("quality"))
    jitter = own.groupBy("seq_id", "region", "joint").agg(F.avg("change").alias("change")).groupBy("seq_id", "region").agg(F.avg("change").alias("jitter"))
    every = points.select("seq_id").distinct().select("seq_id", F.explode(F.array(*map(F.lit, layouts.REGIONS))).alias("region"))
    both = every.join(quality, ["seq_id", "region"], "left").join(jitter, ["seq_id", "region"], "left").fillna(0.0, ["quality", "jitter"])
    every = Window.partitionBy("seq_id")
    mean = lambda c: F.avg(c).over(every)
    sd = lambda c: F.stddev_pop(c).over(every)
    both = both.withColumns({"mq": mean("quality"), "sq": sd("quality"), "mj": mean("jitter"), "sj": sd("jitter")})
    high = F.when(F.col("sj") > 1e-8, F.col("jitter") > F.col("mj") + 1.5 * F.col("sj")).otherwise(F.col("jitter") > 1.5 * F.col("mj"))
    low = F.when(F.col("sq") > 1e-8, F.col("quality") < F.col("mq") - F.col("sq")).otherwise(F.col("quality") < 0.7 * F.col("mq"))
    return both.select("seq_id", "region", "quality", "jitter", F.when(high & low, "interference").when(high, "artifact").when(F.col("quality") < 0.3, "low quality").alias("finding"))


def calibration_drift(errors: DataFrame, window: int = 30, sigmas: float = 3.0) -> DataFrame:
    """Runs of frames whose error is over the first window's mean + sigmas * deviation: (seq_id, start, end, length, worst)."""
    rank = F.row_number().over(by(["seq_id"]))
    base = errors.where("v is not null").withColumn("k", rank).where(F.col("k") <= window).groupBy("seq_id").agg((F.avg("v") + sigmas * F.stddev_pop("v")).alias("limit"))
    high = errors.join(base, "seq_id").where(F.col("v") > F.col("limit"))
    runs = high.withColumn("g", F.col("frame") - F.row_number().over(by(["seq_id"])))
    return runs.groupBy("seq_id", "g").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("length"), F.max("v").alias("worst")).drop("g")


def drift_alerts(metrics: DataFrame, first: int = 30, limits: tuple[float, float] = (0.15, 0.20)) -> DataFrame:
    """(seq_id, frame, metric, drop, severity): frames whose confidence or completeness fell against the first frames' mean."""
    k = F.row_number().over(by(["seq_id"]))
    ranked = metrics.withColumn("k", k)
    base = ranked.where(F.col("k") <= first).groupBy("seq_id").agg(F.avg("confidence").alias("b0"), F.avg("completeness").alias("b1"))
    later = ranked.where(F.col("k") > first).join(base, "seq_id")
    drops = later.select("seq_id", "frame", F.expr("stack(2, 'confidence', (b0 - confidence) / b0, 'completeness', (b1 - completeness) / b1) as (metric, drop)"))
    limit = F.when(F.col("metric") == "confidence", limits[0]).otherwise(limits[1])
    return drops.where(F.col("drop") > limit).withColumn("severity", F.when(F.col("drop") > 2 * limit, "high").otherwise("moderate"))


def self_occlusion(obs: DataFrame, conf: float = 0.3, ratio: float = 2.0, half: int = 15, width: float = 640.0, height: float = 480.0) -> DataFrame:
    """(seq_id, cam, frame, joint, score, baseline): a camera's mean distance from the others, in units of the image, over ``ratio`` times its centred mean.

    Cameras that are not confident of a joint have the score 0 and count in nobody's mean.
    """
    ok = F.coalesce(F.col("conf") > conf, F.lit(False)) & F.col("u").isNotNull() & F.col("v").isNotNull()
    views = obs.groupBy("seq_id", "frame", "joint").agg(F.collect_list(F.struct("cam", (F.col("u") / width).alias("u"), (F.col("v") / height).alias("v"), ok.alias("ok"))).alias("views"))
    each = views.withColumn("own", F.explode("views"))
    far = F.transform(
        F.filter("views", lambda o: o["ok"] & F.col("own.ok") & (o["cam"] != F.col("own.cam"))),
        lambda o: F.sqrt((o["u"] - F.col("own.u")) * (o["u"] - F.col("own.u")) + (o["v"] - F.col("own.v")) * (o["v"] - F.col("own.v"))),
    )
    score = F.when(F.size(far) > 0, F.aggregate(far, F.lit(0.0), lambda a, d: a + d) / F.size(far)).otherwise(0.0)
    scores = each.select("seq_id", F.col("own.cam").alias("cam"), "frame", "joint", score.alias("score"))
    w = by(["seq_id", "cam", "joint"]).rowsBetween(-half, half)
    return scores.withColumn("baseline", F.avg("score").over(w)).where(F.col("score") > ratio * F.greatest(F.col("baseline"), F.lit(1e-10)))


def edge_reliability(obs: DataFrame, width: float = 640.0, height: float = 480.0, edge: float = 0.7) -> DataFrame:
    """Per camera and joint: the share of observations further from the centre than ``edge`` half diagonals."""
    half = (width**2 + height**2) ** 0.5 / 2
    far = F.sqrt(F.pow(F.col("u") - width / 2, 2) + F.pow(F.col("v") - height / 2, 2)) / half > edge
    return obs.where("u is not null").groupBy("cam", "joint").agg(F.count(F.lit(1)).alias("n"), F.avg(far.cast("double")).alias("edge_share")).withColumn("unreliable", F.col("edge_share") > 0.5)


def joint_coverage(obs: DataFrame, width: float = 640.0, height: float = 480.0, bins: int = 10) -> DataFrame:
    """Per camera and image cell: observations and mean confidence; pixels outside count in the border cells."""
    cell = lambda c, size: F.least(F.greatest(F.floor(F.col(c) / size * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return obs.where("u is not null and v is not null").groupBy("cam", cell("v", height).alias("row"), cell("u", width).alias("col")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"))


def detection_stats(dets: DataFrame) -> DataFrame:
    """Per camera: frames, detections, mean and greatest number in a frame, mean confidence."""
    frames = dets.groupBy("cam", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("conf"))
    return frames.groupBy("cam").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("detections"), F.avg("n").alias("mean_n"), F.max("n").alias("max_n"), (F.sum("conf") / F.sum("n")).alias("mean_conf"))


def hand_jitter(points: DataFrame, joints: list[int]) -> DataFrame:
    """Per sequence: coverage of a set of joints in per cent, mean and 95th percentile of their mean steps."""
    own = moves(points.where(F.col("joint").isin(joints)))
    frames = own.groupBy("seq_id", "frame").agg(F.count_if(valid()).alias("n"), F.avg("step").alias("step"))
    return frames.groupBy("seq_id").agg((F.avg("n") / len(joints) * 100).alias("coverage"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("mean_jitter"), F.coalesce(F.percentile("step", F.lit(0.95)), F.lit(0.0)).alias("p95_jitter"))


def tracker_agreement(a: DataFrame, b: DataFrame, near: float = 20.0) -> DataFrame:
    """Per sequence: mean distance of two skeletons' points, correlation of their planar coordinates, share within ``near`` mm."""
    both = a.join(b.select("seq_id", "frame", "joint", *[F.col(c).alias(f"b{c}") for c in "xyz"]), ["seq_id", "frame", "joint"]).where(valid("x", "y", "z", "bx", "by", "bz"))
    both = both.withColumn("d", F.sqrt(sum(F.pow(F.col(c) - F.col(f"b{c}"), 2) for c in "xyz")))
    flat = both.select("seq_id", "d", F.expr("stack(2, x, bx, y, by) as (va, vb)"))
    flat_corr = flat.groupBy("seq_id").agg(corr("va", "vb").alias("xy_corr"))
    return both.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance"), F.avg((F.col("d") < near).cast("double")).alias("near_share")).join(flat_corr, "seq_id")


def frame_issues(points: DataFrame, low: float = 0.3) -> DataFrame:
    """Per sequence: mean frame confidence (share of valid points), share of good, poor and gap frames."""
    frames = points.groupBy("seq_id", "frame").agg(F.avg(valid().cast("double")).alias("c"))
    return frames.groupBy("seq_id").agg(F.avg("c").alias("mean_confidence"), F.avg((F.col("c") > 0.8).cast("double")).alias("good_share"), F.avg((F.col("c") < 0.5).cast("double")).alias("poor_share"), F.count_if(F.col("c") < low).alias("gap_frames"))


def energy_peaks(audio: DataFrame, window: int = 8, above: float = 3.0) -> DataFrame:
    """(cam, win, db): windows whose short-time energy is a local peak over the median level by ``above`` dB."""
    win = audio.groupBy("cam", F.floor(F.col("idx") / window).alias("win")).agg(F.avg("e").alias("e"))
    db = win.withColumn("db", 10 * F.log10(F.greatest(F.col("e"), F.lit(1e-10))))
    med = db.groupBy("cam").agg((median("db") + above).alias("limit"))
    w = Window.partitionBy("cam").orderBy("win")
    near = db.withColumns({"a": F.lag("db").over(w), "b": F.lead("db").over(w)}).join(med, "cam")
    return near.where((F.col("db") > F.col("limit")) & (F.col("db") > F.col("a")) & (F.col("db") >= F.col("b"))).select("cam", "win", "db")
