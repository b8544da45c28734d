"""Gaps, outliers and interpolation of channels and skeletons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import valid
from ..layouts import body
from .windows import by, islands, median, moves, neighbours

MAD = 1.4826


def fill_linear(channels: DataFrame, keys: list[str], max_gap: int = 10, min_valid: int = 2) -> DataFrame:
    """Interior gaps of up to ``max_gap`` frames filled by straight lines; adds ``filled``."""
    seen = F.count("v").over(Window.partitionBy(*keys))
    gap = F.col("next_f") - F.col("prev_f") - 1
    line = F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * (F.col("frame") - F.col("prev_f")) / (F.col("next_f") - F.col("prev_f"))
    fill = F.col("v").isNull() & F.coalesce(gap.between(1, max_gap), F.lit(False)) & (F.col("__seen") >= min_valid)
    out = neighbours(channels.withColumn("__seen", seen), keys).withColumn("filled", fill).withColumn("v", F.when(F.col("filled"), line).otherwise(F.col("v")))
    return out.select(*channels.columns, "filled")


def step_outliers(channels: DataFrame, keys: list[str], threshold: float = 5.0, min_valid: int = 10) -> DataFrame:
    """(keys, before, after, diff): steps between consecutive valid samples beyond ``threshold`` robust deviations of the median step."""
    w = by(keys)
    steps = channels.where("v is not null").select(*keys, F.lag("frame").over(w).alias("before"), F.col("frame").alias("after"), (F.col("v") - F.lag("v").over(w)).alias("diff")).where("diff is not null")
    med = steps.groupBy(*keys).agg(median("diff").alias("med"), F.count(F.lit(1)).alias("n"))
    off = steps.join(med, keys).withColumn("off", F.abs(F.col("diff") - F.col("med")))
    mad = off.groupBy(*keys).agg(median("off").alias("mad"))
    enough = (F.col("n") > 5) & (F.col("n") + 1 >= min_valid) & (F.col("mad") > 0)
    return off.join(mad, keys).where(enough & (F.col("off") > threshold * F.col("mad") * MAD)).select(*keys, "before", "after", "diff")


def fill_and_erase(channels: DataFrame, keys: list[str], max_gap: int = 10, threshold: float = 5.0) -> DataFrame:
    """Short gaps filled, then every frame from one end of an outlying step of the original samples to the other erased; adds ``filled`` and ``erased``."""
    filled = fill_linear(channels, keys, max_gap, min_valid=3)
    bad = step_outliers(channels, keys, threshold, min_valid=3).select(*keys, F.explode(F.sequence("before", "after")).alias("frame")).distinct().withColumn("erased", F.lit(True))
    out = filled.join(bad, [*keys, "frame"], "left").withColumn("erased", F.coalesce("erased", F.lit(False)))
    return out.withColumn("v", F.when(~F.col("erased"), F.col("v"))).select(*channels.columns, "filled", "erased")


def fill_edges(channels: DataFrame, keys: list[str]) -> DataFrame:
    """Straight lines inside, the nearest sample outside: every frame of a channel with a sample has a value."""
    line = F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * (F.col("frame") - F.col("prev_f")) / (F.col("next_f") - F.col("prev_f"))
    return neighbours(channels, keys).withColumn("v", F.coalesce("v", line, "prev_v", "next_v")).select(*channels.columns)


def channel_gaps(channels: DataFrame, keys: list[str], fps: float = 30.0) -> DataFrame:
    """Runs of missing samples with their class by length."""
    seconds = F.col("length") / fps
    kind = F.when(seconds < 0.1, "short").when(seconds < 0.5, "medium").when(seconds < 2.0, "long").otherwise("critical")
    return islands(channels, keys, F.col("v").isNull()).withColumn("kind", kind)


def body_gaps(points: DataFrame) -> DataFrame:
    """Per sequence: frames in which any body coordinate is missing, their runs, and how clustered the runs are."""
    frames = body(points).groupBy("seq_id", "frame").agg(F.max(F.when(~valid(), 1).otherwise(0)).alias("gap"))
    runs = islands(frames, ["seq_id"], F.col("gap") == 1)
    starts = runs.withColumn("apart", F.col("start") - F.lag("start").over(by(["seq_id"], "start")))
    spread = F.stddev_pop("apart") / F.avg("apart")
    gaps = starts.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("length").alias("gap_frames"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"), F.when(F.count(F.lit(1)) >= 3, spread).alias("cv"))
    return gaps.withColumn("clustering", F.when(F.col("cv") > 2, "highly clustered").when(F.col("cv") > 1, "moderately clustered").when(F.col("cv").isNotNull(), "evenly spread").otherwise("insufficient"))


def worst_joints(points: DataFrame, top: int = 5) -> DataFrame:
    """The joints of each sequence that miss the most samples (ties: the lower joint)."""
    counts = points.groupBy("seq_id", "joint").agg(F.count_if(F.col("x").isNull()).alias("missing"))
    rank = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("missing"), "joint"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def time_drift(points: DataFrame, limit: float = 3.0) -> DataFrame:
    """Frames whose mean displacement is far from the median, in robust deviations: (seq_id, frame, mean_step, z)."""
    steps = moves(points).groupBy("seq_id", "frame").agg(F.count("step").alias("n"), F.avg("step").alias("mean_step")).where("n > 3")
    positive = F.when(F.col("mean_step") > 0, F.col("mean_step"))
    med = steps.groupBy("seq_id").agg(median(positive).alias("med"), F.count(positive).alias("k")).where("k >= 10")
    off = steps.join(med, "seq_id").withColumn("off", F.abs(F.col("mean_step") - F.col("med")))
    mad = off.groupBy("seq_id").agg(median(F.when(F.col("mean_step") > 0, F.col("off"))).alias("mad")).where("mad > 0")
    return off.join(mad, "seq_id").withColumn("z", F.col("off") / (F.col("mad") * MAD)).where(F.col("z") > limit).select("seq_id", "frame", "mean_step", "z")


def swaps(points: DataFrame, left: int, right: int) -> DataFrame:
    """Frames where the side of a left-right pair flips against the previous valid frame: (seq_id, frame, dist)."""
    l, r = (points.where(F.col("joint") == j).select("seq_id", "frame", *[F.col(c).alias(f"{n}{c}") for c in "xyz"]) for j, n in ((left, "l"), (right, "r")))
    both = l.join(r, ["seq_id", "frame"]).where(valid("lx", "ly", "lz", "rx", "ry", "rz"))
    both = both.withColumn("side", F.signum(F.col("lx") - F.col("rx"))).withColumn("dist", F.sqrt(sum((F.col(f"l{c}") - F.col(f"r{c}")) * (F.col(f"l{c}") - F.col(f"r{c}")) for c in "xyz")))
    w = by(["seq_id"])
    return both.withColumns({"was": F.lag("side").over(w), "was_dist": F.lag("dist").over(w)}).where((F.col("side") * F.col("was") < 0) & (F.col("dist") > 0.1 * F.col("was_dist")) & (F.col("frame") >= 2)).select("seq_id", "frame", "dist")


def frame_confidence(points: DataFrame) -> DataFrame:
    """0.6 visibility + 0.4 smoothness of the body in each frame; the first and last have smoothness one half.

    Smoothness falls with the mean change of a coordinate and the mean second difference, over joints there in three frames in a row.
    """
    w = by(["seq_id", "joint"])
    p = body(points).withColumns({f"{n}{c}": F.lag(c, k).over(w) for c in "xyz" for n, k in (("a", 1), ("b", -1))})
    speed = sum(F.abs(F.col(c) - F.col(f"a{c}")) for c in "xyz") / 3
    accel = sum(F.abs(F.col(f"b{c}") - 2 * F.col(c) + F.col(f"a{c}")) for c in "xyz") / 3
    frames = p.withColumns({"speed": F.when(accel.isNotNull(), speed), "accel": accel}).groupBy("seq_id", "frame").agg(F.avg(valid().cast("double")).alias("visibility"), F.avg("speed").alias("speed"), F.avg("accel").alias("accel"), F.count("accel").alias("n"))
    smooth = F.when(F.col("n") > 3, 1 / (1 + 10 * F.col("speed") + 5 * F.col("accel"))).otherwise(0.5)
    return frames.select("seq_id", "frame", "visibility", (0.6 * F.col("visibility") + 0.4 * smooth).alias("confidence"))


def nearest_detection(keyed: DataFrame, wanted: DataFrame, keys: list[str], method: str = "linear") -> DataFrame:
    """Values at ``wanted`` frames from the detections before and after: on a line, or of the nearer (ties: the earlier)."""
    spine = wanted.select(*keys, "frame").distinct().join(keyed.select(*keys, "frame", "v"), [*keys, "frame"], "left")
    near = neighbours(spine.unionByName(keyed.select(*keys, "frame", "v")).distinct(), keys)
    a = (F.col("frame") - F.col("prev_f")) / (F.col("next_f") - F.col("prev_f"))
    line = F.col("prev_v") + a * (F.col("next_v") - F.col("prev_v"))
    pick = line if method == "linear" else F.when(a <= 0.5, F.col("prev_v")).otherwise(F.col("next_v"))
    return near.withColumn("v", F.coalesce("v", pick, "prev_v", "next_v")).join(wanted.select(*keys, "frame").distinct(), [*keys, "frame"], "left_semi").select(*keys, "frame", "v")
