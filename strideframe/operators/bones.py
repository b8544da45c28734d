"""Bones: lengths, outliers, rigid correction, proportions and retargeting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import layouts
from ..functions.geometry import valid
from .windows import median


def lengths(points: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(seq_id, frame, ord, parent, child, length), null if an end is missing.

    A bone is an equi-join on (sequence, frame); the bone list is a small fixed table.
    """
    dim = F.broadcast(layouts.bones(points.sparkSession, pairs))
    a = points.join(dim, points.joint == dim.parent).select("seq_id", "frame", "ord", "parent", "child", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    b = points.select("seq_id", "frame", F.col("joint").alias("child"), *[F.col(c).alias(f"c{c}") for c in "xyz"])
    d = sum((F.col(f"p{c}") - F.col(f"c{c}")) * (F.col(f"p{c}") - F.col(f"c{c}")) for c in "xyz")
    return a.join(b, ["seq_id", "frame", "child"]).select("seq_id", "frame", "ord", "parent", "child", F.sqrt(d).alias("length"))


def length_stats(points: DataFrame, pairs: list[tuple[int, int]], limit: float = 0.5) -> DataFrame:
    """Per bone: median and standard deviation of the length, and the share of frames that deviate more than ``limit``."""
    own = lengths(points, pairs).where("length is not null")
    stats = own.groupBy("seq_id", "parent", "child").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"), median("length").alias("median_length"), F.stddev_pop("length").alias("std_length"))
    off = own.join(stats, ["seq_id", "parent", "child"]).groupBy("seq_id", "parent", "child").agg(F.avg((F.abs(F.col("length") - F.col("median_length")) / F.col("median_length") > limit).cast("double")).alias("off_share"))
    return stats.join(off, ["seq_id", "parent", "child"])


def _targets(points: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """One row for each sequence: the median length of each bone, as columns t0, t1, ..."""
    own = lengths(points, pairs).where("length > 1e-8")
    return own.groupBy("seq_id").agg(*[median(F.when(F.col("ord") == k, F.col("length"))).alias(f"t{k}") for k in range(len(pairs))])


def _wide(points: DataFrame, joints: list[int]) -> DataFrame:
    """One row for each frame with a struct column j<k> of each joint (null if it is missing)."""
    point = F.when(valid(), F.struct("x", "y", "z"))
    return points.groupBy("seq_id", "frame").agg(F.count_if(valid()).alias("n_valid"), *[F.first(F.when(F.col("joint") == j, point), ignorenulls=True).alias(f"j{j}") for j in joints])


def _dist(a, b):
    return F.sqrt(sum((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"))


def _narrow(points: DataFrame, wide: DataFrame, joints: list[int]) -> DataFrame:
    """``points`` with the coordinates of ``joints`` taken from the wide rows."""
    rows = wide.select("seq_id", "frame", F.explode(F.array(*[F.struct(F.lit(j).alias("joint"), F.col(f"j{j}").alias("p")) for j in joints])).alias("r")).select("seq_id", "frame", "r.joint", F.col("r.p.x").alias("x"), F.col("r.p.y").alias("y"), F.col("r.p.z").alias("z"))
    return points.where(~F.col("joint").isin(joints)).select("seq_id", "frame", "joint", "x", "y", "z").unionByName(rows.join(points.select("seq_id", "frame", "joint"), ["seq_id", "frame", "joint"], "left_semi"))


def erase_outliers(points: DataFrame, limit: float = 0.60, pairs: list[tuple[int, int]] = layouts.RIGID_BONES) -> DataFrame:
    """Both ends of a bone erased where its length is off its median by more than ``limit``; bones in order, later ones see earlier erasures."""
    joints = sorted({j for p in pairs for j in p})
    wide = _wide(points, joints).join(_targets(points, pairs), "seq_id")
    for k, (p, c) in enumerate(pairs):
        off = F.abs(_dist(F.col(f"j{p}"), F.col(f"j{c}")) - F.col(f"t{k}")) / F.col(f"t{k}")
        bad = F.coalesce(off > limit, F.lit(False))
        wide = wide.withColumn("__bad", bad).withColumns({f"j{j}": F.when(~F.col("__bad"), F.col(f"j{j}")) for j in (p, c)})
    return _narrow(points, wide, joints)


def rigid(points: DataFrame, limit: float = 0.30, pairs: list[tuple[int, int]] = layouts.RIGID_BONES) -> DataFrame:
    """Children moved to the median distance from their corrected parents, root to tip, unless off by more than ``limit``.

    Heels and toes follow their ankle. Chains are two bones deep, so a frame is one row and two nested conditions.
    """
    follow = {27: (29, 31), 28: (30, 32)}
    joints = sorted({j for p in pairs for j in p} | {j for f in follow.values() for j in f})
    wide = _wide(points, joints).join(_targets(points, pairs), "seq_id", "left")
    order = sorted(range(len(pairs)), key=lambda k: pairs[k][0] in {c for _, c in pairs})
    for k in order:
        p, c = pairs[k]
        parent, child, target = F.col(f"j{p}"), F.col(f"j{c}"), F.col(f"t{k}")
        now = _dist(parent, child)
        move = (F.col("n_valid") >= 4) & (target >= 1e-8) & (now >= 1e-8) & (F.abs(now - target) / target <= limit)
        new = F.struct(*[(parent[d] + (child[d] - parent[d]) / now * target).alias(d) for d in "xyz"])
        wide = wide.withColumn("__new", F.when(F.coalesce(move, F.lit(False)), new))
        for f in follow.get(c, ()):
            shift = F.struct(*[(F.col(f"j{f}")[d] + (F.col("__new")[d] - child[d])).alias(d) for d in "xyz"])
            wide = wide.withColumn(f"j{f}", F.when(F.col("__new").isNotNull() & F.col(f"j{f}").isNotNull(), shift).otherwise(F.col(f"j{f}")))
        wide = wide.withColumn(f"j{c}", F.coalesce("__new", f"j{c}"))
    return _narrow(points, wide, joints)


def anchor_feet(before: DataFrame, after: DataFrame, limit_valid: int = 10) -> DataFrame:
    """Heels and toes that a fill made valid are put at the median offset from their ankle."""
    pairs = [(27, 29), (27, 31), (28, 30), (28, 32)]
    dim = F.broadcast(layouts.bones(after.sparkSession, pairs)).select("parent", F.col("child").alias("joint"))
    kids = after.join(dim, "joint").select("seq_id", "frame", "joint", "parent", "x", "y", "z")
    ankle = after.select("seq_id", "frame", F.col("joint").alias("parent"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    both = kids.join(ankle, ["seq_id", "frame", "parent"], "left").join(before.select("seq_id", "frame", "joint", valid().alias("was")), ["seq_id", "frame", "joint"], "left")
    sure = valid("x", "y", "z", "ax", "ay", "az") & F.col("was")
    med = both.where(sure).groupBy("seq_id", "joint").agg(F.count(F.lit(1)).alias("n"), *[median(F.col(c) - F.col(f"a{c}")).alias(f"o{c}") for c in "xyz"]).where(F.col("n") >= limit_valid)
    fix = both.where(~F.col("was") & valid("x", "y", "z", "ax", "ay", "az")).join(med, ["seq_id", "joint"]).select("seq_id", "frame", "joint", *[(F.col(f"a{c}") + F.col(f"o{c}")).alias(f"n{c}") for c in "xyz"])
    return after.join(fix, ["seq_id", "frame", "joint"], "left").select("seq_id", "frame", "joint", *[F.coalesce(f"n{c}", c).alias(c) for c in "xyz"])


def solve(points: DataFrame, pairs: list[tuple[int, int]] = layouts.SOLVER_BONES, tolerance: float = 0.20, passes: int = 4) -> DataFrame:
    """Bone by bone, in list order, children further off the median length than ``tolerance`` are moved to it; ``passes`` times.

    The order matters, so frames are packed and solved in Arrow batches, all frames of a batch at once; medians ride along.
    """
    refs = _targets(points, pairs).select("seq_id", F.array(*[f"t{k}" for k in range(len(pairs))]).alias("refs"))
    size = max(j for p in pairs for j in p) + 1
    packed = points.groupBy("seq_id", "frame").agg(F.collect_list(F.struct("joint", "x", "y", "z")).alias("pts")).join(refs, "seq_id", "left")
    seq = packed.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            pts = b.column("pts")
            flat, count = pts.flatten(), pts.value_lengths().to_numpy(zero_copy_only=False)
            row, joint = np.repeat(np.arange(n), count), flat.field("joint").to_numpy()
            xyz = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1)
            a = np.full((n, max(size, int(joint.max(initial=0)) + 1), 3), np.nan)
            a[row, joint] = xyz
            ref = np.array([[np.nan if v is None else v for v in r] if r else [np.nan] * len(pairs) for r in b.column("refs").to_pylist()], float).reshape(n, len(pairs))
            for _ in range(passes):
                for k, (p, c) in enumerate(pairs):
                    vec = a[:, c] - a[:, p]
                    now = np.sqrt((vec * vec).sum(1))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        off = np.abs(now - ref[:, k]) / ref[:, k] > tolerance
                        new = a[:, p] + vec / now[:, None] * ref[:, k, None]
                    a[:, c] = np.where((off & (now > 1e-8))[:, None], new, a[:, c])
            out = a[row, joint]
            cols = [pa.array(np.where(np.isnan(out[:, d]), 0.0, out[:, d]), mask=np.isnan(out[:, d])) for d in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("seq_id").take(pa.array(row)), b.column("frame").take(pa.array(row)), pa.array(joint), *cols], ["seq_id", "frame", "joint", "x", "y", "z"])

    return packed.mapInArrow(run, f"seq_id {seq}, frame int, joint int, x double, y double, z double")


def proportions(points: DataFrame) -> DataFrame:
    """Per sequence: median named bone lengths summed by limb, widths, height, and their ratios."""
    own = lengths(points, layouts.NAMED_BONES).where("length is not null")
    part = lambda ks: sum(median(F.when(F.col("ord") == k, F.col("length"))) for k in ks)
    sizes = own.groupBy("seq_id").agg(part([0]).alias("hip_width"), part([1]).alias("shoulder_width"), part([2, 3]).alias("left_arm"), part([4, 5]).alias("right_arm"), part([6, 7]).alias("left_leg"), part([8, 9]).alias("right_leg"))
    ankle = points.where(F.col("joint").isin(27, 28)).groupBy("seq_id", "frame").agg(F.avg("y").alias("y")).groupBy("seq_id").agg(median("y").alias("ankle_y"))
    nose = points.where("joint = 0").groupBy("seq_id").agg(median("y").alias("nose_y"))
    tall = sizes.join(ankle, "seq_id", "left").join(nose, "seq_id", "left").withColumn("height", F.abs(F.col("ankle_y") - F.col("nose_y")))
    return tall.select("seq_id", "hip_width", "shoulder_width", "left_arm", "right_arm", "left_leg", "right_leg", "height", (F.col("shoulder_width") / F.col("hip_width")).alias("shoulder_hip_ratio"), ((F.col("left_arm") + F.col("right_arm")) / (F.col("left_leg") + F.col("right_leg"))).alias("arm_leg_ratio"))


def retarget_uniform(points: DataFrame, target_height: float) -> DataFrame:
    """Each sequence scaled about its left hip, frame by frame, so that its height is ``target_height``."""
    scale = proportions(points).select("seq_id", F.when(F.col("height") > 1e-6, target_height / F.col("height")).otherwise(1.0).alias("scale"))
    hip = points.where("joint = 23").select("seq_id", "frame", *[F.col(c).alias(f"h{c}") for c in "xyz"])
    out = points.join(hip, ["seq_id", "frame"], "left").join(scale, "seq_id", "left")
    return out.select("seq_id", "frame", "joint", *[F.coalesce(F.col(f"h{c}") + (F.col(c) - F.col(f"h{c}")) * F.col("scale"), F.col(c)).alias(c) for c in "xyz"])


def retarget_bones(points: DataFrame, targets: dict[int, float], low: float = 0.3, high: float = 3.0) -> DataFrame:
    """Named bones set to target lengths along the edge order (scale within [low, high]); ``targets`` is by place in the order."""
    pairs = layouts.NAMED_BONES
    joints = sorted({j for p in pairs for j in p})
    wide = _wide(points, joints).join(_targets(points, pairs), "seq_id", "left")
    for k, (p, c) in enumerate(pairs):
        if k in targets:
            scale = F.least(F.greatest(F.lit(float(targets[k])) / F.col(f"t{k}"), F.lit(low)), F.lit(high))
            new = F.struct(*[(F.col(f"j{p}")[d] + (F.col(f"j{c}")[d] - F.col(f"j{p}")[d]) * scale).alias(d) for d in "xyz"])
            ok = F.col(f"j{p}").isNotNull() & F.col(f"j{c}").isNotNull() & F.col(f"t{k}").isNotNull()
            wide = wide.withColumn(f"j{c}", F.when(ok, new).otherwise(F.col(f"j{c}")))
    return _narrow(points, wide, joints)


def blend(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """Points between two skeletons; where one is missing, the other."""
    both = a.join(b.select("seq_id", "frame", "joint", *[F.col(c).alias(f"b{c}") for c in "xyz"]), ["seq_id", "frame", "joint"], "full")
    return both.select("seq_id", "frame", "joint", *[F.coalesce((1 - alpha) * F.col(c) + alpha * F.col(f"b{c}"), F.col(c), F.col(f"b{c}")).alias(c) for c in "xyz"])


def virtual_markers(points: DataFrame, markers: dict[str, dict[int, float]] = layouts.VIRTUAL) -> DataFrame:
    """(seq_id, frame, name, x, y, z): weighted centroids; null unless all their joints are there."""
    rows = [(name, j, w) for name, js in markers.items() for j, w in js.items()]
    dim = F.broadcast(points.sparkSession.createDataFrame(rows, "name string, joint int, w double"))
    size = F.broadcast(points.sparkSession.createDataFrame([(n, len(js)) for n, js in markers.items()], "name string, k int"))
    sums = points.join(dim, "joint").groupBy("seq_id", "frame", "name").agg(F.count("x").alias("n"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in "xyz"]).join(size, "name")
    return sums.select("seq_id", "frame", "name", *[F.when(F.col("n") == F.col("k"), F.col(c)).alias(c) for c in "xyz"])


def foot_centres(points: DataFrame) -> DataFrame:
    """(seq_id, frame, side, x, y, z): the mean of the foot's markers that are there."""
    side = F.when(F.col("joint").isin(*layouts.FEET["left"]), "left").when(F.col("joint").isin(*layouts.FEET["right"]), "right")
    return points.withColumn("side", side).where("side is not null").groupBy("seq_id", "frame", "side").agg(*[F.avg(c).alias(c) for c in "xyz"])
