"""The post-processing of a recording, composed of the operators in their fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import valid
from ..operators import bones, contact, filters, gaps, windows
from .work import cut


@dataclass(frozen=True)
class Options:
    """Stages and parameters; the defaults are those of a 30 fps body recording in mm."""

    fps: float = 30.0
    max_gap: int = 10
    outlier: float = 5.0
    bone_outlier: float = 0.60
    rigid_first: float = 0.30
    rigid_second: float = 0.50
    min_cutoff: float = 1.0
    beta: float = 0.007
    z_ratio: float = 1.5
    cutoff: float = 6.0
    order: int = 2
    solver_tolerance: float = 0.20
    solver_passes: int = 4
    fill: bool = True
    bone_stage: bool = True
    solver: bool = True
    smooth: bool = True
    wrists: bool = True
    feet: bool = True
    floor: bool = False
    rts: bool = False


def _channels(points: DataFrame, f) -> DataFrame:
    """Applies ``f`` to the points' channels and packs them again; one shuffle serves all windows on (sequence, joint, dim)."""
    out = f(windows.unpivot(points)).select("seq_id", "frame", "joint", "dim", "v")
    return out.groupBy("seq_id", "frame", "joint").agg(*[F.max(F.when(F.col("dim") == d, F.col("v"))).alias(c) for d, c in enumerate("xyz")])


def process(points: DataFrame, o: Options = Options()) -> DataFrame:
    """Gap fill and spike erasure, bone outliers, linear fill, feet, rigid bones, solver, smoothing, bones again, wrists, floor, contact, RTS."""
    keys = ["seq_id", "joint", "dim"]
    p = points.select("seq_id", "frame", "joint", "x", "y", "z")
    if o.fill:
        p = cut(_channels(p, lambda c: gaps.fill_and_erase(c, keys, o.max_gap, o.outlier)))
    if o.bone_stage:
        p = cut(bones.erase_outliers(p, o.bone_outlier))
    if o.fill:
        before = p
        p = cut(bones.anchor_feet(before, _channels(p, lambda c: gaps.fill_linear(c, keys, o.max_gap))))
    if o.bone_stage:
        p = cut(bones.rigid(p, o.rigid_first))
    if o.solver:
        p = bones.solve(p, tolerance=o.solver_tolerance, passes=o.solver_passes)
    if o.smooth:
        p = filters.smooth(p, o.fps, o.min_cutoff, o.beta, o.z_ratio, o.cutoff, o.order)
    p = cut(p)
    if o.bone_stage:
        p = cut(bones.rigid(p, o.rigid_second))
    if o.solver:
        p = cut(bones.solve(p, tolerance=o.solver_tolerance, passes=o.solver_passes))
    if o.wrists:
        for wrist, hand in ((16, list(range(33, 54))), (15, list(range(54, 75)))):
            p = cut(contact.fix_wrists(p, wrist, hand))
    if o.floor:
        p = cut(contact.align_to_ground(p, contact.ground_planes(p)))
    if o.feet:
        p = contact.pin_feet(p)
    return filters.rts(p, o.fps) if o.rts else p


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(seq_id, metric, value): frames, missing points before and after, mean step before and after."""
    both = before.withColumn("when", F.lit("before")).unionByName(after.withColumn("when", F.lit("after")))
    stats = windows.moves(both.withColumn("seq", F.col("seq_id")).withColumn("seq_id", F.concat_ws("/", "when", F.col("seq").cast("string"))))
    rows = stats.groupBy("seq", "when").agg(F.countDistinct("frame").cast("double").alias("frames"), F.count_if(~valid()).cast("double").alias("missing_points"), F.avg("step").alias("mean_step"))
    return rows.select(F.col("seq").alias("seq_id"), "when", F.expr("stack(3, 'frames', frames, 'missing_points', missing_points, 'mean_step', mean_step) as (metric, value)")).select("seq_id", F.concat_ws("_", "metric", "when").alias("metric"), "value")


def shared_floor(points: DataFrame, scenes: DataFrame | None = None, least_frames: int = 20, least_contacts: int = 5) -> DataFrame:
    """(seq_id, nx, ny, nz, floor_of): the floor of each actor's scene, which is that of the scene's first actor that is seen
    in ``least_frames`` and touches the ground ``least_contacts`` times; (0, 1, 0) and null where none does.

    ``scenes`` is (seq_id, scene); without it all sequences are of one scene.
    """
    seqs = points.groupBy("seq_id").agg(F.count_distinct(F.when(valid(), F.col("frame"))).alias("seen"))
    seqs = seqs.withColumn("scene", F.lit(0)) if scenes is None else seqs.join(scenes.select("seq_id", "scene"), "seq_id", "left")
    planes = contact.ground_planes(points).where(F.col("n") >= least_contacts).select("seq_id", "nx", "ny", "nz")
    first = seqs.where(F.col("seen") >= least_frames).join(planes, "seq_id").groupBy("scene").agg(F.min_by(F.struct("nx", "ny", "nz", "seq_id"), "seq_id").alias("g"))
    floor = seqs.join(first, seqs["scene"].eqNullSafe(first["scene"]), "left").select("seq_id", *[F.coalesce(f"g.{c}", F.lit(float(c == "ny"))).alias(c) for c in ("nx", "ny", "nz")], F.col("g.seq_id").alias("floor_of"))
    return floor


def process_actors(points: DataFrame, o: Options = Options(), scenes: DataFrame | None = None) -> DataFrame:
    """Actors (sequences) processed alike and aligned to their scene's one floor, which is estimated before the processing."""
    floor = cut(shared_floor(points, scenes))
    return contact.align_to_ground(cut(process(points, o)), floor.drop("floor_of"))


def actors_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(seq_id, missing_before, missing_after, filled) of each actor, and a row of null id for all."""
    missing = lambda df, name: df.groupBy("seq_id").agg(F.count_if(~valid()).alias(name))
    both = missing(before, "missing_before").join(missing(after, "missing_after"), "seq_id", "full")
    counts = both.groupBy("seq_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("missing_before", "missing_after")])
    whole = counts.agg(F.lit(None).cast(counts.schema["seq_id"].dataType).alias("seq_id"), F.sum("missing_before").alias("missing_before"), F.sum("missing_after").alias("missing_after"))
    return counts.unionByName(whole).withColumn("filled", F.col("missing_before") - F.col("missing_after"))
