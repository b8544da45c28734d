"""The engine's queries over the driver's tables, one for each operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import layouts
from ..functions import tables
from ..functions.geometry import distortion_weight
from ..operators import actors, audio, bones, cameras, contact, filters, gaps, hands, interact, pairs, placement, quality, reports, track, windows
from ..sources import adapters
from . import recording as recording_plan
from .work import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (no negative zero), for comparison across engines."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(source: str, digits: int = 6):
    """Registers a function of one adapter's view as a query."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(getattr(adapters, source)(spark, sf_dir)), digits)
        return f

    return add


@query("skeleton")
def bone_length_stats(p):
    return bones.length_stats(p, layouts.NAMED_BONES)


@query("channel")
def gap_fill_linear(c):
    return gaps.fill_linear(c.select("seq_id", "frame", "v"), ["seq_id"])


@query("channel")
def step_outliers(c):
    return gaps.step_outliers(c, ["seq_id"], threshold=2.0)


@query("channel")
def fill_and_erase(c):
    return gaps.fill_and_erase(c.select("seq_id", "frame", "v"), ["seq_id"], threshold=2.0)


@query("channel")
def fill_edges(c):
    return gaps.fill_edges(c.select("seq_id", "frame", "v"), ["seq_id"])


@query("channel")
def channel_gaps(c):
    return gaps.channel_gaps(c, ["seq_id"])


@query("skeleton")
def body_gaps(p):
    return gaps.body_gaps(p)


@query("skeleton")
def worst_joints(p):
    return gaps.worst_joints(p)


@query("skeleton")
def time_drift(p):
    return gaps.time_drift(p, limit=2.0)


@query("skeleton")
def side_swaps(p):
    return gaps.swaps(p, 15, 16)


@query("skeleton")
def frame_confidence(p):
    return gaps.frame_confidence(p)


@query("skeleton")
def outlier_flags(p):
    return quality.outlier_flags(p, velocity=400.0, jitter=600.0)


@query("skeleton")
def frame_drops(p):
    return quality.frame_drops(p)


@query("cam_ts", 4)
def timestamp_drops(t):
    return quality.timestamp_drops(t)


@query("cam_ts")
def shared_drops(t):
    return quality.shared_drops(t)


@query("skeleton")
def desync(p):
    return quality.desync(p)


@query("skeleton")
def side_asymmetry(p):
    return quality.side_asymmetry(p)


@query("skeleton")
def quality_by_position(p):
    return quality.quality_by_position(p)


@query("skeleton")
def motion_intensity(p):
    return quality.motion_intensity(p, sigmas=1.5)


@query("channel")
def blur_scores(c):
    return quality.blurred(c, sigmas=1.0)


@query("skeleton")
def texture_risk(p):
    return quality.texture_risk(p)


@query("channel")
def calibration_drift(c):
    return quality.calibration_drift(c, window=10, sigmas=1.0)


@query("skeleton")
def drift_alerts(p):
    frames = p.groupBy("seq_id", "frame").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("confidence"), (F.count("x") / 17.0).alias("completeness"))
    return quality.drift_alerts(frames, first=10, limits=(0.03, 0.04))


@query("obs2d", 4)
def self_occlusion(o):
    return quality.self_occlusion(o)


@query("obs2d")
def edge_reliability(o):
    return quality.edge_reliability(o)


@query("obs2d")
def joint_coverage(o):
    return quality.joint_coverage(o)


@query("detections")
def detection_stats(d):
    return quality.detection_stats(d)


@query("skeleton")
def hand_jitter(p):
    return quality.hand_jitter(p, [15, 16, 30, 31, 32])


@query("skeleton")
def frame_issues(p):
    frames = p.groupBy("seq_id", "frame").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("c"))
    return frames.groupBy("seq_id").agg(F.avg("c").alias("mean_confidence"), F.avg((F.col("c") > 0.95).cast("double")).alias("good_share_95"), F.count_if(F.col("c") < 0.95).alias("gap_frames"))


def energy_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    audio = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("cam"), (F.row_number().over(w) - 1).alias("idx"), (F.col("value").cast("double") * F.col("value").cast("double")).alias("e"))
    return _rounded(quality.energy_peaks(audio))


QUERIES["energy_peaks"] = energy_peaks


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type as a camera's sound: event values in order are samples, eight of them a window."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return audio.levels(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("cam"), (F.row_number().over(w) - 1).alias("idx"), F.col("value").cast("double").alias("v")), window=8)


def sync_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audio.sync_peaks(_levels(spark, sf_dir), above=2.0, distance=5))


def sync_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(audio.sync_offsets(_levels(spark, sf_dir), window=8, rate=100.0, above=2.0, distance=5, max_offset_s=60.0))


def _rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A room for each sequence, by how far its points reach."""
    side = lambda c: F.round(3 + (F.max(c) - F.min(c)) / 200, 1)
    return adapters.skeleton(spark, sf_dir).groupBy(F.col("seq_id").alias("room")).agg(side("x").alias("width"), side("z").alias("depth"))


#: Restarts of the query, drawn by a linear congruence that SQL can state as well.
RESTARTS = "select ord, cam, ((ord * 977 + cam * 131 + 7) * 1103515245 % 2147483648) / 2147483648.0D * 0.6D - 0.3D as jitter, 0.35D + ((ord * 613 + cam * 257 + 11) * 1103515245 % 2147483648) / 2147483648.0D * 0.13D as reach from (select id div 4 as ord, id % 4 as cam from range(120))"


def camera_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cameras for every room: the best of the presets and 30 restarts."""
    draws = spark.sql(RESTARTS).select(F.col("ord").cast("int"), F.col("cam").cast("int"), F.col("jitter").cast("double"), F.col("reach").cast("double"))
    return _rounded(placement.poses(placement.best_placement(_rooms(spark, sf_dir), 4, draws)))


@query("skeleton")
def missing_runs(p):
    """Runs of missing frames of each joint, by the table function."""
    tables.register(p.sparkSession)
    gone = p.where("x is null").select(F.concat_ws("/", "seq_id", "joint").alias("k"), "frame")
    return p.sparkSession.sql("select k, start, stop, size from islands(table(select k, frame from {gone}) partition by k order by (frame), 1)", gone=gone)


@query("skeleton")
def processing_time(p):
    return placement.processing_time(p.groupBy("seq_id").agg(F.countDistinct("frame").alias("frames")).withColumn("cameras", F.lit(3)))


#: Lenses of the adapter's cameras: (cam, k, dist).
LENSES = [
    (0, [800.0, 0.0, 320.0, 0.0, 800.0, 240.0, 0.0, 0.0, 1.0], [-0.28, 0.07, 0.0003, -0.0002, 0.01]),
    (1, [700.0, 0.0, 320.0, 0.0, 700.0, 240.0, 0.0, 0.0, 1.0], [0.12, -0.05, 0.001, 0.0005]),
    (2, [750.0, 0.0, 320.0, 0.0, 750.0, 240.0, 0.0, 0.0, 1.0], [0.2, 0.01, 0.0, 0.0, 0.002, 0.1, 0.02, 0.001]),
]


@query("obs2d", 4)
def undistorted(o):
    lenses = o.sparkSession.createDataFrame(LENSES, "cam int, k array<double>, dist array<double>")
    return cameras.undistort(o.select("seq_id", "cam", "frame", "joint", "u", "v"), lenses)


QUERIES |= {f.__name__: f for f in (sync_peaks, sync_offsets, camera_placement)}


@query("skeleton")
def foot_contacts(p):
    return contact.foot_contacts(p, least=2)


@query("skeleton")
def wrist_mismatch(p):
    return contact.wrist_mismatch(p, 15, 31, flag=200.0)


@query("skeleton")
def proportions(p):
    return bones.proportions(p)


@query("skeleton")
def virtual_markers(p):
    return bones.virtual_markers(p)


@query("skeleton")
def contact_pairs(p):
    return interact.contact_pairs(p, near=40.0)


@query("skeleton")
def interpenetration(p):
    return interact.interpenetration(p, near=60.0)


@query("detections")
def detection_iou(d):
    return interact.detection_ious(d)


@query("detections")
def nearest_marker(d):
    markers = d.where("det_pos > 0").select("frame", "cam", F.col("det_pos").alias("marker_id"), F.col("cx").alias("mx"), F.col("cy").alias("my"))
    return interact.nearest_marker(markers, d.select("frame", "cam", F.col("det_pos").alias("person"), (F.col("cx") + 30).alias("tx"), (F.col("cy") + 20).alias("ty")))


@query("detections")
def marker_votes(d):
    return interact.marker_votes(d.select(F.col("det_pos").alias("marker"), (F.col("cx").cast("int") % 4).alias("actor"), "cam"))


@query("skeleton")
def shutter_severity(p):
    return contact.shutter_severity(p)


@query("obs2d")
def triangulation_weights(o):
    return o.where("u is not null").select("seq_id", "cam", "frame", "joint", distortion_weight("u", "v", 640.0, 480.0).alias("weight"))


@query("obs2d", 4)
def bounding_boxes(o):
    return interact.bounding_boxes(o)


@query("skeleton")
def segment_means(p):
    named = p.join(F.broadcast(layouts.joints(p.sparkSession)).select("joint", "segment"), "joint")
    return named.groupBy("seq_id", "segment").agg(F.count("x").alias("n_valid"), *[F.avg(c).alias(f"mean_{c}") for c in "xyz"])


@query("detections")
def frame_spine(d):
    return interact.detection_counts(d)


HAND = [15, 29, 30, 31, 32]


@query("skeleton")
def hand_quality(p):
    return hands.hand_quality(p, 13, HAND)


@query("skeleton")
def face_quality(p):
    return hands.face_quality(p, [7, 8, 9, 10, 11, 12], flat_points=3, jitter_points=2, jitter_pairs=1)


@query("skeleton")
def hand_blend(p):
    there = F.pmod(F.col("joint") + F.col("frame"), F.lit(7)) > 0
    other = p.select("seq_id", "frame", "joint", *[F.when(there, F.coalesce(c, F.lit(0.0)) + 5).alias(c) for c in "xyz"])
    conf = p.select("seq_id", "frame").distinct().withColumn("conf", F.pmod(F.col("frame") * 3, F.lit(10)) / 10.0)
    return hands.blend_hands(p, other, conf, HAND)


def fused_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops in the motion of each skeleton and in the stamps of the camera that films it (a camera films two); the stamps'
    confidence is the share of intervals that are not drops."""
    names = F.array_sort(F.array(*[F.lit(n) for n in ("click", "error", "purchase", "signup", "view")]))
    stamps = quality.timestamp_drops(adapters.cam_ts(spark, sf_dir)).select("cam", "drops", (1 - F.col("drops") / F.col("intervals")).alias("confidence"))
    motion = quality.frame_drops(adapters.skeleton(spark, sf_dir))
    films = motion.select("seq_id", F.get(names, F.floor(F.col("seq_id") / 2).cast("int")).alias("cam"))
    return _rounded(quality.fused_drops(motion, films.join(stamps, "cam").drop("cam")))


@query("skeleton")
def coverage_heatmap(p):
    grid = p.where("x is not null").select(*[(F.floor(F.col(c) / 100) * 100).cast("double").alias(c) for c in "xyz"]).distinct()
    return cameras.coverage_heatmap(adapters.cameras(p.sparkSession), grid, 300.0, 230.0)


@query("skeleton")
def coverage_summary(p):
    grid = p.where("x is not null").select(*[(F.floor(F.col(c) / 100) * 100).cast("double").alias(c) for c in "xyz"]).distinct()
    return cameras.coverage_summary(cameras.coverage_heatmap(adapters.cameras(p.sparkSession), grid, 300.0, 230.0))


@query("cam_ts")
def same_time(t):
    """Frames of equal seconds of every two cameras."""
    whole = t.withColumn("t", F.floor("t"))
    return cameras.same_time(whole, whole, "cam")


def unmatched_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that the assignment of a camera pair leaves over, for every two cameras."""
    scene, funds, matches = _matches(spark, sf_dir)
    return pairs.unmatched(scene, matches, list(funds), SCENE)


@query("obs2d")
def pose_similarity(o):
    """The poses of a person in every two cameras."""
    return cameras.pose_similarity(o, o, cam="cam")


@query("skeleton")
def near_plane(p):
    return cameras.near_plane(p, (0.0, 2.0, 1.0), (0.0, 100.0, 0.0), 60.0)


# ---- operators without an SQL form: ordered recursions and linear algebra; tests hold them against plain versions ----


@query("skeleton")
def filter_one_euro(p):
    return filters.one_euro(p)


@query("skeleton")
def filter_butterworth(p):
    return filters.butterworth(p)


@query("skeleton")
def filter_rts(p):
    return filters.rts(p)


@query("skeleton")
def fill_spline(p):
    return filters.fill_cubic(p)


@query("skeleton")
def rigid_bones(p):
    return bones.rigid(p)


@query("skeleton")
def bone_outliers(p):
    return bones.erase_outliers(p)


@query("skeleton")
def bone_solver(p):
    return bones.solve(p, pairs=[(p_, c) for p_, c in layouts.RIGID_BONES])


@query("skeleton")
def ground_align(p):
    return contact.align_to_ground(p, contact.ground_planes(p))


@query("skeleton")
def pin_feet(p):
    return contact.pin_feet(p)


@query("skeleton")
def wrist_fix(p):
    return contact.fix_wrists(p, 15, [31, 29, 32])


@query("skeleton")
def retarget(p):
    return bones.retarget_uniform(p, 1800.0)


@query("skeleton")
def retarget_bones(p):
    return bones.retarget_bones(p, dict.fromkeys(range(2, 10), 300.0))


@query("skeleton")
def recording(p):
    return recording_plan.process(p, recording_plan.Options(wrists=False))


def triangulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cameras.triangulate(adapters.obs2d(spark, sf_dir), adapters.cameras(spark), conf=0.2), 4)


def reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, cams = adapters.obs2d(spark, sf_dir), adapters.cameras(spark)
    return _rounded(cameras.reprojection_errors(cameras.triangulate(obs, cams), obs, cams), 4)


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every camera's detections, each camera's in sequences of its own: seq_id is 3 times the recording plus the camera."""
    d = adapters.detections(spark, sf_dir)
    boxes = d.select((F.col("frame") % 50 * 3 + F.col("cam")).cast("long").alias("seq_id"), F.floor(F.col("frame") / 50).cast("int").alias("frame"), F.col("det_pos").alias("actor_id"), (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"), (F.col("conf")).alias("conf"), F.lit(None).cast("array<double>").alias("feature"))
    return track.track(boxes, "box")


def pair_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two detections of every two cameras in each frame of the scene."""
    return _rounded(cameras.pair_costs(adapters.scene(spark, sf_dir), cameras.fundamentals(adapters.CAMERAS), points=SCENE_POINTS, keys=("seq_id", "frame")), 4)


#: Joints of the adapter's skeletons that stand for nose, shoulders and hips.
SCENE_POINTS = (0, 11, 12, 23, 24)


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scene's keypoints, and which detections are one actor."""
    scene, keys = adapters.scene(spark, sf_dir).drop("person"), ("seq_id", "frame")
    costs = cameras.pair_costs(scene, cameras.fundamentals(adapters.CAMERAS), points=SCENE_POINTS, keys=keys)
    return scene, cut(cameras.associate(scene, costs, keys=keys))


def associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir)[1]


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scene, members = _members(spark, sf_dir)
    return scene, members, cut(track.track(actors.actor_boxes(scene, members), "feature"))


def tracked_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracks(spark, sf_dir)[2]


def actor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every identity; a view more than 40 pixels off is left out where two others remain."""
    scene, members, tracks = _tracks(spark, sf_dir)
    return _rounded(actors.triangulate_actors(scene, actors.actor_views(members, tracks), adapters.cameras(spark), reject=40.0), 4)


def actor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene, members, tracks = _tracks(spark, sf_dir)
    views = cut(actors.actor_views(members, tracks))
    return _rounded(actors.actor_summary(actors.triangulate_actors(scene, views, adapters.cameras(spark)), views), 4)


SCENE = ("seq_id", "frame")


def _matches(spark: SparkSession, sf_dir: str):
    """The scene, its cameras' fundamental matrices and the matched poses of every camera pair."""
    scene, funds = adapters.scene(spark, sf_dir).drop("person"), cameras.fundamentals(adapters.CAMERAS)
    return scene, funds, cut(pairs.match_poses(scene, funds, SCENE))


def pose_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_matches(spark, sf_dir)[2], 4)


def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene, funds, matches = _matches(spark, sf_dir)
    return _rounded(pairs.pair_statistics(scene, matches, list(funds), SCENE))


def crossing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches where two of the people are within 150 mm of each other, by their nose, and where they are not."""
    noses = adapters.skeleton(spark, sf_dir).where("joint = 0 and x is not null")
    people = noses.select(F.floor(F.col("frame") / adapters.CLIP).cast("long").alias("seq_id"), (F.col("frame") % adapters.CLIP).alias("frame"), F.col("seq_id").alias("person"), "x", "y", "z")
    return _rounded(pairs.crossing_statistics(_matches(spark, sf_dir)[2], people, SCENE, near=150.0))


@query("skeleton")
def worst_frames(p):
    return quality.worst_frames(_rounded(quality.outlier_flags(p, velocity=400.0, jitter=600.0)))


@query("skeleton")
def flag_counts(p):
    return reports.flag_counts(quality.outlier_flags(p, velocity=400.0, jitter=600.0))


@query("detections", 3)
def drift_report(d):
    """Each camera's detections over the frames."""
    return reports.drift_report(reports.detection_metrics(d.withColumn("seq_id", F.col("cam"))))


@query("skeleton", 3)
def skeleton_drift(p):
    return reports.drift_report(reports.skeleton_metrics(p), first=10, last=15, limits=(0.03, 0.04, 0.3))


@query("channel")
def calibration_health(c):
    return reports.calibration_health(c, window=10, sigmas=1.0)


@query("skeleton")
def trajectory_health(p):
    return reports.calibration_health(reports.trajectory_roughness(p), window=10, sigmas=1.5)


@query("channel")
def deblur_impact(c):
    """Each channel's values against the time since the sample before."""
    return reports.deblur_impact(c.withColumn("q", F.col("t") - F.lag("t").over(windows.by(["seq_id"]))))


def cross_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skeletons against a tracker that is off by some mm and lacks a seventh of the points."""
    p = adapters.skeleton(spark, sf_dir)
    there = F.pmod(F.col("joint") + F.col("frame"), F.lit(7)) > 0
    other = p.select("seq_id", "frame", "joint", *[F.when(there, F.col(c) + 3 + F.col("joint") % 4).alias(c) for c in "xyz"])
    return _rounded(reports.cross_tracker(p, other, adapters.cameras(spark), 360.0, 270.0))


QUERIES |= {f.__name__: f for f in (fused_drops, unmatched_detections, pose_matches, pair_statistics, crossing_statistics, cross_tracker)}


def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.track_summary(_tracks(spark, sf_dir)[2])


@query("skeleton")
def shared_floor(p):
    """The skeletons in scenes of three actors."""
    return recording_plan.shared_floor(p, p.select("seq_id", F.floor(F.col("seq_id") / 3).alias("scene")).distinct())


QUERIES |= {f.__name__: f for f in (triangulated, reprojection, tracked, pair_costs, associated, tracked_actors, actor_points, actor_summary, track_summary)}
