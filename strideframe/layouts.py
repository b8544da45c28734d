"""Joint layouts and bone sets, as data for the operators' dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of the body joints, in index order.
BODY = (
    "nose left_eye_inner left_eye left_eye_outer right_eye_inner right_eye right_eye_outer left_ear right_ear mouth_left mouth_right "
    "left_shoulder right_shoulder left_elbow right_elbow left_wrist right_wrist left_pinky right_pinky left_index right_index left_thumb right_thumb "
    "left_hip right_hip left_knee right_knee left_ankle right_ankle left_heel right_heel left_foot_index right_foot_index"
).split()
J = {name: k for k, name in enumerate(BODY)}


def body(points: DataFrame) -> DataFrame:
    """The points of the body joints alone, without hands and face."""
    return points.where(points["joint"] < len(BODY))


# Segments of the 553-point and the 133-point layout as (first, end).
SEGMENTS_553 = {"body": (0, 33), "right_hand": (33, 54), "left_hand": (54, 75), "face": (75, 553)}
SEGMENTS_133 = {"body": (0, 17), "feet": (17, 23), "face": (23, 91), "left_hand": (91, 112), "right_hand": (112, 133)}

# Bones as (parent, child) joint indices.
RIGID_BONES = [(11, 13), (13, 15), (12, 14), (14, 16), (23, 25), (25, 27), (24, 26), (26, 28)]
NAMED_BONES = [(23, 24), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16), (23, 25), (25, 27), (24, 26), (26, 28), (27, 29), (27, 31), (28, 30), (28, 32)]
OUTLIER_BONES = [
    (0, 1), (1, 2), (2, 3), (3, 7), (0, 4), (4, 5), (5, 6), (6, 8), (9, 10), (11, 12), (12, 13), (13, 14), (14, 15), (15, 16), (15, 18), (15, 19),
    (11, 22), (22, 23), (23, 24), (24, 25), (25, 26), (25, 27), (25, 28), (11, 17), (17, 18), (18, 19), (17, 20), (20, 21),
]
SOLVER_BONES = [
    (0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7),
    (5, 8), (8, 9), (9, 10), (10, 11), (11, 12), (12, 13), (13, 14),
    (5, 15), (15, 16), (16, 17), (17, 18), (18, 19), (19, 20),
    (0, 22), (22, 23), (23, 24), (24, 25), (25, 26), (26, 27), (25, 28),
    (0, 29), (29, 30), (30, 31), (31, 32), (32, 33), (33, 34), (32, 35),
]

# Weighted virtual markers.
VIRTUAL = {
    "head_center": {7: 0.5, 8: 0.5},
    "neck_center": {11: 0.5, 12: 0.5},
    "hips_center": {23: 0.5, 24: 0.5},
    "trunk_center": {11: 0.25, 12: 0.25, 23: 0.25, 24: 0.25},
}
# Foot markers, sides of the body and body regions as joint indices.
FEET = {"left": (27, 29, 31), "right": (28, 30, 32)}
SIDES = {"left": (11, 13, 15, 23, 25, 27), "right": (12, 14, 16, 24, 26, 28)}

# The COCO body joint for each of these body joints.
COCO_TO_BODY = {0: 0, 1: 2, 2: 5, 3: 7, 4: 8, 5: 11, 6: 12, 7: 13, 8: 14, 9: 15, 10: 16, 11: 23, 12: 24, 13: 25, 14: 26, 15: 27, 16: 28}

# Body regions and left-right siblings.
REGIONS = {"head": range(11), "torso": (11, 12, 23, 24), "left_arm": (13, 15, 17, 19, 21), "right_arm": (14, 16, 18, 20, 22), "left_leg": (25, 27, 29, 31), "right_leg": (26, 28, 30, 32)}


def bones(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    """(ord, parent, child) of a bone list; its length is that of a layout, so it may be broadcast."""
    return spark.createDataFrame([(k, p, c) for k, (p, c) in enumerate(pairs)], "ord int, parent int, child int")


def joints(spark: SparkSession) -> DataFrame:
    """(joint, segment, region, name) of the 553-point layout."""
    region = {j: r for r, js in REGIONS.items() for j in js}
    segment = {j: s for s, (a, e) in SEGMENTS_553.items() for j in range(a, e)}
    return spark.createDataFrame([(j, segment[j], region.get(j, "unknown"), BODY[j] if j < len(BODY) else f"{segment[j]}_{j}") for j in range(553)], "joint int, segment string, region string, name string")
