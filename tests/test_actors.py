import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import numeric
from strideframe.operators import actors, cameras, contact
from strideframe.plans import queries, recording
from strideframe.sources import adapters

SF = "/root/testdata/sf0.001"
KEYPOINTS = "seq_id long, frame int, cam int, det_pos int, joint int, u double, v double, conf double"
MEMBERS = "seq_id long, frame int, cam int, det_pos int, actor_id int"
TRACKS = "seq_id long, frame int, actor_id int, global_id int"
P = {c: np.reshape(p, (3, 4)) for c, p in adapters.CAMERAS}


def seen(x, cam):
    h = P[cam] @ [*x, 1.0]
    return h[:2] / h[2]


def solved(views):
    """One point by the loop: rows of each view, the last right singular vector."""
    rows = []
    for cam, u, v, w in views:
        rows += [w * (u * P[cam][2] - P[cam][0]), w * (v * P[cam][2] - P[cam][1])]
    x = np.linalg.svd(np.vstack(rows))[2][-1]
    return x[:3] / x[3]


def off(x, view):
    return float(np.hypot(*(seen(x, view[0]) - view[1:3])))


@pytest.fixture(scope="module")
def people(spark):
    """Two people of five joints before three cameras over 8 frames, noise of 2 pixels, gaps, one camera wrong at times."""
    rnd = np.random.RandomState(8)
    keypoints, members, tracks = [], [], []
    for f in range(8):
        for person in range(2):
            local = (person + f) % 2  # actors change places, identities do not
            if not (person == 1 and f == 5):  # without an identity in frame 5
                tracks.append((0, f, local, 10 + person))
            for cam in range(3):
                if (f + cam + person) % 6 == 0:
                    continue  # not detected
                members.append((0, f, cam, person, local))
                for j in range(5):
                    u, v = seen(np.array([400 * person, 100 * j, 30 * f + 10 * j]), cam) + rnd.randn(2) * 2
                    if cam == 2 and j == 3:
                        u += 90
                    gone = (f + j + cam) % 9 == 0
                    keypoints.append((0, f, cam, person, j, None if gone else float(u), None if gone else float(v), float(rnd.randint(3, 10) / 10)))
    members.append((0, 2, 9, 0, 0))  # a camera that is not calibrated
    return (spark.createDataFrame(keypoints, KEYPOINTS), spark.createDataFrame(members, MEMBERS), spark.createDataFrame(tracks, TRACKS)), (keypoints, members, tracks)


@pytest.mark.parametrize("reject", [None, 15.0])
def test_actor_points_equal_loops(spark, people, reject):
    (k, m, t), (keypoints, members, tracks) = people
    named = {(f, a): g for _, f, a, g in tracks}
    views = {}
    for _, f, cam, pos, actor in members:
        for _, kf, kc, kp, j, u, v, w in keypoints:
            if (kf, kc, kp) == (f, cam, pos) and u is not None and (f, actor) in named:
                views.setdefault((named[f, actor], f, j), []).append((cam, u, v, w))
    want = {}
    for key, vs in views.items():
        vs = sorted(vs)
        if len(vs) < 2:
            continue
        x = solved(vs)
        while reject and len(vs) > 2 and max(off(x, v) for v in vs) > reject:
            without = [[v for v in vs if v is not w] for w in vs]
            vs = min(without, key=lambda rest: np.mean([off(solved(rest), v) for v in rest]))
            x = solved(vs)
        want[key] = (*x, off(x, vs[0]), np.mean([off(x, v) for v in vs]), len(vs))
    got = {(r.global_id, r.frame, r.joint): (r.x, r.y, r.z, r.err, r.mean_err, r.n_cams) for r in actors.triangulate_actors(k, actors.actor_views(m, t), spark.createDataFrame(adapters.CAMERAS, "cam int, p array<double>"), reject=reject).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-6, abs=1e-6)
    if reject:
        assert sum(v[-1] == 2 for v in got.values()) > sum(len(vs) == 2 for vs in views.values())


def test_actor_summary_counts_frames_without_points(spark, people):
    (k, m, t), _ = people
    views = actors.actor_views(m, t)
    points = actors.triangulate_actors(k, views, adapters.cameras(spark))
    got = {r.global_id: r for r in actors.actor_summary(points, views).collect()}
    rows = points.toPandas()
    assert got[10].frames == 8 and got[11].frames == 7 and got[10].visible_share == 1.0 and got[11].visible_share == 7 / 8
    for g in (10, 11):
        own = rows[rows.global_id == g]
        assert got[g].mean_err == pytest.approx(own.err.mean()) and got[g].mean_joints == pytest.approx(own.x.notna().sum() / got[g].frames)


def test_later_detection_of_a_camera_wins_and_lost_actors_leave(spark):
    m = spark.createDataFrame([(0, 0, 0, 1, 0), (0, 0, 0, 2, 0), (0, 0, 1, 0, 1)], MEMBERS)
    t = spark.createDataFrame([(0, 0, 0, 7), (0, 0, 1, None)], TRACKS)
    assert [tuple(r) for r in actors.actor_views(m, t).collect()] == [(0, 0, 7, 0, 2)]
    assert [tuple(r) for r in actors.tracked_only(m, t).select("cam", "det_pos").orderBy("det_pos").collect()] == [(0, 1), (0, 2)]


def test_boxes_come_from_the_reference_camera_else_the_first(spark):
    k = spark.createDataFrame([(0, 0, c, 0, j, 100.0 * c + 10 * j, 5.0 * j, 0.9) for c in (1, 2) for j in range(3)] + [(0, 0, 2, 0, 9, 0.0, 0.0, 0.1)], KEYPOINTS)
    m = spark.createDataFrame([(0, 0, 1, 0, 0), (0, 0, 2, 0, 0)], MEMBERS)
    one = actors.actor_boxes(k, m, reference=0).collect()[0]
    other = actors.actor_boxes(k, m, reference=2).collect()[0]
    assert (one.x1, one.y1, one.x2, one.y2) == (100, 0, 120, 10) and one.feature == [0, 0, 0.5, 0.5, 1, 1]
    assert (other.x1, other.x2) == (200, 220)
    assert actors.actor_boxes(k, m, least=4).collect()[0].feature is None


def test_fundamental_of_projections_is_that_of_calibrations():
    k, r = np.array([[500.0, 0, 320], [0, 500, 240], [0, 0, 1]]), np.eye(3)
    a, b = np.column_stack([r, [0.0, 0, 0]]), np.column_stack([r, [-1.0, 0, 0]])
    f, g = numeric.fundamental(k, a, k, b), numeric.fundamental_of(k @ a, k @ b)
    assert np.allclose(f, g) or np.allclose(f, -g)


def test_scene_people_keep_one_identity(spark):
    """The scene's actors are its people: every identity is one person over its clip."""
    scene = adapters.scene(spark, SF).select("seq_id", "frame", "cam", "det_pos", "person").distinct()
    members = queries.QUERIES["associated"](spark, SF).join(scene, ["seq_id", "frame", "cam", "det_pos"])
    assert members.groupBy("seq_id", "frame", "actor_id").agg(F.countDistinct("person").alias("k")).where("k > 1").count() == 0
    points = queries.QUERIES["actor_points"](spark, SF).toPandas()  # people with too few common points stay in two parts
    assert len(points) > 10_000 and (points.mean_err < 0.01).all() and (points.n_cams == 3).mean() > 0.99


def test_association_of_empty_tables(spark):
    k = spark.createDataFrame([], KEYPOINTS)
    costs = cameras.pair_costs(k, cameras.fundamentals(adapters.CAMERAS), keys=("seq_id", "frame"))
    members = cameras.associate(k, costs, keys=("seq_id", "frame"))
    assert members.count() == 0
    views = actors.actor_views(members, spark.createDataFrame([], TRACKS))
    assert actors.triangulate_actors(k, views, adapters.cameras(spark)).count() == 0
    assert actors.actor_summary(actors.triangulate_actors(k, views, adapters.cameras(spark)), views).count() == 0


def test_robust_points_keep_at_least_two_views():
    turn = lambda a: np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    k = np.array([[500.0, 0, 320], [0, 500, 240], [0, 0, 1]])
    p = np.stack([k @ np.column_stack([turn(a), [0, 0, 3000]]) for a in (0.0, 0.8, 1.6, 2.4)])[None]
    x = np.array([[100.0, 50.0, 80.0]])
    h = p[0] @ [*x[0], 1]
    uv = (h[:, :2] / h[:, 2:])[None].copy()
    uv[0, 1] += 60
    there = np.ones((1, 4), bool)
    got, err, used = numeric.triangulate_robust(p, uv, np.ones((1, 4)), there, 5.0, 2)
    assert there.all() and used.tolist() == [[True, False, True, True]] and np.allclose(got, x) and np.isnan(err[0, 1])
    assert numeric.triangulate_robust(p, uv, np.ones((1, 4)), there, 5.0, 4)[2].all()


def floor_points(frames, seq, slope=0.0, level=0.0):
    """A person whose feet stand on the ground from frame to frame."""
    rows = []
    for f in range(frames):
        for j, (x, y, z) in {23: (0, 900, 0), 24: (100, 900, 0), 27: (0, 90, 10), 28: (100, 80, 40), 29: (0, 0, 0), 30: (100, 0, 30), 31: (0, 0, 150), 32: (100, 0, 200)}.items():
            shift = 300 * (f // 10)
            x, z = x + shift, z + (shift // 2) % 700
            rows.append((seq, f, j, float(x), float(y + level + slope * x), float(z)))
    return rows


def test_shared_floor_is_the_first_actors_that_is_seen_enough(spark):
    rows = floor_points(15, 1, 0.5) + floor_points(60, 2, 0.1) + floor_points(60, 3, 0.4) + floor_points(9, 4)
    points = spark.createDataFrame(rows, "seq_id long, frame int, joint int, x double, y double, z double")
    scenes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "seq_id long, scene string")
    got = {r.seq_id: r for r in recording.shared_floor(points, scenes).collect()}
    assert [got[k].floor_of for k in (1, 2, 3, 4)] == [2, 2, 3, None]
    assert (got[4].nx, got[4].ny, got[4].nz) == (0, 1, 0)
    plane = {r.seq_id: (r.nx, r.ny, r.nz) for r in contact.ground_planes(points).collect()}
    assert [(got[k].nx, got[k].ny, got[k].nz) for k in (1, 2, 3)] == [plane[2], plane[2], plane[3]] and plane[1] != plane[2]
    one = {r.seq_id: r.floor_of for r in recording.shared_floor(points).collect()}
    assert set(one.values()) == {2}


def test_actors_are_processed_on_one_floor_and_reported(spark):
    rows = floor_points(40, 1, 0.2) + floor_points(40, 2, 0.2)
    rows = [(*r[:3], None, None, None) if r[1] in (11, 12) and r[2] == 24 else r for r in rows]
    points = spark.createDataFrame(rows, "seq_id long, frame int, joint int, x double, y double, z double")
    out = recording.process_actors(points, recording.Options(wrists=False)).cache()
    alone = contact.align_to_ground(recording.process(points, recording.Options(wrists=False)), contact.ground_planes(points).where("seq_id = 1").select("nx", "ny", "nz").crossJoin(points.select("seq_id").distinct()))
    want = {(r.seq_id, r.frame, r.joint): r.y for r in alone.collect()}
    assert {(r.seq_id, r.frame, r.joint): r.y for r in out.collect()} == pytest.approx(want)
    report = {r.seq_id: r for r in recording.actors_report(points, out).collect()}
    assert report[1].missing_before == 2 and report[1].filled == 2 and report[None].missing_before == 4 and report[None].missing_after == 0
