import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strideframe.functions import numeric
from strideframe.operators import bones, cameras, contact, filters, gaps, quality, track
from strideframe.plans import oracles, queries, recording
from strideframe.sources import adapters, files

SF = "/root/testdata/sf0.001"
POINTS = "seq_id long, frame int, joint int, x double, y double, z double"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "embeddings", "lineitem"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)
    cell = lambda v: None if v is None or v != v else float(round(v, 4)) + 0.0 if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    return cols, sorted((tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(oracles.ORACLES[name]).df())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_marker_votes_count_every_frame(spark):
    """Against a plain count over all detections; the SQL of the query takes every fifth frame only."""
    votes = {}
    for r in adapters.detections(spark, SF).select("det_pos", "cx", "cam").collect():
        votes.setdefault(r.det_pos, []).append((int(r.cx) % 4, r.cam))
    want = set()
    for marker, named in votes.items():
        n, _, actor = min((-sum(a == actor for a, _ in named), min(c for a, c in named if a == actor), actor) for actor in {a for a, _ in named})
        if -n >= 2 or len(named) == 1:
            want.add((marker, actor, -n))
    assert {(r.marker, r.actor, r.votes) for r in queries.QUERIES["marker_votes"](spark, SF).collect()} == want


def test_tracked_takes_every_camera(spark):
    """Each detection of each camera has an identity, the one a tracker of that camera alone gives."""
    want = set()
    d = adapters.detections(spark, SF).toPandas()
    for (recording_id, cam), seq in d.groupby([d["frame"] % 50, "cam"]):
        tracker = track.BoxTracker()
        for frame, part in seq.sort_values(["frame", "det_pos"]).groupby("frame", sort=True):
            actors = [{"actor_id": r.det_pos, "box": [r.cx - r.w / 2, r.cy - r.h / 2, r.cx + r.w / 2, r.cy + r.h / 2], "conf": r.conf, "feature": None} for r in part.itertuples()]
            want |= {(recording_id * 3 + cam, frame // 50, a, g) for a, g in tracker.step(frame // 50, actors).items()}
    got = queries.QUERIES["tracked"](spark, SF).toPandas()
    assert len(got) == len(d) and {tuple(r) for r in got.itertuples(index=False)} == want


def skeleton(frames=60, joints=33, seed=42, gaps_too=True):
    rnd = np.random.RandomState(seed)
    a = np.cumsum(rnd.randn(frames, joints, 3) * 0.5, axis=0) + 500 + rnd.randn(1, joints, 3) * 100
    if gaps_too:
        for j in range(0, joints, 3):
            a[10 + j % 7 : 13 + j % 7, j] = np.nan
    return a


def points(spark, a, seq=0):
    f, k, _ = a.shape
    rows = [(seq, i, j, *(None if math.isnan(v) else float(v) for v in a[i, j])) for i in range(f) for j in range(k)]
    return spark.createDataFrame(rows, POINTS)


def array(df, shape):
    out = np.full(shape, np.nan)
    p = df.toPandas()
    out[p["frame"], p["joint"]] = p[["x", "y", "z"]].astype(float).to_numpy()
    return out


# ---- kernels ----


def test_assignment_is_optimal():
    rnd = np.random.RandomState(0)
    for n, m in itertools.product(range(1, 6), repeat=2):
        c = rnd.rand(n, m)
        got = sum(c[i, j] for i, j in numeric.assign(c))
        rows, cols = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = min(sum((c if n <= m else c.T)[i, p[i]] for i in rows) for p in itertools.permutations(cols, min(n, m)))
        assert got == pytest.approx(best)
    assert numeric.assign(np.array([[np.inf, 1.0], [np.inf, np.inf]])) == [(0, 1)]


def test_filters_on_known_signals():
    t = np.arange(200)
    flat = np.full((200, 1), 7.0)
    assert numeric.butter_smooth(flat, 30) == pytest.approx(flat)
    slow, fast = np.sin(2 * np.pi * 0.5 * t / 30)[:, None], np.sin(2 * np.pi * 14 * t / 30)[:, None]
    out = numeric.butter_smooth(slow + fast, 30)[20:-20]
    assert np.abs(out - slow[20:-20]).max() < 0.05  # no phase shift, the fast part is gone
    b, a = numeric.butterworth(2, 0.5)
    assert b == pytest.approx([0.29289322, 0.58578644, 0.29289322]) and a == pytest.approx([1, 0, 0.17157288], abs=1e-7)
    x = numeric.one_euro(flat.copy(), t / 30)
    assert x == pytest.approx(flat)
    noisy = flat.copy()
    noisy[50] = np.nan
    assert np.isnan(numeric.one_euro(noisy, t / 30)[50, 0]) and numeric.one_euro(noisy, t / 30)[51, 0] == pytest.approx(7)


def test_rts_equals_full_state_smoother():
    rnd = np.random.RandomState(3)
    v = np.cumsum(rnd.randn(40, 3), 0)
    v[5:9] = np.nan
    dt, eye = 1 / 30, np.eye(3)
    f = np.block([[eye, dt * eye], [0 * eye, eye]])
    q = np.block([[dt**4 / 4 * eye, 0 * eye], [0 * eye, dt**2 * eye]])
    h = np.hstack([eye, 0 * eye])
    x, p, hist = np.r_[v[0], 0, 0, 0], 1000 * np.eye(6), []
    for i in range(40):
        if i:
            x, p = f @ x, f @ p @ f.T + q
        xp, pp = x, p
        if not np.isnan(v[i]).any():
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + 100 * eye)
            x, p = x + k @ (v[i] - h @ x), (np.eye(6) - k @ h) @ p
        hist.append((x, p, xp, pp))
    out = [hist[-1][0]]
    for i in range(38, -1, -1):
        x, p, _, _ = hist[i]
        _, _, xp, pp = hist[i + 1]
        out.append(x + p @ f.T @ np.linalg.inv(pp) @ (out[-1] - xp))
    assert numeric.rts(v, 30) == pytest.approx(np.array(out[::-1])[:, :3])


def test_spline_passes_knots_and_is_exact_on_lines():
    x = np.array([0.0, 1, 3, 4, 7])
    assert numeric.natural_spline(x, 2 * x + 1, np.array([-1.0, 0.5, 2, 9])) == pytest.approx([-1, 2, 5, 19])
    y = np.array([0.0, 2, -1, 4, 0])
    assert numeric.natural_spline(x, y, x) == pytest.approx(y)
    v = np.array([0.0, 1, np.nan, 3, 4, np.nan, 6])
    assert numeric.fill_cubic(v) == pytest.approx(np.arange(7.0))


def test_correlation_p_value():
    assert numeric.pearson_p(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    assert numeric.pearson_p(0.0, 20) == pytest.approx(1.0)


def test_triangulation_inverts_projection(spark):
    rnd = np.random.RandomState(1)
    k = np.array([[500.0, 0, 320], [0, 500, 240], [0, 0, 1]])
    rts = [np.hstack([contact.rodrigues([0, 0.2 * c, 0]), np.array([[-c], [0.1 * c], [5.0]])]) for c in range(3)]
    ps, x = [k @ rt for rt in rts], rnd.randn(12, 3)
    rows = []
    for c, p in enumerate(ps):
        h = np.c_[x, np.ones(12)] @ p.T
        rows += [(0, c, 0, j, float(u), float(v), 1.0) for j, (u, v) in enumerate(h[:, :2] / h[:, 2:]) if not (c == 2 and j < 4)]
    obs = spark.createDataFrame(rows, "seq_id long, cam int, frame int, joint int, u double, v double, conf double")
    cams = spark.createDataFrame([(c, p.ravel().tolist()) for c, p in enumerate(ps)], "cam int, p array<double>")
    for weighted in (False, True):
        got = cameras.triangulate(obs, cams, weighted=weighted)
        assert array(got, (1, 12, 3))[0] == pytest.approx(x, abs=1e-6)
    assert cameras.reprojection_errors(got, obs, cams).agg(F.max("err")).first()[0] < 1e-6
    f = numeric.fundamental(k, rts[0], k, rts[1])
    assert np.linalg.norm(f) == pytest.approx(1) and not numeric.fundamental(k, rts[0], k, rts[0]).any()


def test_association_joins_one_person(spark):
    k = np.array([[500.0, 0, 320], [0, 500, 240], [0, 0, 1]])
    rts = [np.hstack([np.eye(3), np.array([[-float(c)], [0], [5.0]])]) for c in range(3)]
    people = {p: np.random.RandomState(p).randn(17, 3) * 0.3 + [p - 0.5, (p - 0.5) * 2, 0] for p in range(2)}
    rows = []
    for c, rt in enumerate(rts):
        for pos, p in enumerate(sorted(people, reverse=bool(c % 2))):
            h = np.c_[people[p], np.ones(17)] @ (k @ rt).T
            rows += [(0, c, pos, j, float(u), float(v), 0.9) for j, (u, v) in enumerate(h[:, :2] / h[:, 2:])]
    dets = spark.createDataFrame(rows, "frame int, cam int, det_pos int, joint int, u double, v double, conf double")
    pairs = {(a, b): numeric.fundamental(k, rts[a], k, rts[b]) for a, b in ((0, 1), (0, 2), (1, 2))}
    got = {(r.cam, r.det_pos): r.actor_id for r in cameras.associate(dets, cameras.pair_costs(dets, pairs)).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 1): 0, (1, 0): 1, (2, 0): 0, (2, 1): 1}


# ---- operators ----


def test_rigid_bones_have_their_median_length(spark):
    a = skeleton(gaps_too=False)
    out = array(bones.rigid(points(spark, a)), a.shape)
    for p, c in ((11, 13), (13, 15), (24, 26), (26, 28)):
        want = np.median(np.linalg.norm(a[:, c] - a[:, p], axis=1))
        assert np.linalg.norm(out[:, c] - out[:, p], axis=1) == pytest.approx(want)
    assert out[:, 29] - out[:, 27] == pytest.approx(a[:, 29] - a[:, 27])


def test_solver_equals_loops(spark):
    a = skeleton(12, 9)
    pairs = [(0, 1), (1, 2), (0, 3), (2, 4)]
    want = a.copy()
    refs = [np.nanmedian(np.linalg.norm(a[:, c] - a[:, p], axis=1)) * 1.5 for p, c in pairs]
    refs = [np.nanmedian(np.linalg.norm(a[:, c] - a[:, p], axis=1)) for p, c in pairs]
    for _ in range(4):
        for i in range(len(a)):
            for (p, c), ref in zip(pairs, refs, strict=True):
                v = want[i, c] - want[i, p]
                n = np.sqrt((v * v).sum())
                if n > 1e-8 and abs(n - ref) / ref > 0.001:
                    want[i, c] = want[i, p] + v / n * ref
    got = array(bones.solve(points(spark, a), pairs, tolerance=0.001), a.shape)
    assert got == pytest.approx(want, nan_ok=True)


def test_ground_alignment_lifts_feet(spark):
    a = skeleton(80, gaps_too=False)
    rot = contact.rodrigues([0.3, 0, 0.2])
    p = points(spark, a @ rot.T)
    out = array(contact.align_to_ground(p, contact.ground_planes(p)), a.shape)
    feet = np.stack([out[:, [27, 29, 31]].mean(1), out[:, [28, 30, 32]].mean(1)], 1)
    assert feet[..., 1].min() == pytest.approx(0, abs=1e-6)
    d = lambda x: np.linalg.norm(x[:, 0] - x[:, 20], axis=1)
    assert d(out) == pytest.approx(d(a))


def test_one_filter_per_joint_and_segment(spark):
    a = skeleton()
    got = array(filters.one_euro(points(spark, a)), a.shape)
    want = numeric.one_euro(a.reshape(60, -1), np.arange(60) / 30, np.tile([1, 1, 1.5], 33)).reshape(a.shape)
    assert got == pytest.approx(want, nan_ok=True)


def test_recording_reduces_gaps_and_keeps_input(spark):
    a = skeleton(40)
    p = points(spark, a)
    out = array(recording.process(p, recording.Options(wrists=False, solver=False)), a.shape)
    assert np.isnan(out).sum() < np.isnan(a).sum()
    assert array(p, a.shape) == pytest.approx(a, nan_ok=True)


def test_trackers_keep_identities(spark):
    rows = []
    for f in range(20):
        for k, x in enumerate((10 + 2 * f, 200 - 2 * f)):
            if not (k == 1 and 8 <= f < 11):
                rows.append((0, f, k if f % 2 else 1 - k, float(x), 0.0 + 60 * k, x + 40.0, 50.0 + 60 * k, 0.9, [0.1 * k, 0.2, 0.3, 0.4 + 0.2 * k]))
    dets = spark.createDataFrame(rows, "seq_id long, frame int, actor_id int, x1 double, y1 double, x2 double, y2 double, conf double, feature array<double>")
    for method in ("feature", "box"):
        got = track.track(dets, method).join(dets, ["seq_id", "frame", "actor_id"]).groupBy("global_id").agg(F.countDistinct("y1").alias("k")).collect()
        assert len(got) == 2 and all(r.k == 1 for r in got)


def test_anchors_hold_an_identity():
    t = track.FeatureTracker()
    actor = lambda i, x: {"actor_id": i, "box": [x, 0, x + 10, 10], "feature": np.array([[0.1 * x, 0.2], [0.3, 0.4]])}
    first = t.step(0, [actor(0, 0), actor(1, 50)], {7: 1})
    assert t.step(1, [actor(0, 50), actor(1, 0)], {7: 1})[1] == first[1]


def test_stream_equals_batch(spark, tmp_path):
    from strideframe.streaming.online import one_euro_stream

    a = skeleton(24, 4)
    p = points(spark, a)
    for k in range(3):
        p.where(f"frame >= {8 * k} and frame < {8 * k + 8}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in sorted((tmp_path / "in").glob("*.parquet")):
            os.utime(f) if k == 0 else None
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the time-outs keep an available-now query going

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        return spark.table(name)

    src = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = array(run(one_euro_stream(src), "euro").drop("late"), a.shape)
    assert got == pytest.approx(array(filters.one_euro(p), a.shape), nan_ok=True)


# ---- sources ----


def test_npy_round_trip(spark, tmp_path):
    a = skeleton(30, 5)
    np.save(tmp_path / "a.npy", a)
    df = files.read_npy(spark, str(tmp_path / "a.npy"), "s")
    assert array(df, a.shape) == pytest.approx(a, nan_ok=True)
    files.write_npy(df, str(tmp_path / "b.npy"), 5)
    assert np.load(tmp_path / "b.npy") == pytest.approx(a, nan_ok=True)


def test_calibration_and_csv(spark, tmp_path):
    text = '[cam_1]\nname="b"\nmatrix=[[2,0,0],[0,2,0],[0,0,1]]\nrotation=[0,0,0]\ntranslation=[1,2,3]\nsize=[480,640]\n[cam_0]\nmatrix=[[1,0,0],[0,1,0],[0,0,1]]\nrotation=[0,0,1.5707963267948966]\ntranslation=[0,0,0]\n[metadata]\nx=1'
    cams = files.read_calibration(spark, text).orderBy("cam").collect()
    assert [(c.name, c.width, c.height) for c in cams] == [("cam_0", 0, 0), ("b", 640, 480)]
    assert cams[1].p == pytest.approx([2, 0, 0, 2, 0, 2, 0, 4, 0, 0, 1, 3]) and cams[0].rt[:3] == pytest.approx([0, -1, 0])
    files.write_wide_csv(points(spark, np.array([[[1.0, 2, 3]], [[np.nan] * 3]])), str(tmp_path / "c"), 1)
    assert pd.read_csv(next((tmp_path / "c").glob("*.csv"))).fillna(-1).to_numpy().tolist() == [[0, 1, 2, 3], [1, -1, -1, -1]]


def test_layout_conversion(spark):
    a = np.arange(133 * 3, dtype=float).reshape(1, 133, 3)
    out = array(files.to_553(points(spark, a)), (1, 553, 3))[0]
    assert out[11] == pytest.approx(a[0, 5]) and out[33] == pytest.approx(a[0, 112]) and out[54] == pytest.approx(a[0, 91]) and np.isnan(out[1]).all()


def test_empty_inputs(spark):
    none = spark.createDataFrame([], POINTS)
    for op in (gaps.body_gaps, gaps.time_drift, gaps.frame_confidence, quality.outlier_flags, quality.frame_drops, quality.desync, bones.rigid, bones.proportions, contact.pin_feet, filters.smooth):
        assert op(none).count() == 0


# ---- the body alone counts, on the 553-point layout ----


def dense(spark, frames=40, joints=553):
    """All joints move by one unit a frame along x; hands and face are missing in every third frame."""
    rows = [(0, f, j, *((float(f + j), float(j), 0.0) if j < 33 or f % 3 else (None, None, None))) for f in range(frames) for j in range(joints)]
    return spark.createDataFrame(rows, "seq_id long, frame int, joint int, x double, y double, z double")


def test_missing_face_and_hands_are_no_gaps(spark):
    from strideframe.operators import gaps, quality

    points = dense(spark)
    assert gaps.body_gaps(points).count() == 0
    conf = {r.frame: (r.visibility, round(r.confidence, 9)) for r in gaps.frame_confidence(points).collect()}
    assert conf[0] == (1.0, 0.8) and conf[39] == (1.0, 0.8)
    assert conf[20] == (1.0, round(0.6 + 0.4 / (1 + 10 / 3), 9))  # a third of the coordinates moves by 1, none speeds up
    drops = quality.frame_drops(points).first()
    assert (drops.frames, drops.empty_frames, drops.bursts, drops.median_speed) == (40, 0, 0, 30.0)
    assert quality.quality_by_position(points).agg({"nan_rate": "max"}).first()[0] == 0.0


def test_pinned_feet_fade_within_the_run(spark):
    from strideframe.operators import contact

    # The left foot creeps by 0.01 a frame in frames 10 to 29 and runs else.
    x, rows = 0.0, []
    for f in range(60):
        x += 0.01 if 10 < f < 30 else 5.0
        rows += [(0, f, j, x + j, 0.0, 0.0) for j in (27, 29, 31)]
    points = spark.createDataFrame(rows, "seq_id long, frame int, joint int, x double, y double, z double")
    run = contact.foot_contacts(points).first()
    assert (run.start, run.end) == (11, 28)
    before = {r.frame: r.x for r in points.where("joint = 27").collect()}
    after = {r.frame: r.x for r in contact.pin_feet(points).where("joint = 27").collect()}
    mean = sum(before[f] for f in range(11, 29)) / 18
    for f in before:
        a = min(1, (min(f - 11, 28 - f) + 1) / 6) if 11 <= f <= 28 else 0
        assert after[f] == pytest.approx(before[f] + a * (mean - before[f]))


@pytest.mark.parametrize("strategy", ["confidence_weighted", "average", "body_wins", "hand_wins"])
def test_wrist_fix_moves_the_hand_only(spark, strategy):
    from strideframe.operators import contact

    rows = []
    for f in range(30):
        off = 100.0 if f == 20 else 1.0
        rows += [(0, f, 15, float(f), 0.0, 0.0), (0, f, 33, f + off, 0.0, 0.0), (0, f, 34, f + off + 2, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "seq_id long, frame int, joint int, x double, y double, z double")
    got = {(r.frame, r.joint): r.x for r in contact.fix_wrists(points, 15, [33, 34], strategy).collect()}
    ws, hs = 1.0, (4 * 1.0 + 100.0) / 5  # means of the last five steps
    share = {"confidence_weighted": hs / (hs + ws), "average": 0.5, "body_wins": 1.0, "hand_wins": 0.0}[strategy]
    fade = 1 / (1 + 2 / 1.0) if strategy == "confidence_weighted" else 1.0  # two off the base, mean radius one
    for f, j, x in ((r[1], r[2], r[3]) for r in rows):
        move = -100.0 * share * (1.0 if j == 33 else fade) if f == 20 and j != 15 else 0.0
        assert got[f, j] == pytest.approx(x + move)
