"""Steps whose cost or memory must not grow faster than their input: the quick forms against the plain ones."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.functions import numeric
from strideframe.operators import cameras, reports, track


def boxes(seqs, frames, seed=1):
    """Crowded boxes that drift, cross, fade and leave gaps, some without numbers; sequences miss frames of their own."""
    rnd = np.random.RandomState(seed)
    for f in range(frames):
        for s in range(seqs):
            if rnd.rand() < 0.2:
                continue
            n = rnd.randint(1, 6)
            x, y = rnd.rand(n) * 120 + 2 * f % 50, rnd.rand(n) * 60
            w, h = 30 + rnd.rand(n) * 40, 30 + rnd.rand(n) * 40
            box = np.stack([x, y, x + w, y + h], 1)
            box[rnd.rand(n) < 0.03, 2] = np.nan
            yield f, s, box, np.where(rnd.rand(n) < 0.03, np.nan, rnd.rand(n))


def test_box_tracks_of_many_sequences_equal_the_tracker_of_each():
    for options in ({}, {"max_age": 3, "iou_high": 0.1, "iou_low": 0.2}):
        alone, together = [track.BoxTracker(**options) for _ in range(5)], track.BoxTracks(**options)
        together.reserve(5)
        by_frame = {}
        for f, s, box, conf in boxes(5, 150):
            by_frame.setdefault(f, []).append((s, box, conf))
        for f, rows in by_frame.items():
            want = []
            for s, box, conf in rows:
                out = alone[s].step(f, [{"actor_id": k, "box": b.tolist(), "conf": c, "feature": None} for k, (b, c) in enumerate(zip(box, conf))])
                want += [out[k] for k in range(len(box))]
            got = together.step(f, np.repeat([s for s, _, _ in rows], [len(b) for _, b, _ in rows]), np.concatenate([b for _, b, _ in rows]), np.concatenate([c for _, _, c in rows]))
            assert got.tolist() == want
        assert all(t.next_id < 150 * 5 for t in alone) and together.next_id.tolist() == [t.next_id for t in alone]


def test_box_tracks_hold_tracks_and_one_frame_whatever_the_batches(spark):
    rows = [(f"s{s}", f, k, *map(float, b), float(c)) for f, s, box, conf in boxes(4, 60) for k, (b, c) in enumerate(zip(box, conf))]
    rows = [tuple(None if v != v else v for v in r) for r in rows]
    dets = spark.createDataFrame(rows, "seq_id string, frame int, actor_id int, x1 double, y1 double, x2 double, y2 double, conf double")
    want = {tuple(r) for r in track.track(dets, "box").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = track.track(dets, "box")
        assert {tuple(r) for r in got.collect()} == want and len(want) == len(rows)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # no sequence is a table of its own
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_drift_report_ranks_only_the_ends_of_a_sequence(spark):
    """No task ranks all frames of a sequence; sequences without a number are reported too."""
    rows = [(s, f, 1 + f % 3, 0.9 - 0.01 * (f % 40), 1.0) for s in (0, None) for f in range(80)]
    metrics = spark.createDataFrame(rows, "seq_id long, frame int, n_detections long, confidence double, completeness double")
    report = reports.drift_report(metrics, first=10, last=15)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and plan.count("+- Window ") + plan.count(":- Window ") == 2  # before and after each shuffle
    got = {r.seq_id: r for r in report.collect()}
    assert got.keys() == {0, None} and got[0].frames == got[None].frames == 80 and got[0].now_confidence == got[None].now_confidence
    assert got[None].base_confidence is None and got[0].high_alerts > 0


def test_association_takes_few_frames_at_a_time(spark):
    """Lists become Python objects for some frames only; frames of a large batch are associated as each alone."""
    parts = list(cameras.few_rows([pa.record_batch({"x": range(1000)}), pa.record_batch({"x": range(1000, 1003)})]))
    assert max(b.num_rows for b in parts) <= 64 and [x for b in parts for x in b.column("x").to_pylist()] == list(range(1003))
    rnd = np.random.RandomState(4)
    k = spark.createDataFrame([(f, c, d, 0, 0.0, 0.0, 1.0) for f in range(300) for c in range(2) for d in range(3) if f != 7 or c], "frame int, cam int, det_pos int, joint int, u double, v double, conf double").coalesce(1)
    costs = [(f, 0, 1, i, j, float(rnd.rand() * 80)) for f in range(300) if f not in (7, 70) for i in range(3) for j in range(3)]
    found = cameras.associate(k, spark.createDataFrame(costs, "frame int, cam_a int, cam_b int, i int, j int, cost double"))
    got = {}
    for r in found.collect():
        got.setdefault(r.frame, {})[(r.cam, r.det_pos)] = r.actor_id
    for f in range(300):
        nodes = [(c, d) for c in range(2) for d in range(3) if f != 7 or c]
        edges = [{"cam_a": a, "cam_b": b, "i": i, "j": j, "cost": c} for g, a, b, i, j, c in costs if g == f]
        assert got[f] == dict(zip(nodes, cameras._joined(nodes, edges, 50.0)))


def test_keypoint_distances_equal_an_assignment_for_each_pair():
    rnd = np.random.RandomState(0)
    sets = lambda: [rnd.rand(rnd.randint(1, 9) if k % 3 else rnd.randint(18, 22), 2) for k in range(12)]
    a, b = sets(), sets()
    a[3], b[4], a[5] = np.round(a[3] * 2), np.round(b[4] * 2), b[5].copy()  # ties, and the same set
    want = []
    for p in a:
        for q in b:
            d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1))
            want.append(np.mean([d[i, j] for i, j in numeric.assign(d)]))
    assert track.keypoint_distances(a, b).ravel() == pytest.approx(np.array(want), abs=1e-12)
    odd = track.keypoint_distances([None, a[0]], [np.array([[np.nan, 1.0]]), a[0], np.zeros((0, 2))])
    assert odd[1, 1] == 0 and np.isinf(odd).sum() == 5 and track.keypoint_distances([], b).shape == (0, 12)


def test_a_frames_keypoints_are_solved_together(spark, monkeypatch):
    """One assignment of tracks to actors for each frame, none for each pair of them; small tables still spread over tasks."""
    calls = []
    monkeypatch.setattr(track, "assign", lambda *a: calls.append(a) or numeric.assign(*a))
    tracker, rnd = track.FeatureTracker(), np.random.RandomState(1)
    for f in range(3):
        tracker.step(f, [{"actor_id": k, "box": [k, 0, k + 9, 9], "feature": rnd.rand(5, 2)} for k in range(4)])
    assert len(calls) == 3
    rows = [(s, 0, 0, 0.0, 0.0, 1.0, 1.0, 1.0, [0.0, 0.0]) for s in range(200)]
    dets = spark.createDataFrame(rows, "seq_id long, frame int, actor_id int, x1 double, y1 double, x2 double, y2 double, conf double, feature array<double>")
    assert track.track(dets).select(F.spark_partition_id().alias("p")).distinct().count() > 4
