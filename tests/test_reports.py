import math

import numpy as np
import pytest

from strideframe.functions import numeric
from strideframe.operators import pairs, reports
from strideframe.sources import adapters

ERRORS = "seq_id long, frame int, v double"


def test_drift_report_equals_loops(spark):
    rnd = np.random.RandomState(5)
    rows = [(s, f, int(rnd.randint(0, 4)), round(float(np.clip(0.8 - 0.004 * f * s + rnd.randn() * 0.1, 0, 1)), 4), round(float(rnd.rand()), 4)) for s in range(3) for f in range(70 if s else 12)]
    got = {r.seq_id: r for r in reports.drift_report(spark.createDataFrame(rows, "seq_id long, frame int, n_detections long, confidence double, completeness double"), first=20, last=15).collect()}
    for s in range(3):
        own = [r for r in rows if r[0] == s]
        now = [round(float(np.mean([r[k] for r in own[-15:]])), 4) for k in (3, 4)]
        assert got[s].frames == len(own) and (got[s].now_confidence, got[s].now_completeness) == pytest.approx(now)
        if len(own) < 20:
            assert (got[s].base_confidence, got[s].score, got[s].high_alerts, got[s].level) == (None, 0, 0, "stable")
            continue
        base = {k: float(np.mean([r[k] for r in own[:20]])) for k in (2, 3, 4)}
        alerts = {"high": 0, "moderate": 0}
        for r in own[19:]:
            for k, limit in ((3, 0.15), (4, 0.20), (2, 0.30)):
                drop = (base[k] - r[k]) / (max(0.01, base[k]) if k > 2 else base[k])
                if drop > limit:
                    alerts["high" if drop > 2 * limit else "moderate"] += 1
        assert (got[s].high_alerts, got[s].moderate_alerts) == (alerts["high"], alerts["moderate"])
        assert got[s].score == pytest.approx(abs(base[3] - now[0]) * 50 + abs(base[4] - now[1]) * 50, abs=1e-3)


def test_calibration_health_equals_loops(spark):
    rnd = np.random.RandomState(2)
    errors = {0: 1 + rnd.rand(60) * 0.1, 1: 1 + rnd.rand(60) * 0.1, 2: np.linspace(1, 3, 60), 3: 1 + rnd.rand(20), 4: np.ones(50)}
    errors[1][40:45] += 0.2
    errors[1][50] += 9
    got = {r.seq_id: r for r in reports.calibration_health(spark.createDataFrame([(s, f, float(x)) for s, v in errors.items() for f, x in enumerate(v)], ERRORS)).collect()}
    signals = reports.drift_signals(spark.createDataFrame([(s, f, float(x)) for s, v in errors.items() for f, x in enumerate(v)], ERRORS)).collect()
    for s, v in errors.items():
        first = v[:30]
        mean, sd = first.mean(), max(first.std(), 1e-8)
        runs, start = [], None
        for t, x in enumerate([*v, -math.inf]):
            if x > mean + 3 * sd:
                start, worst = (t, (x - mean) / sd) if start is None else (start, max(worst, (x - mean) / sd))
            elif start is not None:
                runs.append((start, worst))
                start = None
        assert sorted((r.start, pytest.approx(r.severity)) for r in signals if r.seq_id == s) == runs
        a, b = v[: len(v) // 2].mean(), v[len(v) // 2 :].mean()
        trend = "stable" if len(v) <= 30 else "increasing" if b > a * 1.2 else "decreasing" if b < a * 0.8 else "stable"
        status = "ok" if not runs else "unreliable" if max(w for _, w in runs) > 6 else "drift_detected"
        assert (got[s].trend, got[s].status, got[s].signals) == (trend, status, len(runs))
        assert got[s].mean_error == pytest.approx(v.mean())


def test_roughness_is_the_mean_change_of_speed(spark):
    rnd = np.random.RandomState(3)
    a = np.cumsum(rnd.randn(12, 4, 3), axis=0)
    rows = [(0, f, j, *map(float, a[f, j])) for f in range(12) for j in range(4)]
    got = [r.v for r in reports.trajectory_roughness(spark.createDataFrame(rows, "seq_id long, frame int, joint int, x double, y double, z double")).orderBy("frame").collect()]
    speed = np.linalg.norm(np.diff(a, axis=0), axis=2)
    assert got == pytest.approx([0, *np.abs(np.diff(speed, axis=0)).mean(1), 0])


def test_deblur_impact_advice(spark):
    rnd = np.random.RandomState(4)
    v = rnd.rand(80)
    cases = {0: (v, v + rnd.rand(80) * 0.1), 1: (v[:50], 0.45 * v[:50] + rnd.rand(50) * 0.32), 2: (v, rnd.rand(80)), 3: (v[:9], np.ones(9)), 4: (v[:2], v[:2])}
    rows = [(s, f, float(x), float(y)) for s, (a, b) in cases.items() for f, (x, y) in enumerate(zip(a, b))] + [(0, 999, None, 1.0)]
    got = {r.seq_id: r for r in reports.deblur_impact(spark.createDataFrame(rows, "seq_id long, frame int, v double, q double")).collect()}
    for s, (a, b) in cases.items():
        low = b < np.percentile(b, 25)
        assert got[s].threshold == pytest.approx(np.percentile(a[low], 75) if low.any() else np.percentile(a, 25))
        if s < 3:
            r = np.corrcoef(a, b)[0, 1]
            assert got[s].correlation == pytest.approx(r) and got[s].p_value == pytest.approx(numeric.pearson_p(r, len(a)))
    assert got[0].advice == "deblur likely helps" and got[2].advice == got[3].advice == got[4].advice == "not recommended"


def test_cross_tracker_finds_the_bad_camera(spark):
    cams = [(c, [500.0, 0.0, 320.0, 0.0, 0.0, 500.0, 240.0, 0.0, 0.0, 0.0, 1.0, float(d)]) for c, d in ((0, 0), (1, 400), (2, 900))]
    rnd = np.random.RandomState(6)
    a = rnd.rand(20, 5, 3) * [300, 200, 500] + [0, 0, 1500]
    b = a + rnd.randn(20, 5, 3) * 5
    b[3, 2] = np.nan
    rows = lambda x: spark.createDataFrame([(0, f, j, *[None if np.isnan(q) else float(q) for q in x[f, j]]) for f in range(20) for j in range(5)], "seq_id long, frame int, joint int, x double, y double, z double")
    out = {r.cam: r for r in reports.cross_tracker(rows(a), rows(b), spark.createDataFrame(cams, "cam int, p array<double>"))
           .collect()}
    errors, apart = {}, {}
    for c, p in cams:
        px = lambda x: (np.reshape(p, (3, 4)) @ np.concatenate([x, np.ones((*x.shape[:2], 1))], 2)[..., None])[..., 0]
        uv = [px(x)[..., :2] / px(x)[..., 2:] for x in (a, b)]
        errors[c] = [np.nanmean(np.where(((q >= 0) & (q < [640, 480])).all(2), np.linalg.norm(q - [320, 240], axis=2) / 640 * 0.01, np.nan)) for q in uv]
        apart[c] = np.nanmean(np.linalg.norm(uv[0] - uv[1], axis=2))
    limit = np.percentile([e for es in errors.values() for e in es], 75)
    for c in range(3):
        assert (out[c].a_error, out[c].b_error, out[c].distance) == pytest.approx((*errors[c], apart[c]))
        assert out[c].suspect == all(e > limit for e in errors[c])
        assert out[c].agreement == pytest.approx(1 - max(apart.values()) / 800)
    advice = reports.cross_tracker_advice(spark.createDataFrame(list(out.values()))).first()
    assert advice.finding == ("calibration" if any(r.suspect for r in out.values()) else "none")


KEYPOINTS = "frame int, cam int, det_pos int, joint int, u double, v double, conf double"


def test_matches_equal_plain_assignment(spark):
    """Two cameras side by side, noise and confidences; every frame's best assignment by trying all."""
    import itertools

    pa, pb = (np.array([[500.0, 0, 320, x], [0, 500, 240, 0], [0, 0, 1, 0]]) for x in (0.0, -100_000.0))
    f = {(0, 1): numeric.fundamental_of(pa, pb)}
    rnd = np.random.RandomState(9)
    rows = []
    for frame in range(12):
        n = rnd.randint(1, 4)
        for k in range(n):
            body = rnd.rand(6, 3) * [600, 500, 300] + [-300, -250, 2000]
            for cam, p in ((0, pa), (1, pb)):
                if rnd.rand() < 0.15:
                    continue
                for j, x in enumerate(body):
                    h = p @ [*x, 1]
                    u, v = h[:2] / h[2] + rnd.randn(2) * 1.5
                    rows.append((frame, cam, (k + cam) % n, j, float(u), float(v), float(rnd.randint(2, 11) / 10)))
    dets = spark.createDataFrame(rows, KEYPOINTS)
    got = {(r.frame, r.i, r.j): (r.cost, r.confidence, r.ambiguous) for r in pairs.match_poses(dets, f).collect()}
    want, lone = {}, set()
    for frame in range(12):
        of = {cam: {p: [r for r in rows if r[:3] == (frame, cam, p)] for p in {r[2] for r in rows if r[:2] == (frame, cam)}} for cam in (0, 1)}
        if not of[0] or not of[1]:
            continue
        cost, about = {}, {}
        for i, j in itertools.product(of[0], of[1]):
            both = [(a, b) for a in of[0][i] for b in of[1][j] if a[3] == b[3] and a[6] > 0.3 and b[6] > 0.3]
            epi = []
            for a, b in both:
                x, y = np.array([*a[4:6], 1]), np.array([*b[4:6], 1])
                fx, fty = f[0, 1] @ x, f[0, 1].T @ y
                epi.append(abs(y @ fx) / math.sqrt(fx[0] ** 2 + fx[1] ** 2 + fty[0] ** 2 + fty[1] ** 2))
            if epi and np.mean(epi) <= 5:
                alike = math.exp(-np.mean([math.dist(a[4:6], b[4:6]) for a, b in both]) / 50)
                cost[i, j] = np.mean(epi) * (2 - alike)
                sure = (np.mean([r[6] for r in of[0][i]]) + np.mean([r[6] for r in of[1][j]])) / 2
                about[i, j] = 0.3 * sure + 0.4 * max(0, 1 - np.mean(epi) / 5) + 0.3 * alike
        few, many = sorted((list(of[0]), list(of[1])), key=len)
        flip = few == list(of[1]) and len(of[1]) < len(of[0])
        options = [[(q, p) if flip else (p, q) for p, q in zip(few, perm)] for perm in itertools.permutations(many, len(few))]
        best = min(options, key=lambda o: sum(cost.get(k, 1000.0) for k in o))
        hit = [k for k in best if cost.get(k, 1000.0) < 5]
        want |= {(frame, *k): (cost[k], about[k], about[k] < 0.6) for k in hit}
        lone |= {(frame, 0, i) for i in of[0] if i not in {k[0] for k in hit}} | {(frame, 1, j) for j in of[1] if j not in {k[1] for k in hit}}
    assert got.keys() == want.keys() and len(want) > 8
    assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)
    matches = pairs.match_poses(dets, f)
    assert {(r.frame, r.cam, r.det_pos) for r in pairs.unmatched(dets, matches, [(0, 1)]).collect()} == lone
    stats = pairs.pair_statistics(dets, matches, [(0, 1)]).first()
    assert (stats.matches, stats.unmatched, stats.ambiguous) == (len(want), len(lone), sum(v[2] for v in want.values()))


def test_matches_of_nothing(spark):
    dets = spark.createDataFrame([], KEYPOINTS)
    f = {(0, 1): numeric.fundamental_of(adapters.CAMERAS[0][1], adapters.CAMERAS[1][1])}
    matches = pairs.match_poses(dets, f)
    assert matches.count() == 0 and pairs.unmatched(dets, matches, [(0, 1)]).count() == 0 and pairs.pair_statistics(dets, matches, [(0, 1)]).count() == 0
