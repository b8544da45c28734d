import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideframe.functions import numeric, tables
from strideframe.operators import audio, cameras, placement

# ---- placement ----


def plain_score(cams, width, depth, step=0.2, h_fov=70.0, excluded=()):
    nx, ny = max(2, int(width / step)), max(2, int(depth / step))
    count, central = [], []
    for x in np.linspace(0, width, nx):
        for y in np.linspace(0, depth, ny):
            if any(a <= x <= c and b <= y <= d for a, b, c, d in excluded):
                continue
            n = 0
            for cx, cy, cz, yaw, pitch in cams:
                ax = np.array([math.cos(math.radians(pitch)) * math.cos(math.radians(yaw)), math.cos(math.radians(pitch)) * math.sin(math.radians(yaw)), math.sin(math.radians(pitch))])
                to = np.array([x - cx, y - cy, -cz])
                far = np.linalg.norm(to)
                n += 0.5 <= far <= 10 and math.degrees(math.acos(max(-1, min(1, ax @ to / far)))) <= h_fov / 2
            count.append(n)
            central.append(width / 4 <= x <= width * 3 / 4 and depth / 4 <= y <= depth * 3 / 4)
    count, central = np.array(count), np.array(central)
    share = lambda k, of: 100.0 * (count[of] >= k).sum() / max(1, of.sum())
    every = np.ones(len(count), bool)
    return 0.30 * share(1, every) / 100 + 0.35 * share(2, every) / 100 + 0.15 * share(3, every) / 100 + 0.20 * share(2, central) / 100, len(count)


@pytest.mark.parametrize("n, fixed, excluded", [(5, None, None), (4, None, [(0.0, 0.0, 1.5, 2.0)]), (3, [(0.4, 0.4, 2.0, 45.0, -20.0)], None), (2, [(1.0, 1.0, 2.0, 0.0, -30.0), (3.0, 1.0, 2.0, 90.0, -30.0)], None)])
def test_best_placement_equals_loops(spark, n, fixed, excluded):
    rooms = spark.createDataFrame([("a", 5.1, 4.3), ("b", 6.0, 6.0)], "room string, width double, depth double")
    free = n - len(fixed or [])
    draws = placement.restarts(spark, max(free, 1), tries=6, seed=3)
    options = placement.random_arrangements(rooms, draws, max(free, 1))
    options = options.unionByName(placement.presets(rooms, n)) if not fixed else options
    best = {r.room: r for r in placement.best_placement(rooms, n, tries=6, seed=3, fixed=fixed, excluded=excluded).collect()}
    for room, width, depth in rooms.collect():
        scored = []
        for r in options.where(f"room = '{room}'").orderBy("ord").collect():
            cams = [tuple(c) for c in r.cameras] if free else []
            scored.append((plain_score(cams + [(x, y, z, yaw, p) for x, y, z, yaw, p in fixed or []], width, depth, excluded=excluded or ()), r.arrangement))
        top = max(s for (s, _), _ in scored)
        assert best[room].score == pytest.approx(top, abs=1.01e-4)
        assert best[room].total_cells == scored[0][0][1] and len(best[room].cameras) == n
        assert best[room].arrangement in ({"fixed"} if not free else {a for (s, _), a in scored if s > top - 2e-4})


def test_placement_draws_and_single_camera(spark):
    rng = np.random.RandomState(42)
    first = placement.restarts(spark, 3, 2).collect()[0]
    assert (first.jitter, first.reach) == (rng.uniform(-0.3, 0.3), rng.uniform(0.35, 0.48))
    rooms = spark.createDataFrame([("a", 5.0, 4.0)], "room string, width double, depth double")
    assert placement.best_placement(rooms, 1, draws=placement.restarts(spark, 1, 1), tries=1).first().arrangement == "random_optimized"
    with pytest.raises(ValueError, match="positive"):
        placement.best_placement(rooms, 0)


# ---- sound ----


def plain_sync(samples, window, rate, fps, above, distance, max_offset):
    pulses = {}
    for cam, v in sorted(samples.items()):
        n = max(1, len(v) // window)
        e = np.array([np.mean(np.square(v[i * window : (i + 1) * window])) for i in range(n)])
        db = 10 * np.log10(np.maximum(e, 1e-10))
        mid = np.median(db)
        for limit in (mid + above, mid + above / 2):
            peaks = []
            for i in range(1, n - 1):
                if db[i] > limit and db[i] > db[i - 1] and db[i] >= db[i + 1] and (not peaks or i - peaks[-1] >= distance):
                    peaks.append(i)
            if peaks:
                break
        if peaks:
            best = max(peaks, key=lambda i: db[i])
            pulses[cam] = (best, round(min(1, max(0, (db[best] - mid) / 40)), 4))
    if not pulses:
        return {cam: (min(samples), 0, 0, 0.0, "no_pulses_found") for cam in samples}
    ref = max(pulses, key=lambda c: pulses[c][1])
    off = {cam: (pulses[cam][0] - pulses[ref][0]) * window if cam in pulses else 0 for cam in samples}
    ms = {cam: round(o / rate * 1000, 2) for cam, o in off.items()}
    most = max(map(abs, ms.values()))
    quality = "excellent" if most < 5 / fps else "good" if most < 20 / fps else "acceptable" if most < max_offset * 1000 else "poor"
    return {cam: (ref, off[cam], round(off[cam] / (rate / fps)), ms[cam], quality) for cam in samples}


@pytest.mark.parametrize("seed", range(5))
def test_offsets_equal_loops(spark, seed):
    rnd = np.random.RandomState(seed)
    samples = {cam: rnd.randn(rnd.randint(30, 900)) * 0.01 for cam in range(4)}
    for cam, v in samples.items():
        for at in rnd.randint(0, len(v), 6 if seed % 2 else 2):
            v[at : at + 9] += 0.8 if cam != 3 else 0.02
    if seed == 4:
        samples = {cam: np.ones(50) for cam in range(3)}
    rows = [(cam, k, float(x)) for cam, v in samples.items() for k, x in enumerate(v)]
    level = audio.levels(spark.createDataFrame(rows, "cam int, idx long, v double"), window=7)
    got = {r.cam: (r.reference, r.offset_samples, r.offset_frames, r.offset_ms, r.quality) for r in audio.sync_offsets(level, window=7, rate=700.0, above=12.0, distance=9, max_offset_s=0.3).collect()}
    assert got == plain_sync(samples, 7, 700.0, 30.0, 12.0, 9, 0.3)


def test_peaks_and_islands_in_sql(spark):
    rnd = random.Random(4)
    rows = [(k, at, float(at)) for k in ("a", "b", None) for at in sorted(rnd.sample(range(400), 120))]
    spark.createDataFrame(rows, "cam string, win long, db double").createOrReplaceTempView("levels")
    tables.register(spark)
    want, runs = [], []
    for k in ("a", "b", None):
        last, run = None, None
        for key, at, v in rows:
            if key == k:
                if last is None or at - last >= 10:
                    last = at
                    want.append((k, at, v))
                if run and at - run[2] <= 3:
                    run[2:] = [at, run[3] + 1]
                else:
                    run = [k, at, at, 1]
                    runs.append(run)
    rank = lambda r: (r[0] or "", *r[1:])
    got = spark.sql("select * from peaks(table(select cam, win, db from levels) partition by cam order by (win), 10)").collect()
    assert sorted(map(tuple, got), key=rank) == sorted(want, key=rank)
    got = spark.sql("select * from islands(table(select cam, win from levels) partition by cam order by (win), 3)").collect()
    assert sorted(map(tuple, got), key=rank) == sorted(map(tuple, runs), key=rank)
    assert spark.sql("select * from islands(table(select cam, win from levels where false) partition by cam order by (win), 3)").count() == 0


# ---- lenses ----


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-0.6, 0.6), st.floats(-0.6, 0.6)), min_size=1, max_size=30), st.tuples(st.floats(-0.25, 0.25), st.floats(-0.05, 0.05), st.floats(-0.005, 0.005), st.floats(-0.005, 0.005), st.floats(-0.01, 0.01)))
def test_undistort_inverts_the_lens(xy, d):
    xy, d = np.array(xy), np.tile([*d, 0, 0, 0], (len(xy), 1))
    assert numeric.undistort(numeric.distort(xy, d), d) * 1000 == pytest.approx(xy * 1000, abs=1e-6)


def test_undistort_gives_up_where_the_lens_has_no_inverse():
    d = np.array([[-0.9, 0, 0, 0, 0, 0, 0, 0]] * 3)
    out = numeric.undistort(np.array([[0.1, 0.0], [5.0, 5.0], [0.45, 0.0]]), d)
    assert np.isfinite(out[0]).all() and np.isnan(out[1]).all() and np.isnan(out[2]).all()  # no point is bent to 0.45


def test_lens_round_trip_of_pixels(spark):
    lens = spark.createDataFrame([(0, [800.0, 0.0, 320.0, 0.0, 790.0, 240.0, 0.0, 0.0, 1.0], [-0.2, 0.05, 0.001, 0.0002, 0.01]), (1, [800.0, 0.0, 320.0, 0.0, 790.0, 240.0, 0.0, 0.0, 1.0], [0.1, 0.0, 0.0, 0.0])], "cam int, k array<double>, dist array<double>")
    rows = [(k, k % 3, "x", float(k * 7 % 640), float(k * 11 % 480)) for k in range(300)] + [(300, 0, None, None, 1.0)]
    points = spark.createDataFrame(rows, "id long, cam int, name string, u double, v double")
    back = {r.id: r for r in cameras.undistort(cameras.distort(points, lens), lens).collect()}
    assert back.keys() == {r[0] for r in rows if r[1] < 2}  # camera 2 has no lens
    assert all((back[i].u, back[i].v) == pytest.approx((u, v), abs=1e-6) for i, c, _, u, v in rows if c < 2 and u is not None)
    assert back[300].u is None and back[300].name is None and back[0].name == "x"
    assert cameras.undistort(points.where("false"), lens).count() == 0
