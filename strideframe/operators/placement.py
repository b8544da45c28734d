"""Where to put cameras in a room: preset arrangements and seeded restarts, all scored in one join with the floor's cells.

Rooms are (room, width, depth) in metres; an arrangement is a row with an array of cameras (x, y, z, yaw, pitch).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How near and how far a camera sees, in metres, and what the parts of the score weigh.
NEAREST, FARTHEST = 0.5, 10.0
WEIGHTS = {"coverage": 0.30, "coverage_2plus": 0.35, "coverage_3plus": 0.15, "central": 0.20}


def floor_cells(rooms: DataFrame, step: float = 0.2) -> DataFrame:
    """(room, x, y, central): a grid over each room's floor with its walls on it; the central half counts on its own."""
    n = lambda c: F.greatest(F.lit(2), F.floor(F.col(c) / step).cast("int"))
    at = lambda c, k: F.col(c) * F.col(k) / (n(c) - 1)
    grid = rooms.withColumn("i", F.explode(F.sequence(F.lit(0), n("width") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), n("depth") - 1)))
    mid = lambda v, c: (v >= F.col(c) / 4) & (v <= F.col(c) * 3 / 4)
    x, y = at("width", "i"), at("depth", "j")
    return grid.select("room", x.alias("x"), y.alias("y"), (mid(x, "width") & mid(y, "depth")).alias("central"))


def _camera(x: Column, y: Column, z: float, yaw: Column, pitch: float) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), F.lit(float(z)).alias("z"), yaw.cast("double").alias("yaw"), F.lit(float(pitch)).alias("pitch"))


def _around(angle: Column, radius: Column, height: float, tilt: float, inset: float | None = None) -> Column:
    """A camera on a circle about the room's middle that looks at it; with ``inset`` kept that far from the walls."""
    x, y = F.col("width") / 2 + radius * F.cos(angle), F.col("depth") / 2 + radius * F.sin(angle)
    yaw = F.degrees(F.atan2(F.col("depth") / 2 - y, F.col("width") / 2 - x))
    within = lambda v, c: v if inset is None else F.greatest(F.lit(inset), F.least(F.col(c) - inset, v))
    return _camera(within(x, "width"), within(y, "depth"), height, yaw, -tilt)


def presets(rooms: DataFrame, n: int, height: float = 2.5, tilt: float = 15.0) -> DataFrame:
    """(room, ord, arrangement, cameras) of the arrangements that ``n`` cameras allow."""
    w, d = F.col("width"), F.col("depth")
    radius = F.least(w, d) * 0.42
    made: list[tuple[str, list[Column]]] = []
    turn = [2 * math.pi * i / n for i in range(n)]
    if n >= 2:
        made.append(("circle_equal", [_around(F.lit(a), radius, height, tilt) for a in turn]))
        made.append(("circle_alternating", [_around(F.lit(a + math.pi / n), radius * (0.85 + 0.15 * (i % 2)), height, tilt) for i, a in enumerate(turn)]))
    if n >= 4 and n % 2 == 0:
        share = [(i // 4 + 1) / (n // 4 + 1) for i in range(n)]
        walls = [lambda s: (F.lit(0.3), d * s, 0.0), lambda s: (w - 0.3, d * s, 180.0), lambda s: (w * s, F.lit(0.3), 90.0), lambda s: (w * s, d - 0.3, -90.0)]
        places = [walls[i % 4](s) for i, s in enumerate(share)]
        made.append(("wall_opposite", [_camera(x, y, height, F.lit(yaw), -tilt) for x, y, yaw in places]))
    if n >= 4:
        corners = [(F.lit(0.5), F.lit(0.5), 45.0), (w - 0.5, F.lit(0.5), 135.0), (w - 0.5, d - 0.5, -135.0), (F.lit(0.5), d - 0.5, -45.0)]
        inner = [_around(F.lit(2 * math.pi * i / max(1, n - 4)), radius * 0.6, height, tilt) for i in range(n - 4)]
        made.append(("corners_plus_center", [_camera(x, y, height, F.lit(yaw), -tilt) for x, y, yaw in corners] + inner))
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("arrangement"), F.array(*cams).alias("cameras")) for k, (name, cams) in enumerate(made)])
    return rooms.select("*", F.explode(each).alias("a")).select("room", "a.*")


def restarts(spark: SparkSession, n: int, tries: int = 100, seed: int = 42) -> DataFrame:
    """(ord, cam, jitter, reach): the random turns and reaches of ``tries`` arrangements of ``n`` cameras, drawn camera by camera."""
    rng = np.random.RandomState(seed)
    rows = [(k, i, float(rng.uniform(-0.3, 0.3)), float(rng.uniform(0.35, 0.48))) for k in range(tries) for i in range(n)]
    return spark.createDataFrame(rows, "ord int, cam int, jitter double, reach double")


def random_arrangements(rooms: DataFrame, draws: DataFrame, n: int, height: float = 2.5, tilt: float = 15.0) -> DataFrame:
    """(room, ord, arrangement, cameras): cameras around the room's middle, moved by ``draws`` (a parameter's size, broadcast)."""
    camera = _around(2 * math.pi * F.col("cam") / n + F.col("jitter"), F.least("width", "depth") * F.col("reach"), height, tilt, inset=0.3)
    drawn = rooms.join(F.broadcast(draws), how="cross").groupBy("room", "ord").agg(F.array_sort(F.collect_list(F.struct("cam", camera.alias("c")))).alias("cs"))
    return drawn.select("room", (F.col("ord") + 1000).alias("ord"), F.lit("random_optimized").alias("arrangement"), F.transform("cs", lambda c: c["c"]).alias("cameras"))


def score(arrangements: DataFrame, cells: DataFrame, h_fov: float = 70.0, excluded: list[tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Arrangements with score, coverage, coverage_2plus, coverage_3plus, central (per cent) and total_cells.

    A camera sees a cell on the floor within its range and half its horizontal angle about its axis. ``excluded`` zones
    (x1, y1, x2, y2) do not count.
    """
    for x1, y1, x2, y2 in excluded or []:
        cells = cells.where(~(F.col("x").between(x1, x2) & F.col("y").between(y1, y2)))

    def sees(c: Column) -> Column:
        dx, dy, dz = F.col("x") - c["x"], F.col("y") - c["y"], -c["z"]
        dist = F.sqrt(dx * dx + dy * dy + dz * dz)
        pitch, yaw = F.radians(c["pitch"]), F.radians(c["yaw"])
        dot = (F.cos(pitch) * F.cos(yaw) * dx + F.cos(pitch) * F.sin(yaw) * dy + F.sin(pitch) * dz) / dist
        return (dist >= NEAREST) & (dist <= FARTHEST) & (F.degrees(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))) <= h_fov / 2)

    seen = cells.join(arrangements, "room").select("room", "ord", "central", F.size(F.filter("cameras", sees)).alias("n"))
    share = lambda hit, of: 100.0 * F.count_if(hit) / F.greatest(F.count_if(of), F.lit(1))
    every = F.lit(True)
    parts = {"coverage": share(F.col("n") >= 1, every), "coverage_2plus": share(F.col("n") >= 2, every), "coverage_3plus": share(F.col("n") >= 3, every), "central": share(F.col("central") & (F.col("n") >= 2), F.col("central"))}
    totals = seen.groupBy("room", "ord").agg(F.count(F.lit(1)).alias("total_cells"), *[e.alias(k) for k, e in parts.items()])
    whole = sum(w * F.col(k) for k, w in WEIGHTS.items()) / 100.0
    return arrangements.join(totals.withColumn("score", F.bround(whole, 4)), ["room", "ord"]).withColumns({k: F.bround(k, 1) for k in parts})


def best_placement(rooms: DataFrame, n: int = 6, draws: DataFrame | None = None, tries: int = 100, seed: int = 42, height: float = 2.5, tilt: float = 15.0, h_fov: float = 70.0, step: float = 0.2, fixed: list[tuple[float, float, float, float, float]] | None = None, excluded: list[tuple[float, float, float, float]] | None = None) -> DataFrame:
    """The best arrangement of ``n`` cameras for each room (ties: presets first, then earlier restarts), with its score's parts.

    ``fixed`` cameras (x, y, z, yaw, pitch) stay where they are and are of the ``n``; presets are tried only without any.
    If they are all, they are scored alone.
    """
    free = n - len(fixed or [])
    held = F.array(*[_camera(F.lit(x), F.lit(y), z, F.lit(yaw), pitch) for x, y, z, yaw, pitch in fixed or []])
    if n <= 0:
        raise ValueError("n must be positive")
    if free <= 0:
        options = rooms.select("room", F.lit(0).alias("ord"), F.lit("fixed").alias("arrangement"), held.alias("cameras"))
    else:
        draws = restarts(rooms.sparkSession, free, tries, seed) if draws is None else draws
        options = random_arrangements(rooms, draws, free, height, tilt)
        if fixed:
            options = options.withColumn("cameras", F.concat("cameras", held))
        elif n >= 2:
            options = presets(rooms, n, height, tilt).unionByName(options)
        if not fixed and n < 2 and tries == 0:
            options = rooms.select("room", F.lit(0).alias("ord"), F.lit("fallback_single").alias("arrangement"), F.array(_camera(F.col("width") / 2, F.lit(0.0), height, F.lit(0.0), -tilt)).alias("cameras"))
    scored = score(options, floor_cells(rooms, step), h_fov, excluded)
    columns = [c for c in scored.columns if c != "room"]
    return scored.groupBy("room").agg(F.min_by(F.struct(*columns), F.struct(-F.col("score"), "ord")).alias("b")).select("room", "b.*")


def poses(best: DataFrame) -> DataFrame:
    """(room, arrangement, score, coverage parts, cam, x, y, z, yaw, pitch): a row for each camera of the chosen arrangements, rounded."""
    each = best.select("room", "arrangement", "score", *WEIGHTS, "total_cells", F.posexplode("cameras").alias("cam", "c"))
    return each.select("room", "arrangement", "score", *WEIGHTS, "total_cells", "cam", *[F.bround(f"c.{k}", 3).alias(k) for k in "xyz"], *[F.bround(f"c.{k}", 1).alias(k) for k in ("yaw", "pitch")])


def processing_time(recordings: DataFrame, fps: float = 25.0, per_frame_s: float = 1.86) -> DataFrame:
    """``recordings`` (frames, cameras and more) with duration_s, processing_s, processing_min and realtime_factor of their detection."""
    work, length = F.col("frames") * per_frame_s * F.col("cameras"), F.col("frames") / fps
    return recordings.withColumns({"duration_s": F.bround(length, 1), "processing_s": F.bround(work, 1), "processing_min": F.bround(work / 60, 1), "realtime_factor": F.bround(work / F.greatest(F.lit(1.0), length), 1)})
