"""Several cameras: pair costs, cross-view association, triangulation and reprojection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.geometry import distortion_weight, epipolar_distance, project

#: Body keypoints that decide whether two detections are one person.
MATCH_POINTS = (0, 5, 6, 11, 12)


def fundamentals(cams: list[tuple[int, list[float]]]) -> dict[tuple[int, int], np.ndarray]:
    """A fundamental matrix for each two cameras (cam, row-major projection), the lower number first."""
    return {(a, b): numeric.fundamental_of(pa, pb) for a, pa in cams for b, pb in cams if a < b}


def pair_costs(dets: DataFrame, pairs: dict[tuple[int, int], np.ndarray], conf: float = 0.3, points: tuple[int, ...] = MATCH_POINTS, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(keys, cam_a, cam_b, i, j, cost): the median epipolar distance of detections (keys, cam, det_pos, joint, u, v, conf) of two cameras.

    ``pairs`` has a fundamental matrix for each camera pair. At least two of ``points`` must be seen by both.
    """
    rows = [(a, b, [float(x) for x in f.ravel()]) for (a, b), f in pairs.items()]
    dim = F.broadcast(dets.sparkSession.createDataFrame(rows, "cam_a int, cam_b int, f array<double>"))
    own = dets.where(F.col("joint").isin(*points) & (F.col("conf") >= conf)).select(*keys, "cam", "det_pos", "joint", "u", "v")
    a = own.withColumnsRenamed({"cam": "cam_a", "det_pos": "i", "u": "ua", "v": "va"}).join(dim, "cam_a")
    b = own.withColumnsRenamed({"cam": "cam_b", "det_pos": "j", "u": "ub", "v": "vb"})
    both = a.join(b, [*keys, "joint", "cam_b"]).withColumn("d", epipolar_distance([F.get("f", k) for k in range(9)], "ua", "va", "ub", "vb")).where("d is not null")
    return both.groupBy(*keys, "cam_a", "cam_b", "i", "j").agg(F.percentile("d", F.lit(0.5)).alias("cost"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


def few_rows(batches, most: int = 64):
    """Arrow batches in parts of few rows, for rows with long lists that become Python objects."""
    for b in batches:
        for start in range(0, b.num_rows, most):
            yield b.slice(start, most)


def _joined(nodes: list[tuple[int, int]], edges: list[dict], limit: float) -> list[int]:
    """An actor for each node of a frame: an assignment for each camera pair, then union-find."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    by_pair: dict[tuple[int, int], list[dict]] = {}
    for e in edges:
        by_pair.setdefault((e["cam_a"], e["cam_b"]), []).append(e)
    for (a, b), part in sorted(by_pair.items()):
        left, right = ([p for c, p in nodes if c == cam] for cam in (a, b))
        place = {p: k for k, p in enumerate(left)}, {p: k for k, p in enumerate(right)}
        cost = np.full((len(left), len(right)), np.inf)
        for e in part:
            cost[place[0][e["i"]], place[1][e["j"]]] = e["cost"]
        for i, j in numeric.assign(cost):
            if cost[i, j] <= limit:
                x, y = root((a, left[i])), root((b, right[j]))
                up[max(x, y)] = min(x, y)
    ids: dict = {}
    return [ids.setdefault(root(n), len(ids)) for n in nodes]


def associate(dets: DataFrame, costs: DataFrame, limit: float = 50.0, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(keys, cam, det_pos, actor_id): detections of one person, by an assignment for each camera pair and union-find in each frame.

    A frame is a row with its detections and costs, so a call serves a whole batch of frames, some at a time.
    """
    nodes = dets.select(*keys, F.col("cam").cast("int"), F.col("det_pos").cast("int")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cam", "det_pos"))).alias("nodes"))
    edge = F.struct(*[F.col(c).cast("int").alias(c) for c in ("cam_a", "i", "cam_b", "j")], "cost")
    frames = nodes.join(costs.groupBy(*keys).agg(F.collect_list(edge).alias("edges")), list(keys), "left")
    kinds = ", ".join(f"{k} {dets.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in few_rows(batches):
            at, out = [], []
            for k, (own, edges) in enumerate(zip(b.column("nodes").to_pylist(), b.column("edges").to_pylist(), strict=True)):
                own = [(n["cam"], n["det_pos"]) for n in own]
                at += [k] * len(own)
                out += [(*n, actor) for n, actor in zip(own, _joined(own, edges or [], limit), strict=True)]
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k).take(pick) for k in keys] + [pa.array([r[d] for r in out], pa.int32()) for d in range(3)], [*keys, "cam", "det_pos", "actor_id"])

    return frames.select(*keys, "nodes", "edges").mapInArrow(run, f"{kinds}, cam int, det_pos int, actor_id int")


def _lens(points: DataFrame, lenses: DataFrame, bend) -> DataFrame:
    """``points`` with u and v replaced by ``bend`` of their normalised places; missing points stay missing."""
    names = points.columns
    rows = points.join(F.broadcast(lenses.select("cam", F.col("k").alias("__k"), F.col("dist").alias("__d"))), "cam").select(*names, "__k", "__d")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches):
        for b in batches:
            n = b.num_rows
            k = b.column("__k").flatten().to_numpy().reshape(n, 9)
            size = np.asarray(b.column("__d").value_lengths().to_numpy(zero_copy_only=False), int)
            d = np.zeros((n, 8))
            d[np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = b.column("__d").flatten().to_numpy()
            u, v = (b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "uv")
            fx, fy, cx, cy = k[:, 0], k[:, 4], k[:, 2], k[:, 5]
            seen = ~np.isnan(u) & ~np.isnan(v)
            out = np.full((n, 2), np.nan)
            out[seen] = bend(np.stack([(u - cx) / fx, (v - cy) / fy], 1)[seen], d[seen])
            new = {"u": out[:, 0] * fx + cx, "v": out[:, 1] * fy + cy}
            yield pa.RecordBatch.from_arrays([pa.array(np.nan_to_num(new[c]), mask=np.isnan(new[c])) if c in new else b.column(c) for c in names], names)

    return rows.mapInArrow(run, kinds)


def undistort(points: DataFrame, lenses: DataFrame) -> DataFrame:
    """Pixels (cam, u, v and more) as a camera without a lens would see them; ``lenses`` is (cam, k 3x3 row-major, dist k1 k2 p1 p2 [k3 [k4 k5 k6]]).

    Where the inverse does not settle the point is missing. Cameras are a handful and are broadcast; cameras without a
    lens are left out.
    """
    return _lens(points, lenses, numeric.undistort)


def distort(points: DataFrame, lenses: DataFrame) -> DataFrame:
    """The inverse of ``undistort``."""
    return _lens(points, lenses, numeric.distort)


def view_arrays(views: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projections (n, c, 3, 4), pixels (n, c, 2), weights (n, c) and which views there are, of lists of (u, v, w, p), padded to the longest."""
    lens = np.asarray(views.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    n, c = len(lens), int(lens.max()) if len(lens) else 0
    row = np.repeat(np.arange(n), lens)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
    flat = views.flatten()
    value = lambda name: pc.struct_field(flat, name)
    p, uv, w, seen = np.zeros((n, c, 3, 4)), np.zeros((n, c, 2)), np.zeros((n, c)), np.zeros((n, c), bool)
    if len(row):
        p[row, col] = value("p").flatten().to_numpy().reshape(-1, 3, 4)
        uv[row, col] = np.stack([value("u").to_numpy(zero_copy_only=False), value("v").to_numpy(zero_copy_only=False)], 1)
        w[row, col], seen[row, col] = value("w").to_numpy(zero_copy_only=False), True
    return p, uv, w, seen


def triangulate(obs: DataFrame, cameras: DataFrame, conf: float = 0.0, weighted: bool = False, width: float = 640.0, height: float = 480.0) -> DataFrame:
    """(seq_id, frame, joint, x, y, z, n_cams): linear triangulation of points that two cameras or more see.

    ``weighted`` weighs a view by its closeness to the image centre. Each point is a row with its views; Arrow batches are
    solved together, views padded to the most of the batch.
    """
    seen = obs.where((F.col("conf") > conf) & F.col("u").isNotNull() & F.col("v").isNotNull()).join(F.broadcast(cameras), "cam")
    w = distortion_weight("u", "v", width, height) if weighted else F.lit(1.0)
    rows = seen.groupBy("seq_id", "frame", "joint").agg(F.array_sort(F.collect_list(F.struct("cam", "u", "v", w.alias("w"), "p"))).alias("views")).where(F.size("views") >= 2)
    seq = rows.schema["seq_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            p, uv, wt, seen = view_arrays(b.column("views"))
            x = numeric.triangulate(p, uv, wt) if b.num_rows else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([b.column("seq_id"), b.column("frame"), b.column("joint"), *[pa.array(np.nan_to_num(x[:, k]), mask=np.isnan(x[:, k])) for k in range(3)], pa.array(seen.sum(1), pa.int32())], ["seq_id", "frame", "joint", "x", "y", "z", "n_cams"])

    return rows.mapInArrow(run, f"seq_id {seq}, frame int, joint int, x double, y double, z double, n_cams int")


def reprojection_errors(points: DataFrame, obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """(seq_id, cam, frame, joint, err): pixels between an observation and the projection of its point."""
    u, v = project("p", "x", "y", "z")
    seen = obs.join(F.broadcast(cameras), "cam").join(points.select("seq_id", "frame", "joint", "x", "y", "z"), ["seq_id", "frame", "joint"])
    return seen.withColumns({"pu": u, "pv": v}).select("seq_id", "cam", "frame", "joint", F.sqrt(F.pow(F.col("u") - F.col("pu"), 2) + F.pow(F.col("v") - F.col("pv"), 2)).alias("err")).where("err is not null")


def coverage(cameras: DataFrame, grid: DataFrame) -> DataFrame:
    """(x, z, n_cams) of a floor grid (x, y, z) under cameras (cam, cx..cz, dx..dz, h_fov, v_fov), the most over heights.

    Cameras are a handful and are broadcast; the grid stays distributed.
    """
    from ..functions.geometry import in_frustum

    seen = in_frustum("x", "y", "z", "cx", "cy", "cz", "dx", "dy", "dz", "h_fov", "v_fov")
    cells = grid.join(F.broadcast(cameras), how="cross").groupBy("x", "y", "z").agg(F.count_if(seen).alias("n"))
    return cells.groupBy("x", "z").agg(F.max("n").alias("n_cams"))


def coverage_heatmap(cameras: DataFrame, grid: DataFrame, width: float = 640.0, height: float = 480.0) -> DataFrame:
    """(x, z, n_cams): how many cameras (cam, p) have a cell of ``grid`` (x, y, z) in their image, the most over heights.

    Points behind a camera count by where they project. Cameras are a handful and are broadcast.
    """
    u, v = project("p", "x", "y", "z")
    seen = F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))
    cells = grid.join(F.broadcast(cameras), how="cross").groupBy("x", "y", "z").agg(F.count_if(seen).alias("n"))
    return cells.groupBy("x", "z").agg(F.max("n").alias("n_cams"))


def coverage_summary(heatmap: DataFrame) -> DataFrame:
    """(n_cams, cells, percent, percent_or_more) for each number of cameras that some cell has."""
    counts = heatmap.groupBy("n_cams").agg(F.count(F.lit(1)).alias("cells"))
    total = heatmap.agg(F.count(F.lit(1)).alias("total"))
    more = counts.select(F.col("n_cams").alias("k"), F.col("cells").alias("c"))  # numbers of cameras: a handful
    at_least = counts.join(F.broadcast(more), F.col("k") >= F.col("n_cams")).groupBy("n_cams", "cells").agg(F.sum("c").alias("or_more"))
    return at_least.join(F.broadcast(total), how="cross").select("n_cams", "cells", (F.col("cells") / F.col("total") * 100).alias("percent"), (F.col("or_more") / F.col("total") * 100).alias("percent_or_more"))


def same_time(a: DataFrame, b: DataFrame, cam: str | None = None) -> DataFrame:
    """(t, frame_a, frame_b): the frames of two cameras (t, frame) that have one time stamp.

    With ``cam`` the tables hold several cameras, named by that column, and every two of them are joined: (cam_a, cam_b) lead.
    """
    side = lambda df, x: df.select("t", F.col("frame").alias(f"frame_{x}"), *([F.col(cam).alias(f"cam_{x}")] if cam else []))
    both = side(a, "a").join(side(b, "b"), "t")
    return both.where("cam_a < cam_b").select("cam_a", "cam_b", "t", "frame_a", "frame_b") if cam else both


def pose_similarity(a: DataFrame, b: DataFrame, conf: float = 0.3, scale: float = 50.0, cam: str | None = None) -> DataFrame:
    """(seq_id, frame, similarity) of the poses of two cameras (seq_id, frame, joint, u, v, conf): exp(-mean distance / scale) over joints both are sure of, else 0.

    With ``cam`` the tables hold several cameras, named by that column, and every two of them are compared: (cam_a, cam_b) are keys too.
    """
    keys = ["seq_id", "frame"]
    b = b.select("seq_id", "frame", "joint", F.col("u").alias("bu"), F.col("v").alias("bv"), F.col("conf").alias("bc"), *([F.col(cam).alias("cam_b")] if cam else []))
    both = (a.withColumnRenamed(cam, "cam_a") if cam else a).join(b, ["seq_id", "frame", "joint"])
    if cam:
        both, keys = both.where("cam_a < cam_b"), [*keys, "cam_a", "cam_b"]
    apart = F.sqrt((F.col("u") - F.col("bu")) * (F.col("u") - F.col("bu")) + (F.col("v") - F.col("bv")) * (F.col("v") - F.col("bv")))
    mean = F.avg(F.when((F.col("conf") > conf) & (F.col("bc") > conf), apart))
    return both.groupBy(*keys).agg(F.coalesce(F.exp(-mean / scale), F.lit(0.0)).alias("similarity"))


def near_plane(points: DataFrame, normal: tuple[float, float, float], point: tuple[float, float, float], most: float = 30.0) -> DataFrame:
    """The points closer than ``most`` to a plane; missing points are not."""
    size = sum(c * c for c in normal) ** 0.5
    off = F.abs(sum((F.col(c) - p) * (n / size) for c, p, n in zip("xyz", point, normal, strict=True)))
    return points.where(off < most)
