"""Feet, floor and wrists: contact runs, ground alignment, wrist consistency, rolling shutter."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import layouts
from ..functions.geometry import severity, valid
from .bones import foot_centres, proportions
from .windows import by, median


def velocities(points: DataFrame, keys: list[str], fps: float = 30.0) -> DataFrame:
    """Adds vx, vy, vz: central differences (one-sided at the ends; a missing neighbour gives null)."""
    w = by(keys)
    n, m = F.lag("frame").over(w), F.lead("frame").over(w)

    def v(c):
        a, b = F.when(n.isNotNull(), F.lag(c).over(w)).otherwise(F.col(c)), F.when(m.isNotNull(), F.lead(c).over(w)).otherwise(F.col(c))
        return (b - a) / (F.when(m.isNotNull(), m).otherwise(F.col("frame")) - F.when(n.isNotNull(), n).otherwise(F.col("frame"))) * fps

    return points.withColumns({f"v{c}": v(c) for c in "xyz"})


def foot_contacts(points: DataFrame, least: int = 3, floor_speed: float = 0.5, fps: float = 30.0) -> DataFrame:
    """(seq_id, side, start, end, length, mx, my, mz): runs of slow frames of a foot and its mean place.

    Slow is below the larger of the first quartile of the foot's speeds and ``floor_speed``, both a second.
    """
    feet = velocities(foot_centres(points), ["seq_id", "side"], fps).withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")))
    limit = feet.groupBy("seq_id", "side").agg(F.greatest(F.percentile("speed", F.lit(0.25)), F.lit(floor_speed)).alias("limit"))
    slow = feet.join(limit, ["seq_id", "side"]).where("speed < limit")
    runs = slow.withColumn("g", F.col("frame") - F.row_number().over(by(["seq_id", "side"])))
    out = runs.groupBy("seq_id", "side", "g").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("length"), *[F.avg(c).alias(f"m{c}") for c in "xyz"])
    return out.drop("g").where(F.col("length") >= least)


def pin_feet(points: DataFrame, blend: int = 5, **contact) -> DataFrame:
    """Foot markers shifted so that the foot stays at its run's mean place; the shift fades in and out within the run.

    The fade takes ``blend`` frames at either end, at most half of the run.
    """
    runs = foot_contacts(points, **contact)
    side = F.when(F.col("joint").isin(*layouts.FEET["left"]), "left").when(F.col("joint").isin(*layouts.FEET["right"]), "right")
    centre = foot_centres(points).select("seq_id", "side", "frame", *[F.col(c).alias(f"c{c}") for c in "xyz"])
    spans = runs.select("seq_id", "side", "start", "end", "length", "mx", "my", "mz", F.explode(F.sequence("start", "end")).alias("frame"))
    fade = F.least(F.lit(blend), F.floor(F.col("length") / 2)) + 1.0
    a = F.least(F.lit(1.0), (F.least(F.col("frame") - F.col("start"), F.col("end") - F.col("frame")) + 1) / fade)
    shift = spans.join(centre, ["seq_id", "side", "frame"]).select("seq_id", "side", "frame", *[(a * (F.col(f"m{c}") - F.col(f"c{c}"))).alias(f"s{c}") for c in "xyz"])
    out = points.withColumn("side", side).join(shift, ["seq_id", "side", "frame"], "left")
    return out.select("seq_id", "frame", "joint", *[(F.col(c) + F.coalesce(f"s{c}", F.lit(0.0))).alias(c) for c in "xyz"])


def ground_planes(points: DataFrame, share: float = 0.10, dominance: float = 0.3) -> DataFrame:
    """(seq_id, nx, ny, nz, n): a normal for each sequence from the slowest and lowest foot positions.

    Covariances are aggregates; the 3x3 eigenvectors come from a vectorised Arrow function, a row for each sequence.
    """
    feet = foot_centres(points).where(valid())
    w = by(["seq_id", "side"])
    feet = feet.withColumn("speed", F.sqrt(sum(F.pow(F.col(c) - F.lag(c).over(w), 2) for c in "xyz")) / (F.col("frame") - F.lag("frame").over(w))).where("speed is not null")
    ends = feet.groupBy("seq_id", "side").agg(*[f(c).alias(f"{n}_{c}") for c in ("speed", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))], F.count(F.lit(1)).alias("k")).where("k >= 10")
    unit = lambda c: F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)), F.lit(0.0))
    scored = feet.join(ends, ["seq_id", "side"]).withColumn("score", 0.5 * unit("speed") + 0.5 * unit("y"))
    cut = scored.groupBy("seq_id", "side").agg(F.percentile("score", F.lit(share)).alias("cut"))
    floor = scored.join(cut, ["seq_id", "side"]).where("score <= cut")
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    cov = floor.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs]).where("n >= 5")
    seq = cov.schema["seq_id"].dataType.simpleString()

    def normals(batches):
        for pdf in batches:
            c = {p: pdf["c" + "".join(p)].to_numpy() for p in pairs}
            m = np.stack([np.stack([c[("x", "x")], c[("x", "y")], c[("x", "z")]], -1), np.stack([c[("x", "y")], c[("y", "y")], c[("y", "z")]], -1), np.stack([c[("x", "z")], c[("y", "z")], c[("z", "z")]], -1)], -2)
            n = np.linalg.eigh(m)[1][:, :, 0] if len(pdf) else np.zeros((0, 3))
            n = np.where(n[:, 1:2] < 0, -n, n)
            n = np.where(np.abs(n[:, 1:2]) < dominance, np.array([[0.0, 1.0, 0.0]]), n)
            yield pdf[["seq_id"]].assign(nx=n[:, 0], ny=n[:, 1], nz=n[:, 2], n=pdf["n"])

    return cov.mapInPandas(normals, f"seq_id {seq}, nx double, ny double, nz double, n long")


def align_to_ground(points: DataFrame, planes: DataFrame, height: float | None = None) -> DataFrame:
    """Each sequence rotated so that its normal is up, shifted so that its lowest foot is at 0, and scaled to ``height`` if given."""
    s = F.sqrt(F.col("nx") * F.col("nx") + F.col("nz") * F.col("nz"))
    c = F.col("ny")
    ax, az = F.when(s > 1e-12, -F.col("nz") / s).otherwise(0.0), F.when(s > 1e-12, F.col("nx") / s).otherwise(0.0)
    turn = planes.select("seq_id", c.alias("c"), s.alias("s"), ax.alias("ax"), az.alias("az"))
    p = points.join(turn, "seq_id", "left")
    dot = F.col("ax") * F.col("x") + F.col("az") * F.col("z")
    rot = {
        "x": F.col("x") * F.col("c") + (-F.col("az") * F.col("y")) * F.col("s") + F.col("ax") * dot * (1 - F.col("c")),
        "y": F.col("y") * F.col("c") + (F.col("az") * F.col("x") - F.col("ax") * F.col("z")) * F.col("s"),
        "z": F.col("z") * F.col("c") + (F.col("ax") * F.col("y")) * F.col("s") + F.col("az") * dot * (1 - F.col("c")),
    }
    turned = p.select("seq_id", "frame", "joint", *[F.when(F.col("c").isNotNull(), rot[d]).otherwise(F.col(d)).alias(d) for d in "xyz"])
    low = foot_centres(turned).groupBy("seq_id").agg(F.min("y").alias("low"))
    flat = turned.join(low, "seq_id", "left").select("seq_id", "frame", "joint", "x", (F.col("y") - F.coalesce("low", F.lit(0.0))).alias("y"), "z")
    if height is None:
        return flat
    scale = proportions(flat).select("seq_id", (F.lit(height) / F.nullif("height", F.lit(0.0))).alias("k"))
    return flat.join(scale, "seq_id", "left").select("seq_id", "frame", "joint", *[(F.col(d) * F.coalesce("k", F.lit(1.0))).alias(d) for d in "xyz"])


def floor_penetration(points: DataFrame, plane_y: float | None = None, margin: float = 10.0) -> DataFrame:
    """Foot points below the plane less ``margin``; without ``plane_y`` the plane is each sequence's lowest foot, so none are."""
    feet = points.where(F.col("joint").isin(*layouts.FEET["left"], *layouts.FEET["right"]) & F.col("y").isNotNull())
    if plane_y is not None:
        return feet.where(F.col("y") < plane_y - margin)
    low = feet.groupBy("seq_id").agg(F.min("y").alias("low"))
    return feet.join(low, "seq_id").where(F.col("y") < F.col("low") - margin).drop("low")


def wrist_mismatch(points: DataFrame, wrist: int, hand: int, flag: float = 50.0) -> DataFrame:
    """Per sequence: distance of a body wrist and the hand's base: mean, greatest, median, 95th percentile, flagged frames."""
    a = points.where(F.col("joint") == wrist).select("seq_id", "frame", *[F.col(c).alias(f"w{c}") for c in "xyz"])
    d = a.join(points.where(F.col("joint") == hand), ["seq_id", "frame"]).withColumn("d", F.sqrt(sum(F.pow(F.col(c) - F.col(f"w{c}"), 2) for c in "xyz"))).where("d is not null")
    return d.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.max("d").alias("max"), median("d").alias("median"), F.percentile("d", F.lit(0.95)).alias("p95"), F.count_if(F.col("d") > flag).alias("flagged"))


def fix_wrists(points: DataFrame, wrist: int, hand: list[int], strategy: str = "confidence_weighted") -> DataFrame:
    """Where wrist and hand base part by more than median + 3 deviations, the hand moves; the body stays.

    body_wins brings the base to the wrist, average half way, hand_wins nowhere. confidence_weighted goes by which of the two moved less over the
    last five frames, and the hand's points follow their base the less the further off they are, by the hand's mean radius in frames where it is whole.
    """
    base = hand[0]
    steps = lambda j, n: points.where(F.col("joint") == j).select("seq_id", "frame", *[F.col(c).alias(f"{n}{c}") for c in "xyz"]).withColumn(f"{n}s", F.avg(F.sqrt(sum(F.pow(F.col(f"{n}{c}") - F.lag(f"{n}{c}").over(by(["seq_id"])), 2) for c in "xyz"))).over(by(["seq_id"]).rowsBetween(-4, 0)))
    both = steps(wrist, "w").join(steps(base, "h"), ["seq_id", "frame"]).withColumn("d", F.sqrt(sum(F.pow(F.col(f"h{c}") - F.col(f"w{c}"), 2) for c in "xyz"))).where("d is not null")
    cut = both.groupBy("seq_id").agg((median("d") + 3 * F.stddev_pop("d")).alias("cut"))
    total = F.col("hs") + F.col("ws")
    share = {"confidence_weighted": F.when(total.isNull(), 0.5).when(total > 0, F.col("hs") / total).otherwise(0.0), "average": F.lit(0.5), "body_wins": F.lit(1.0), "hand_wins": F.lit(0.0)}[strategy]
    own = points.where(F.col("joint").isin(hand)).join(both, ["seq_id", "frame"], "left").withColumn("r", F.sqrt(sum(F.pow(F.col(c) - F.col(f"h{c}"), 2) for c in "xyz")))
    bases = points.where(F.col("joint") == base).select("seq_id", "frame", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    radius = points.where(F.col("joint").isin(hand)).join(bases, ["seq_id", "frame"]).withColumn("r", F.sqrt(sum(F.pow(F.col(c) - F.col(f"b{c}"), 2) for c in "xyz")))
    radius = radius.groupBy("seq_id", "frame").agg(F.count("r").alias("n"), F.avg("r").alias("r")).where(F.col("n") == len(hand)).groupBy("seq_id").agg(F.avg("r").alias("radius"))
    bad = own.join(cut, "seq_id").where("d > cut").join(radius, "seq_id", "left")
    fade = 1 / (1 + F.col("r") / F.coalesce(F.nullif("radius", F.lit(0.0)), F.lit(1.0))) if strategy == "confidence_weighted" else F.lit(1.0)
    moved = bad.select("seq_id", "frame", "joint", *[(fade * share * (F.col(f"w{c}") - F.col(f"h{c}"))).alias(f"m{c}") for c in "xyz"])
    return points.join(moved, ["seq_id", "frame", "joint"], "left").select("seq_id", "frame", "joint", *[(F.col(c) + F.coalesce(f"m{c}", F.lit(0.0))).alias(c) for c in "xyz"])


def rolling_shutter(points: DataFrame, readout_ms: float = 16.0, fps: float = 30.0, rows: float = 1080.0, strength: float = 1.0) -> DataFrame:
    """Points moved back by velocity times the read-out time of their image row; ``y_px`` gives the row (without it nothing moves)."""
    if "y_px" not in points.columns:
        return points
    late = (F.col("y_px") / rows - 0.5) * (readout_ms / 1000 * strength)
    return velocities(points, ["seq_id", "joint"], fps).select("seq_id", "frame", "joint", *[(F.col(c) - late * F.coalesce(f"v{c}", F.lit(0.0))).alias(c) for c in "xyz"])


def shutter_severity(points: DataFrame, readout_ms: float = 16.0, fps: float = 30.0) -> DataFrame:
    """(seq_id, frame, distortion, severity) by the fastest joint's travel during read-out; unnoticeable frames are left out."""
    v = velocities(points, ["seq_id", "joint"], fps).withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")))
    worst = v.groupBy("seq_id", "frame").agg((F.max("speed") * (readout_ms / 1000)).alias("distortion")).where("distortion > 0.1")
    return worst.withColumn("severity", severity("distortion", (5.0, "severe"), (1.0, "moderate"), otherwise="mild"))


def rodrigues(vector) -> np.ndarray:
    """The rotation matrix of a rotation vector."""
    v = np.asarray(vector, float)
    a = math.sqrt(float(v @ v))
    if a == 0:
        return np.eye(3)
    k = v / a
    m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + math.sin(a) * m + (1 - math.cos(a)) * m @ m
