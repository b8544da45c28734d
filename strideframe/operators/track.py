"""Identities over time: a feature tracker and a two-stage box tracker, serial in each sequence.

The step functions work on plain state, so the batch form (one group for each sequence) and the streaming form share them.
Detections are (seq_id, frame, actor_id, x1, y1, x2, y2, conf, feature array of normalised keypoints, null if too few).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import assign, assigned_means, iou, ious

OUT = "seq_id {seq}, frame int, actor_id int, global_id int"


def keypoint_distances(a: list[np.ndarray | None], b: list[np.ndarray | None]) -> np.ndarray:
    """Mean distances of every set of normalised points of ``a`` to every one of ``b`` under their best assignment; infinite without points.

    All pairs are solved together, sets padded to the largest.
    """
    out = np.full((len(a), len(b)), np.inf)
    whole = lambda sets: [k for k, s in enumerate(sets) if s is not None and s.size and np.isfinite(s).all()]
    left, right = whole(a), whole(b)
    if not left or not right:
        return out

    def padded(sets):
        p = np.zeros((len(sets), max(len(s) for s in sets), 2))
        for k, s in enumerate(sets):
            p[k, : len(s)] = s
        return p, np.array([len(s) for s in sets])

    (p, n), (q, m) = padded([a[k] for k in left]), padded([b[k] for k in right])
    d = np.sqrt(((p[:, None, :, None] - q[None, :, None]) ** 2).sum(-1))
    out[np.ix_(left, right)] = assigned_means(d.reshape(-1, *d.shape[2:]), np.repeat(n, len(m)), np.tile(m, len(n))).reshape(len(n), len(m))
    return out


@dataclass
class FeatureTracker:
    """Costs of keypoint distance less overlap; lost tracks may be found again within ``search_window`` frames."""

    keypoint_weight: float = 0.7
    iou_weight: float = 0.3
    search_window: int = 30
    max_distance: float = 100.0
    next_id: int = 0
    tracks: dict[int, dict] = field(default_factory=dict)
    anchors: dict[int, int] = field(default_factory=dict)

    def _new(self, frame: int, actor: dict) -> int:
        gid, self.next_id = self.next_id, self.next_id + 1
        self.tracks[gid] = {"id": gid, "seen": frame, "lost": None, "box": actor["box"], "feature": actor["feature"]}
        return gid

    def _seen(self, track: dict, frame: int, actor: dict) -> int:
        track |= {"seen": frame, "lost": None, "box": actor["box"]}
        if actor["feature"] is not None:
            track["feature"] = actor["feature"]
        return track["id"]

    def step(self, frame: int, actors: list[dict], markers: dict[int, int] | None = None) -> dict[int, int]:
        """Actors (actor_id, box, feature) of a frame to global ids; ``markers`` (marker, actor_id) anchor identities."""
        out: dict[int, int] = {}
        live = [t for t in self.tracks.values() if t["lost"] is None or frame - t["lost"] <= self.search_window]
        held = {t["id"] for t in live} | set(self.anchors.values())  # no other can be found again
        self.tracks = {gid: t for gid, t in self.tracks.items() if gid in held}
        by_id = {a["actor_id"]: a for a in actors}
        for marker, actor_id in (markers or {}).items():
            if actor_id in by_id and actor_id not in out:
                gid = self.anchors.get(marker)
                out[actor_id] = self._new(frame, by_id[actor_id]) if gid is None else self._seen(self.tracks[gid], frame, by_id[actor_id])
                self.anchors[marker] = out[actor_id]
        free = [a for a in actors if a["actor_id"] not in out]
        open_tracks = [t for t in live if t["id"] not in out.values()]
        cost = self.keypoint_weight * keypoint_distances([t["feature"] for t in open_tracks], [a["feature"] for a in free])
        for i, j in zip(*np.nonzero(np.isfinite(cost)), strict=True):
            cost[i, j] -= self.iou_weight * iou(open_tracks[i]["box"], free[j]["box"])
        finite = np.isfinite(cost)
        penalty = max(10 * cost[finite].max(), 2 * self.max_distance) if finite.any() else None
        for i, j in assign(cost, penalty):
            out[free[j]["actor_id"]] = self._seen(open_tracks[i], frame, free[j])
        for t in open_tracks:
            if t["lost"] is None and t["seen"] != frame:
                t["lost"] = frame
        for a in free:
            if a["actor_id"] not in out:
                out[a["actor_id"]] = self._new(frame, a)
        return out


class BoxFilter:
    """Constant-velocity Kalman filter of a box (centre, width, height)."""

    def __init__(self, box, q: float = 0.01, r: float = 10.0, p: float = 10.0):
        self.x = np.concatenate([self.measure(box), np.zeros(4)])
        self.p, self.q, self.r = np.eye(8) * p, np.eye(8) * q, np.eye(4) * r
        self.f = np.eye(8) + np.eye(8, k=4)

    @staticmethod
    def measure(b) -> np.ndarray:
        return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, max(b[2] - b[0], 1.0), max(b[3] - b[1], 1.0)])

    def predict(self) -> None:
        self.x, self.p = self.f @ self.x, self.f @ self.p @ self.f.T + self.q

    def update(self, box) -> None:
        gain = self.p[:, :4] @ np.linalg.inv(self.p[:4, :4] + self.r)
        self.x = self.x + gain @ (self.measure(box) - self.x[:4])
        self.p = self.p - gain @ self.p[:4]

    def box(self) -> list[float]:
        cx, cy, w, h = self.x[0], self.x[1], max(self.x[2], 1.0), max(self.x[3], 1.0)
        return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


@dataclass
class BoxTracker:
    """Confident boxes are matched to predicted tracks first, then faint ones to what is left; unmatched boxes start tracks."""

    high: float = 0.5
    low: float = 0.1
    iou_high: float = 0.3
    iou_low: float = 0.5
    max_age: int = 30
    next_id: int = 0
    tracks: list[dict] = field(default_factory=list)

    def step(self, frame: int, actors: list[dict]) -> dict[int, int]:
        out: dict[int, int] = {}
        self.tracks = live = [t for t in self.tracks if frame - t["seen"] <= self.max_age]
        for t in live:
            t["filter"].predict()
        for keep, gate in ((lambda c: c >= self.high, self.iou_high), (lambda c: self.low <= c < self.high, self.iou_low)):
            free = [a for a in actors if keep(a["conf"]) and a["actor_id"] not in out]
            idle = [t for t in live if t["id"] not in out.values()]
            overlap = ious([t["filter"].box() for t in idle], [a["box"] for a in free])
            for i, j in assign(np.where(overlap >= gate, 1 - overlap, np.inf)):
                idle[i]["filter"].update(free[j]["box"])
                idle[i]["seen"] = frame
                out[free[j]["actor_id"]] = idle[i]["id"]
        for a in actors:
            if a["actor_id"] not in out:
                out[a["actor_id"]] = self.next_id
                self.tracks.append({"id": self.next_id, "seen": frame, "filter": BoxFilter(a["box"])})
                self.next_id += 1
        return out


class BoxTracks:
    """``BoxTracker`` over many sequences at once: a frame of all of them takes a fixed number of array operations.

    Row s of the state is sequence s, its slots are that sequence's tracks; a track that is too old leaves its slot. The
    filter's noises are the same in a box's four measures, so one covariance of place and speed serves all four (z is 4
    places, 4 speeds, the covariance by rows). Sums run in ``BoxFilter``'s order, so identities are ``BoxTracker``'s.
    """

    def __init__(self, high: float = 0.5, low: float = 0.1, iou_high: float = 0.3, iou_low: float = 0.5, max_age: int = 30):
        self.high, self.low, self.iou_high, self.iou_low, self.max_age = high, low, iou_high, iou_low, max_age
        self.z, self.seen, self.ids, self.next_id = np.zeros((0, 12, 8)), np.zeros((0, 8), int), np.zeros((0, 8), int), np.zeros(0, int)

    def reserve(self, rows: int, slots: int = 0) -> None:
        """Room for that many sequences and tracks of each."""
        old, width = self.seen.shape
        more = (max(rows - old, 0), max(slots - width, 0))
        self.z = np.pad(self.z, ((0, more[0]), (0, 0), (0, more[1])))
        self.seen = np.pad(self.seen, ((0, more[0]), (0, more[1])), constant_values=-(2**40))  # older than any track
        self.ids, self.next_id = np.pad(self.ids, ((0, more[0]), (0, more[1]))), np.pad(self.next_id, (0, more[0]))

    def step(self, frame: int, s: np.ndarray, box: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """Identities of a frame's detections, given by sequence (``s``, in groups), box (n, 4) and confidence."""
        start = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=start[1:])
        rows, at = s[start], start.cumsum() - 1
        z, seen = self.z[rows], self.seen[rows]
        z[:, :4] += z[:, 4:8]
        cross = z[:, 9] + z[:, 11]
        z[:, 8] = z[:, 8] + z[:, 10] + cross + 0.01
        z[:, 10] += z[:, 11]
        z[:, 9] = cross
        z[:, 11] += 0.01
        half = np.maximum(z[:, 2:4], 1.0) / 2
        lo, hi = z[:, :2] - half, z[:, :2] + half
        size = hi - lo
        area = np.maximum(size[:, 0] * size[:, 1], 1.0)
        side = np.maximum(np.minimum(hi[at], box[:, 2:, None]) - np.maximum(lo[at], box[:, :2, None]), 0)
        inter = side[:, 0] * side[:, 1]
        wide = box[:, 2:] - box[:, :2]
        overlap = inter / (area[at] + np.maximum(wide[:, 0] * wide[:, 1], 1.0)[:, None] - inter)
        sure = conf >= self.high
        gate = np.where(sure, self.iou_high, np.where(conf >= self.low, self.iou_low, np.inf))
        fits = (overlap >= gate[:, None]) & (frame - seen <= self.max_age)[at]
        measured = np.concatenate([(box[:, :2] + box[:, 2:]) / 2, np.maximum(wide, 1.0)], axis=1)
        out = np.full(len(s), -1)
        if fits.any():
            d, k = self._pairs(fits, overlap, sure, rows, at)
            a = at[d]
            x = z[a, :, k]
            scale = 1.0 / (x[:, 8] + 10.0)
            g, h = (x[:, 8] * scale)[:, None], (x[:, 10] * scale)[:, None]
            off = measured[d] - x[:, :4]
            z[a, :, k] = np.concatenate([x[:, :4] + g * off, x[:, 4:8] + h * off, x[:, 8:10] - g * x[:, 8:10], x[:, 10:] - h * x[:, 8:10]], axis=1)
            seen[a, k], out[d] = frame, self.ids[rows[a], k]
        new = np.flatnonzero(out < 0)
        a = at[new]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        free = (frame - seen > self.max_age).cumsum(axis=1)
        if len(a) and (short := int((nth + 1 - free[a, -1]).max())) > 0:
            width = seen.shape[1]
            self.reserve(len(self.seen), width + max(short, width // 2))
            more = self.seen.shape[1] - width
            z, seen = np.pad(z, ((0, 0), (0, 0), (0, more))), np.pad(seen, ((0, 0), (0, more)), constant_values=-(2**40))
            free = (frame - seen > self.max_age).cumsum(axis=1)
        k = (free[a] > nth[:, None]).argmax(axis=1)
        out[new] = self.next_id[rows[a]] + nth
        z[a, :4, k], z[a, 4:, k], seen[a, k] = measured[new], (0, 0, 0, 0, 10, 0, 0, 10), frame
        self.ids[rows[a], k] = out[new]
        self.next_id += np.bincount(rows[a], minlength=len(self.next_id))
        self.z[rows], self.seen[rows] = z, seen
        return out

    def _pairs(self, fits, overlap, sure, rows, at) -> tuple[np.ndarray, np.ndarray]:
        """Detections and their slots: the sure ones first, the faint ones among the tracks left; where several compete, by assignment."""
        found: list[tuple[int, int]] = []
        taken: set[tuple[int, int]] = set()
        by_row: dict[tuple[bool, int], list[tuple[int, int]]] = {}
        for d, k in zip(*(x.tolist() for x in np.nonzero(fits)), strict=True):
            by_row.setdefault((not sure[d], int(at[d])), []).append((d, k))
        for (_, a), pairs in sorted(by_row.items()):
            pairs = [p for p in pairs if (a, p[1]) not in taken]
            ds, ks = sorted({d for d, _ in pairs}), sorted({k for _, k in pairs}, key=lambda k: self.ids[rows[a], k])
            if len(ds) < len(pairs) or len(ks) < len(pairs):
                cost = np.full((len(ks), len(ds)), np.inf)
                for d, k in pairs:
                    cost[ks.index(k), ds.index(d)] = 1 - overlap[d, k]
                pairs = [(ds[j], ks[i]) for i, j in assign(cost)]
            found += pairs
            taken |= {(a, k) for _, k in pairs}
        return np.array([d for d, _ in found], int), np.array([k for _, k in found], int)


def _spread(dets: DataFrame) -> DataFrame:
    """Sequences over some tasks for each core, as they differ, however few bytes they are: the work on a row is long."""
    return dets.repartition(3 * dets.sparkSession.sparkContext.defaultParallelism, "seq_id")


def _box_tracks(dets: DataFrame, seq: str, options: dict) -> DataFrame:
    """Sequences side by side: each task steps its sequences together, frame by frame, and holds their tracks and one frame."""
    numbers = ["x1", "y1", "x2", "y2", "conf"]

    def run(batches):
        tracks, row_of, rest = BoxTracks(**options), {}, None

        def stepped(b: pa.RecordBatch) -> pa.RecordBatch:
            codes = b.column("seq_id").dictionary_encode(null_encoding="encode")
            s = np.array([row_of.setdefault(v, len(row_of)) for v in codes.dictionary.to_pylist()], int)[codes.indices.to_numpy()]
            tracks.reserve(len(row_of))
            frames = b.column("frame").to_numpy()
            *box, conf = (b.column(c).to_numpy(zero_copy_only=False) for c in numbers)
            box, ends = np.stack(box, axis=1), [*(np.flatnonzero(frames[1:] != frames[:-1]) + 1).tolist(), len(frames)]
            out = [tracks.step(int(frames[i]), s[i:j], box[i:j], conf[i:j]) for i, j in zip([0, *ends], ends)]
            return pa.RecordBatch.from_arrays([b.column("seq_id"), b.column("frame"), b.column("actor_id"), pa.array(np.concatenate(out), pa.int32())], ["seq_id", "frame", "actor_id", "global_id"])

        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.concat_batches([rest, b])
            frames = b.column("frame").to_numpy()
            cut = int(np.searchsorted(frames, frames[-1]))  # the last frame may go on in the next batch
            if cut:
                yield stepped(b.slice(0, cut))
            rest = b.slice(cut)
        if rest is not None:
            yield stepped(rest)

    rows = dets.where("frame is not null").select("seq_id", *[F.col(c).cast("int").alias(c) for c in ("frame", "actor_id")], *[F.col(c).cast("double").alias(c) for c in numbers])
    return _spread(rows).sortWithinPartitions("frame", "seq_id", "actor_id").mapInArrow(run, OUT.format(seq=seq))


def frames_of(pdf: pd.DataFrame):
    """(frame, actors, markers) of a sequence in order; ties of a frame by actor id."""
    for frame, part in pdf.sort_values(["frame", "actor_id"]).groupby("frame", sort=True):
        markers = {int(m): int(a) for m, a in zip(part["marker"], part["actor_id"], strict=True) if m == m and m is not None} if "marker" in part else {}
        yield int(frame), [{"actor_id": int(r.actor_id), "box": [r.x1, r.y1, r.x2, r.y2], "conf": float(r.conf), "feature": None if r.feature is None else np.asarray(r.feature, float).reshape(-1, 2)} for r in part.itertuples()], markers


def track(dets: DataFrame, method: str = "feature", **options) -> DataFrame:
    """(seq_id, frame, actor_id, global_id), one serial pass over each sequence. A ``marker`` column anchors the feature tracker's identities."""
    seq = dets.schema["seq_id"].dataType.simpleString()
    if method == "box":
        return _box_tracks(dets, seq, options)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tracker = FeatureTracker(**options)
        rows = [(key[0], f, a, g) for f, actors, markers in frames_of(pdf) for a, g in tracker.step(f, actors, markers).items()]
        return pd.DataFrame(rows, columns=["seq_id", "frame", "actor_id", "global_id"])

    return _spread(dets).groupBy("seq_id").applyInPandas(run, OUT.format(seq=seq))


def track_summary(tracks: DataFrame) -> DataFrame:
    """Per track: first and last frame, frames seen."""
    return tracks.groupBy("seq_id", "global_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count(F.lit(1)).alias("frames"))
