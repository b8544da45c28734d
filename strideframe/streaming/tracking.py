"""Trackers and the drift monitor on event time: whole frames, stepped in order once the watermark has passed them.

A frame may come in any number of micro-batches and in any order; its rows wait in map state, and an event-time timer at
the frame's time steps it when no row of it can come any more. Rows behind the watermark are dropped by Spark, which counts
them in the query's progress (``numRowsDroppedByWatermark``). What waits is bounded by the watermark's delay, and trackers
drop tracks that nothing can match again, so state does not grow with the stream. A sequence's results are those of the
batch form over the rows that were not late. The state store must be RocksDB (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.track import BoxFilter, BoxTracker, FeatureTracker

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Set the state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class InOrder(StatefulProcessor):
    """Holds rows by event time and steps them in order. Subclasses give schemas and ``step``; rows of a time are told apart by ``item``."""

    item: str
    row_schema: str
    state_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.row_schema.split(", ")]
        self.whole = [c.split()[1] == "int" for c in self.row_schema.split(", ")]
        self.waiting = handle.getMapState("waiting", "ms long, item int", self.row_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {t for t in self.handle.listTimers()}
        for pdf in rows:
            for ms, item, *values in zip(pdf["ms"], pdf[self.item] if self.item else [0] * len(pdf), *[pdf[c] for c in self.names], strict=True):
                self.waiting.updateValue((int(ms), int(item)), tuple(_plain(v, whole) for v, whole in zip(values, self.whole, strict=True)))
                if int(ms) not in known:
                    known.add(int(ms))
                    self.handle.registerTimer(int(ms))
        return iter(())  # frames come out when they are whole

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], k[1], v) for k, v in ((tuple(k), tuple(v)) for k, v in self.waiting.iterator()) if k[0] <= until)
        found, state = [], self.state.get() if self.state.exists() else None
        for ms in sorted({d[0] for d in due}):
            out, state = self.step(key[0], [dict(zip(self.names, d[2], strict=True)) for d in due if d[0] == ms], state)
            found += out
        for ms, item, _ in due:
            self.waiting.removeKey((ms, item))
        if due:
            self.state.update(tuple(state))
        if found:
            yield pd.DataFrame(found, columns=self.out)

    def step(self, key, rows: list[dict], state) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _plain(v, whole: bool):
    """A value as the state store takes it: Python numbers and lists, None for missing; pandas gives integers with gaps as floats."""
    if isinstance(v, np.ndarray):
        return v.tolist()
    if v is None or (isinstance(v, float) and v != v):
        return None
    return int(v) if whole else float(v)


BOX = "frame int, actor_id int, x1 double, y1 double, x2 double, y2 double, conf double"
TRACKED = ["seq_id", "frame", "actor_id", "global_id"]


class BoxSteps(InOrder):
    """The two-stage box tracker: each track's filter is its mean and covariance."""

    item, out, row_schema = "actor_id", TRACKED, BOX
    state_schema = "next_id int, ids array<int>, seen array<int>, x array<array<double>>, p array<array<double>>"

    def __init__(self, **options):
        self.options = options

    def step(self, key, rows, state):
        tracker = BoxTracker(**self.options)
        if state is not None:
            tracker.next_id, ids, seen, xs, ps = state
            for i, f, x, p in zip(ids, seen, xs, ps, strict=True):
                kalman = BoxFilter([0, 0, 1, 1])
                kalman.x, kalman.p = np.array(x), np.array(p).reshape(8, 8)
                tracker.tracks.append({"id": i, "seen": f, "filter": kalman})
        frame = rows[0]["frame"]
        found = tracker.step(frame, [{"actor_id": r["actor_id"], "box": [r["x1"], r["y1"], r["x2"], r["y2"]], "conf": r["conf"]} for r in rows])
        ts = tracker.tracks
        return [(key, frame, a, g) for a, g in found.items()], (tracker.next_id, [t["id"] for t in ts], [t["seen"] for t in ts], [t["filter"].x.tolist() for t in ts], [t["filter"].p.ravel().tolist() for t in ts])


class FeatureSteps(InOrder):
    """The feature tracker with its anchors; a detection may carry the marker that was seen on it."""

    item, out, row_schema = "actor_id", TRACKED, BOX + ", marker int, feature array<double>"
    state_schema = "next_id int, ids array<int>, seen array<int>, lost array<int>, boxes array<array<double>>, features array<array<double>>, markers array<int>, anchored array<int>"

    def __init__(self, **options):
        self.options = options

    def step(self, key, rows, state):
        tracker = FeatureTracker(**self.options)
        if state is not None:
            tracker.next_id, ids, seen, lost, boxes, features, markers, anchored = state
            for i, f, gone, box, feature in zip(ids, seen, lost, boxes, features, strict=True):
                tracker.tracks[i] = {"id": i, "seen": f, "lost": gone if gone >= 0 else None, "box": list(box), "feature": np.array(feature).reshape(-1, 2) if len(feature) else None}
            tracker.anchors = dict(zip(markers, anchored, strict=True))
        frame = rows[0]["frame"]
        actors = [{"actor_id": r["actor_id"], "box": [r["x1"], r["y1"], r["x2"], r["y2"]], "conf": r["conf"], "feature": None if r["feature"] is None else np.asarray(r["feature"], float).reshape(-1, 2)} for r in rows]
        found = tracker.step(frame, actors, {r["marker"]: r["actor_id"] for r in rows if r["marker"] is not None})
        ts = list(tracker.tracks.values())
        kept = (tracker.next_id, [t["id"] for t in ts], [t["seen"] for t in ts], [-1 if t["lost"] is None else t["lost"] for t in ts], [[float(x) for x in t["box"]] for t in ts], [[] if t["feature"] is None else t["feature"].ravel().tolist() for t in ts], list(tracker.anchors), list(tracker.anchors.values()))
        return [(key, frame, a, g) for a, g in found.items()], kept


class DriftSteps(InOrder):
    """Falls of a metric against the mean of the first frames."""

    item, out, row_schema = "", ["seq_id", "frame", "metric", "drop", "severity"], "frame int, confidence double, completeness double"
    state_schema = "n int, s0 double, s1 double"

    def __init__(self, first: int, limits: tuple[float, float]):
        self.first, self.limits = first, limits

    def step(self, key, rows, state):
        n, s0, s1 = (0, 0.0, 0.0) if state is None else state
        found, r = [], rows[0]
        if n < self.first:
            return [], (n + 1, s0 + r["confidence"], s1 + r["completeness"])
        for name, total, limit in (("confidence", s0, self.limits[0]), ("completeness", s1, self.limits[1])):
            drop = (total / n - r[name]) / (total / n) if total else 0.0
            if drop > limit:
                found.append((key, r["frame"], name, drop, "high" if drop > 2 * limit else "moderate"))
        return found, (n, s0, s1)


def _stepped(rows: DataFrame, steps: InOrder, delay: str, schema: str) -> DataFrame:
    use_state_store(rows.sparkSession)
    timed = rows.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("seq_id").transformWithStateInPandas(statefulProcessor=steps, outputStructType=schema, outputMode="Append", timeMode="EventTime")


IDENTITIES = "seq_id long, frame int, actor_id int, global_id int"


def box_track_stream(dets: DataFrame, delay: str = "1 second", **options) -> DataFrame:
    """(seq_id, frame, actor_id, global_id) of streamed detections (seq_id long, ts, frame, actor_id, x1, y1, x2, y2, conf) by the two-stage box tracker.

    All rows of a frame have one ``ts``. Of two rows of one frame and actor the later counts.
    """
    return _stepped(dets, BoxSteps(**options), delay, IDENTITIES)


def track_stream(dets: DataFrame, delay: str = "1 second", **options) -> DataFrame:
    """As ``box_track_stream`` by the feature tracker, whose rows have a feature (array, may be null) and may have a marker (int)."""
    dets = dets if "marker" in dets.columns else dets.withColumn("marker", F.lit(None).cast("int"))
    return _stepped(dets, FeatureSteps(**options), delay, IDENTITIES)


def drift_stream(metrics: DataFrame, first: int = 30, limits: tuple[float, float] = (0.15, 0.20), delay: str = "1 second") -> DataFrame:
    """Alerts of streamed metrics (seq_id long, ts, frame, confidence, completeness) that fall against the mean of the first frames."""
    return _stepped(metrics, DriftSteps(first, limits), delay, "seq_id long, frame int, metric string, drop double, severity string")
