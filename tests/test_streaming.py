import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import quality, track
from strideframe.streaming import tracking

BOXES = "seq_id long, ts timestamp, frame int, actor_id int, x1 double, y1 double, x2 double, y2 double, conf double, feature array<double>, marker int"
START = datetime.datetime(2024, 1, 1)


def at(frame):
    return START + datetime.timedelta(seconds=frame)


def walkers(frames=24, seqs=2):
    """Two or three people walking, one away for some frames, one faint for some; detections change places."""
    rnd = random.Random(1)
    rows = []
    for s in range(seqs):
        for f in range(frames):
            there = [k for k in range(3) if not (k == 1 and 8 <= f < 12) and not (k == 2 and f < 5)]
            places = rnd.sample(range(len(there)), len(there))
            for k, place in zip(there, places):
                x, y = 10.0 + 2 * f + 150 * k, 20.0 * k + s
                feature = [0.1 * k, 0.2, 0.3 + 0.1 * k, 0.4] if (f + k) % 5 else None
                rows.append((s, at(f), f, place, x, y, x + 60, y + 90, 0.3 if k == 0 and f % 6 == 3 else 0.9, feature, 70 + k if k == 2 and f % 4 == 0 else None))
    return rows


def streamed(spark, tmp_path, schema, parts, make, name):
    """The rows that ``make`` gives over files read one by one, and the last progress reports."""
    folder = tmp_path / name
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if not hasattr(streamed, "seen") or f not in streamed.seen:
                os.utime(f, (1_700_000_000 + 10 * k,) * 2)
                streamed.seen = getattr(streamed, "seen", set()) | {f}
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make(src).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240), q.lastProgress
    return spark.table(name), q.recentProgress


def key(df):
    return sorted((r.seq_id, r.frame, r.actor_id, r.global_id) for r in df.collect() if r.seq_id >= 0)


END = (-1, at(10_000), 10_000, 0, 0.0, 0.0, 1.0, 1.0, 0.9, None, None)


@pytest.mark.parametrize("method", ["box", "feature"])
def test_split_frames_and_late_rows(spark, tmp_path, method):
    rows = walkers()
    rnd = random.Random(3)
    parts = [[] for _ in range(5)]
    for r in rows:  # a frame's rows may come a file late, which its delay allows
        parts[min(4, max(0, r[2] // 5 + (r[2] % 5 == 4 and rnd.random() < 0.5)))].append(r)
    for p in parts:
        rnd.shuffle(p)
    assert any({r[2] for r in a} & {r[2] for r in b} for a, b in zip(parts, parts[1:]))
    late = [(0, at(0), 0, 9, 0.0, 0.0, 50.0, 50.0, 0.9, None, None), (1, at(1), 1, 9, 0.0, 0.0, 50.0, 50.0, 0.9, None, None)]
    parts[4] += late
    stream = tracking.box_track_stream if method == "box" else tracking.track_stream
    got, progress = streamed(spark, tmp_path, BOXES, [*parts, [END]], lambda src: stream(src, "6 seconds"), f"ids_{method}")
    dets = spark.createDataFrame(rows, BOXES).drop("ts")
    assert key(got) == key(track.track(dets, method)) and len(key(got)) == len(rows)
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == len(late)


def test_state_does_not_grow(spark):
    """Tracks that can't be found again are dropped, and ids go on."""
    box, feature = track.BoxTracker(max_age=5), track.FeatureTracker(search_window=5)
    for f in range(200):
        actor = {"actor_id": 0, "box": [300.0 * f, 0, 300.0 * f + 9, 9], "conf": 0.9, "feature": None}
        box.step(f, [actor])
        feature.step(f, [actor], {4: 0} if f == 2 else None)
    assert len(box.tracks) <= 7 and box.next_id == 200
    assert len(feature.tracks) <= 9 and feature.next_id == 200 and 2 in feature.tracks  # the anchored one stays


def test_drift_on_event_time(spark, tmp_path):
    schema = "seq_id long, ts timestamp, frame int, confidence double, completeness double"
    rows = [(s, at(f), f, 0.9 if f < 5 + s else 0.5, 1.0) for s in range(2) for f in range(12)]
    parts = [[r for r in rows if r[2] in fs] for fs in ((1, 3, 0, 2), (4, 7, 5), (6, 9, 8), (10, 11))]
    end = (-1, at(9999), 9999, 1.0, 1.0)
    got, _ = streamed(spark, tmp_path, schema, [*parts, [end]], lambda src: tracking.drift_stream(src, first=5, delay="4 seconds"), "drift")
    batch = quality.drift_alerts(spark.createDataFrame(rows, schema).drop("ts"), first=5)
    rounded = lambda df: sorted((r.seq_id, r.frame, r.metric, round(r["drop"], 9), r.severity) for r in df.collect())
    assert rounded(got) == rounded(batch) and len(rounded(batch)) > 8


def test_anchored_identities_in_batch(spark):
    rows = walkers(12, 1)
    got = track.track(spark.createDataFrame(rows, BOXES).drop("ts"), "feature")
    marked = got.join(spark.createDataFrame(rows, BOXES).where("marker is not null").select("seq_id", "frame", "actor_id", "marker"), ["seq_id", "frame", "actor_id"])
    assert marked.groupBy("marker").agg(F.countDistinct("global_id").alias("k")).first().k == 1
    assert np.isfinite(got.count())
