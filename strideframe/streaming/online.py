"""The One-Euro filter online, for Structured Streaming: state by sequence and joint, frames stepped as they come.

Each micro-batch of a key is sorted by frame before it is stepped. A frame not after the last one stepped is late: it is dropped and
counted in ``late``. State is small arrays, kept by the state store, and expires with processing time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import numeric


def _in_order(pdfs: Iterator[pd.DataFrame], last: int) -> tuple[pd.DataFrame, int]:
    """The rows after frame ``last`` in order, and how many were late."""
    rows = pd.concat(list(pdfs), ignore_index=True).sort_values("frame")
    return rows[rows["frame"] > last], int((rows["frame"] <= last).sum())


def one_euro_stream(points: DataFrame, fps: float = 30.0, min_cutoff: float = 1.0, beta: float = 0.007, z_ratio: float = 1.5, timeout_ms: int = 600_000) -> DataFrame:
    """Points (seq_id long, frame, joint, x, y, z) filtered as they come; equals the batch filter on frames that come in order."""
    cut = np.array([1, 1, z_ratio]) * min_cutoff

    def step(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, x, dx, t, rate = state.get if state.exists else (-1, [np.nan] * 3, [0.0] * 3, [np.nan] * 3, [np.nan] * 3)
        s = {"x": np.array(x), "dx": np.array(dx), "t": np.array(t), "rate": np.array(rate)}
        rows, late = _in_order(pdfs, last)
        if len(rows):
            out = numeric.one_euro(rows[["x", "y", "z"]].to_numpy(float), rows["frame"].to_numpy() / fps, cut, beta, state=s)
            last = int(rows["frame"].max())
            yield pd.DataFrame({"seq_id": key[0], "joint": key[1], "frame": rows["frame"].to_numpy(), **{c: pd.array(np.where(np.isnan(out[:, k]), None, out[:, k]), "Float64") for k, c in enumerate("xyz")}, "late": late})
        state.update((last, *(s[k].tolist() for k in ("x", "dx", "t", "rate"))))
        state.setTimeoutDuration(timeout_ms)

    return points.groupBy("seq_id", "joint").applyInPandasWithState(step, "seq_id long, joint int, frame int, x double, y double, z double, late int", "last int, x array<double>, dx array<double>, t array<double>, rate array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
