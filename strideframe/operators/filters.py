"""Smoothers that run along a channel in order: grouped Arrow functions, one group for each joint of a sequence."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import numeric

#: Per segment of the 553-point layout: cutoff and beta factors, and whether the zero-phase filter follows.
SEGMENT_PARAMETERS = {"body": (1.0, 1.0, True), "right_hand": (1.5, 1.2, False), "left_hand": (1.5, 1.2, False), "face": (2.0, 0.5, False)}


def per_joint(points: DataFrame, f: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Replaces each joint's (frames x 3) array by ``f(joint, frames, array)``; missing is NaN inside, null outside."""
    seq = points.schema["seq_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        out = f(int(key[1]), pdf["frame"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(float))
        return pd.DataFrame({"seq_id": pdf["seq_id"], "frame": pdf["frame"], "joint": pdf["joint"], **{c: pd.Series(out[:, k], index=pdf.index).astype("Float64").mask(np.isnan(out[:, k])) for k, c in enumerate("xyz")}})

    return points.select("seq_id", "frame", "joint", "x", "y", "z").groupBy("seq_id", "joint").applyInPandas(run, f"seq_id {seq}, frame int, joint int, x double, y double, z double")


def one_euro(points: DataFrame, fps: float = 30.0, min_cutoff: float = 1.0, beta: float = 0.007, z_ratio: float = 1.5) -> DataFrame:
    cut = np.array([1, 1, z_ratio]) * min_cutoff
    return per_joint(points, lambda _, frames, v: numeric.one_euro(v, frames / fps, cut, beta))


def butterworth(points: DataFrame, fps: float = 30.0, cutoff: float = 6.0, order: int = 2) -> DataFrame:
    return per_joint(points, lambda _, __, v: numeric.butter_smooth(v, fps, cutoff, order))


def smooth(points: DataFrame, fps: float = 30.0, min_cutoff: float = 1.0, beta: float = 0.007, z_ratio: float = 1.5, cutoff: float = 6.0, order: int = 2) -> DataFrame:
    """One-Euro with each segment's parameters, then the zero-phase filter on the body, in one pass over each joint."""
    from ..layouts import SEGMENTS_553

    def run(joint, frames, v):
        segment = next((s for s, (a, e) in SEGMENTS_553.items() if a <= joint < e), "body")
        c, b, zero_phase = SEGMENT_PARAMETERS[segment]
        out = numeric.one_euro(v, frames / fps, np.array([1, 1, z_ratio]) * min_cutoff * c, beta * b)
        return numeric.butter_smooth(out, fps, cutoff, order) if zero_phase else out

    return per_joint(points, run)


def rts(points: DataFrame, fps: float = 30.0, q: float = 1.0, r: float = 10.0) -> DataFrame:
    return per_joint(points, lambda _, __, v: numeric.rts(v, fps, q, r))


def fill_cubic(points: DataFrame, max_gap: int = 30) -> DataFrame:
    return per_joint(points, lambda _, __, v: np.stack([numeric.fill_cubic(v[:, k], max_gap) for k in range(3)], 1))
