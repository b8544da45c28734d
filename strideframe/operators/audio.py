"""Synchronising cameras by a sound: short-time energy, peaks a minimum distance apart, offsets against the surest camera."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables


def levels(audio: DataFrame, window: int = 441) -> DataFrame:
    """(cam, win, e, db) of samples (cam, idx, v): mean square of each whole window of samples, the last part left out unless it is all."""
    sizes = audio.groupBy("cam").agg((F.max("idx") + 1).alias("n"))
    win = F.floor(F.col("idx") / window)
    energy = audio.join(sizes, "cam").where((win < F.floor(F.col("n") / window)) | (F.col("n") < window)).groupBy("cam", win.alias("win")).agg(F.avg(F.col("v") * F.col("v")).alias("e"))
    return with_db(energy)


def with_db(energy: DataFrame) -> DataFrame:
    return energy.withColumn("db", 10 * F.log10(F.greatest(F.col("e"), F.lit(1e-10))))


def sync_peaks(level: DataFrame, above: float = 20.0, distance: int = 10, retry: bool = True) -> DataFrame:
    """(cam, win, db, median): local peaks over the camera's median level by ``above`` dB, from the first on at least
    ``distance`` windows apart. With ``retry``, cameras without any are looked at again with half of ``above``.
    """
    spark = level.sparkSession
    near = Window.partitionBy("cam").orderBy("win")
    local = level.withColumns({"a": F.lag("db").over(near), "b": F.lead("db").over(near)}).where((F.col("db") > F.col("a")) & (F.col("db") >= F.col("b")))
    local = local.join(level.groupBy("cam").agg(F.median("db").alias("median")), "cam").withColumn("over", F.col("db") - F.col("median"))
    if retry:  # one threshold for each camera: the lower one where nothing passes the upper
        most = local.groupBy("cam").agg(F.max("over").alias("most"))
        local = local.join(most, "cam").where(F.col("over") > F.when(F.col("most") > above, above).otherwise(above / 2)).drop("most")
    else:
        local = local.where(F.col("over") > above)
    tables.register(spark)
    # Peaks that lie ``distance`` after the one before are kept whatever came before: chains between them are passed over alone.
    chain = F.sum(F.coalesce((F.col("win") - F.lag("win").over(near) >= distance).cast("int"), F.lit(0))).over(near)
    keyed = local.withColumn("chain", F.to_json(F.struct(F.col("cam").alias("c"), chain.alias("k")))).select("chain", "cam", "win", "db", "median")
    kept = tables.peaks(keyed.select("chain", "win", "db").asTable().partitionBy("chain").orderBy("win"), F.lit(distance)).select(F.col("k").alias("chain"), F.col("at").alias("win"))
    return keyed.join(kept, ["chain", "win"], "left_semi").drop("chain")


def sync_pulses(level: DataFrame, above: float = 20.0, distance: int = 10, retry: bool = True) -> DataFrame:
    """(cam, win, e, snr, confidence) of each camera's loudest kept peak (ties: the first)."""
    found = sync_peaks(level, above, distance, retry).groupBy("cam").agg(F.max_by(F.struct("win", "db", "median"), F.struct("db", -F.col("win"))).alias("p")).select("cam", "p.*")
    snr = F.col("db") - F.col("median")
    return found.join(level.select("cam", "win", "e"), ["cam", "win"]).select("cam", "win", F.bround("e", 6).alias("e"), F.bround(snr, 1).alias("snr"), F.bround(F.least(F.greatest(snr / 40, F.lit(0.0)), F.lit(1.0)), 4).alias("confidence"))


def sync_offsets(level: DataFrame, window: int = 441, rate: float = 44100.0, fps: float = 30.0, max_offset_s: float = 5.0, above: float = 20.0, distance: int = 10, retry: bool = True) -> DataFrame:
    """(cam, reference, offset_samples, offset_frames, offset_ms, confidence, max_offset_ms, quality) of every camera.

    Offsets are against the camera of the surest pulse (ties: the first); cameras without a pulse have offset 0 and no
    confidence. Without any pulse the first camera is the reference and the quality is no_pulses_found.
    """
    cams = level.select("cam").distinct()
    pulses = sync_pulses(level, above, distance, retry)
    # One row: cameras are a handful.
    best = pulses.agg(F.min_by(F.struct("cam", "win"), F.struct(-F.col("confidence"), "cam")).alias("r"))
    first = cams.agg(F.min("cam").alias("first"))
    each = cams.join(pulses, "cam", "left").join(F.broadcast(best), how="cross").join(F.broadcast(first), how="cross")
    off = F.coalesce((F.col("win") - F.col("r.win")) * window, F.lit(0)).cast("long")
    rows = each.select("cam", F.coalesce("r.cam", "first").alias("reference"), off.alias("offset_samples"), F.bround(off / (rate / fps)).cast("long").alias("offset_frames"), F.bround(off / rate * 1000, 2).alias("offset_ms"), "confidence", F.col("r").isNull().alias("none"))
    most = rows.agg(F.max(F.abs("offset_ms")).alias("max_offset_ms"))
    m = F.col("max_offset_ms")
    quality = F.when(F.col("none"), "no_pulses_found").when(m < 5 / fps, "excellent").when(m < 20 / fps, "good").when(m < max_offset_s * 1000, "acceptable").otherwise("poor")
    return rows.join(F.broadcast(most), how="cross").withColumn("quality", quality).drop("none")
