"""Relational recipes over ordered frames that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: list[str], order: str = "frame"):
    return Window.partitionBy(*keys).orderBy(order)


def neighbours(df: DataFrame, keys: list[str], value: str = "v", order: str = "frame") -> DataFrame:
    """Adds prev_v, prev_f, next_v, next_f: the nearest samples at or before, and at or after, each frame.

    The later side runs in descending order, so that both are running windows.
    """
    up = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    return df.withColumns({"prev_v": last(F.col(value), up), "prev_f": last(at, up), "next_v": last(F.col(value), down), "next_f": last(at, down)})


def islands(df: DataFrame, keys: list[str], flag: Column, order: str = "frame") -> DataFrame:
    """Runs of consecutive frames where ``flag`` holds: keys, start, end, length."""
    rows = df.where(flag).withColumn("__g", F.col(order) - F.row_number().over(by(keys, order)))
    runs = rows.groupBy(*keys, "__g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).cast("int").alias("length"))
    return runs.drop("__g")


def median(c) -> Column:
    return F.percentile(c, F.lit(0.5))


def corr(a: str, b: str) -> Column:
    """The correlation of two columns; null where one of them does not vary."""
    spread = lambda x, y: F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x)))
    return F.try_divide(F.covar_pop(a, b), spread(a, b) * spread(b, a))


def unpivot(points: DataFrame) -> DataFrame:
    """(seq_id, joint, dim, frame, v) from points."""
    return points.select("seq_id", "joint", "frame", F.expr("stack(3, 0, x, 1, y, 2, z) as (dim, v)"))


def moves(points: DataFrame) -> DataFrame:
    """Points with px, py, pz of the frame before (null if that frame or point is missing) and the step's length."""
    w = by(["seq_id", "joint"])
    before = lambda c: F.when(F.lag("frame").over(w) == F.col("frame") - 1, F.lag(c).over(w))
    return points.withColumns({f"p{c}": before(c) for c in "xyz"}).withColumn("step", F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) + F.pow(F.col("z") - F.col("pz"), 2)))
