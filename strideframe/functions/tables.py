"""Table functions for SQL: ordered passes over the partitions of a table argument.

After ``register(spark)``:

    select * from peaks(table(select cam, win, db from levels) partition by cam order by (win), 10)
    select * from islands(table(select seq_id, frame from missing) partition by seq_id order by (frame), 1)

A function sees the rows of one partition in order, one after the other, and keeps a few numbers only, so a partition may
be of any length.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="k string, at long, value double")
class peaks:
    """Rows (key, place, value) that lie at least ``distance`` places after the last one kept: the first of them is kept."""

    def __init__(self):
        self.last = None

    def eval(self, row: Row, distance: int):
        key, at, value = row[0], row[1], row[2]
        if at is not None and (self.last is None or at - self.last >= distance):
            self.last = at
            yield None if key is None else str(key), int(at), None if value is None else float(value)


@udtf(returnType="k string, start long, stop long, size long")
class islands:
    """Runs of places (key, place) with no more than ``gap`` from one to the next: first place, last place, rows."""

    def __init__(self):
        self.key, self.start, self.stop, self.size = None, None, None, 0

    def eval(self, row: Row, gap: int):
        key, at = row[0], row[1]
        if at is None:
            return
        if self.start is not None and at - self.stop > gap:
            yield self._run()
            self.start = None
        if self.start is None:
            self.key, self.start, self.size = None if key is None else str(key), int(at), 0
        self.stop, self.size = int(at), self.size + 1

    def terminate(self):
        if self.start is not None:
            yield self._run()

    def _run(self):
        return self.key, self.start, self.stop, self.size


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for f in (peaks, islands):
        spark.udtf.register(f._name, f)
