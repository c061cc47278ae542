"""Keyed rows that arrive batch by batch, kept as runs that are merged in steps.

Every batch writes one run.  After FAN runs of a level they are merged into one run of the next level, so a row is written
once per level: what a batch writes follows from its own rows and, evenly spread, the logarithm of the number of batches,
never from the whole history.  A reader merges at most FAN − 1 runs per level.  Runs are named by level and last batch, so
a batch that is replayed writes the same folders again, and a marker that is written last says up to which batch all is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8


class ChangeLog:
    """``merge`` reduces rows of one key to one row, and may be applied again to its own results."""

    def __init__(self, path: str, merge: Callable[[DataFrame], DataFrame], fan: int = FAN):
        self.path, self.merge, self.fan = path, merge, fan

    def _run(self, level: int, last: int) -> str:
        return f"{self.path}/level={level}/upto={last:010d}"

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch; batches are numbered from 0 without gaps."""
        spark = rows.sparkSession
        new = self.merge(rows)
        new.write.mode("overwrite").parquet(self._run(0, batch_id))
        level, size = 1, self.fan
        while (batch_id + 1) % size == 0:
            below = size // self.fan
            parts = [self._run(level - 1, batch_id - i * below) for i in range(self.fan)]
            self.merge(spark.read.schema(new.schema).parquet(*parts)).write.mode("overwrite").parquet(self._run(level, batch_id))
            level, size = level + 1, size * self.fan
        spark.range(1).write.mode("overwrite").parquet(f"{self.path}/complete/batch={batch_id:010d}")

    def runs(self, last: int) -> list[str]:
        """The largest runs that cover the batches 0 to ``last``."""
        out, start, size, level = [], 0, 1, 0
        while size * self.fan <= last + 1:
            size, level = size * self.fan, level + 1
        while level >= 0:
            while start + size <= last + 1:
                start += size
                out.append(self._run(level, start - 1))
            size, level = size // self.fan, level - 1
        return out

    def read(self, spark: SparkSession) -> DataFrame:
        """One row per key after the last complete batch."""
        last = spark.read.parquet(f"{self.path}/complete").agg(F.max("batch")).first()[0]
        return self.merge(spark.read.parquet(*self.runs(last)))
