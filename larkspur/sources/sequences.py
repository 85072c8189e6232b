"""Sequences: numbers for one caller at the driver, or for all rows of a DataFrame at once."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Sequence:
    start: int = 1
    increment: int = 1
    _last: int | None = None
    _next: int | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def nextval(self, n: int = 1) -> int:
        """The first of the next n numbers."""
        with self._lock:
            first = self.start if self._next is None else self._next
            self._last, self._next = first + (n - 1) * self.increment, first + n * self.increment
            return first

    def currval(self) -> int:
        if self._last is None:
            raise ValueError("currval of a sequence that wasn't used yet")
        return self._last

    def setval(self, n: int, is_called: bool = True) -> int:
        """The next number is the one after n, or n itself if it wasn't called."""
        with self._lock:
            self._last, self._next = n, n + self.increment if is_called else n
            return n


def number_rows(df: DataFrame, name: str, sequence: Sequence, order: list[str]) -> DataFrame:
    """df with the sequence's next numbers in the given order, which should be total.

    Rows are dealt by ranges of the order and numbered within each part; only a count for each part is summed up.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from ..operators.checkpoints import cut

    dealt = cut(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count"))
    total = dealt.count()
    first = sequence.nextval(total) if total else 0
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    numbered = dealt.withColumn("__place", place).join(F.broadcast(counts.drop("count")), "__part")
    value = F.lit(first) + (F.col("__before") + F.col("__place")) * F.lit(sequence.increment)
    return numbered.withColumn(name, value.cast(T.LongType())).drop("__part", "__place", "__before")
