"""Pages of long ordered listings without passing over the rows before them.

A listing is sorted once, into folders by key range, with a directory of the rows in each. A page then reads only the
folders that hold its rows, however deep it lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from folioscope.sources.storage import materialise

_PART = "_part"


class Listing:
    """``rows`` in the order of the columns ``order``, null first; ``parts`` key ranges, by default the shuffle partitions.

    ``order`` should be a key, so that ranges are even and pages are the same each time; rows equal in it stay together, in any
    order. The directory has one entry a range. An empty table has empty pages.
    """

    def __init__(self, rows: DataFrame, order: Sequence[str], parts: int | None = None):
        self.order, self.columns = list(order), rows.columns
        ranged = rows.repartitionByRange(*([parts] if parts else []), *self.order).withColumn(_PART, F.spark_partition_id())
        # the number is stored with the row: ranges are drawn from a sample and could differ in another run
        self.rows = materialise(ranged.sortWithinPartitions(*self.order), "listing", by=_PART)
        counted = self.rows.groupBy(_PART).count().orderBy(_PART).collect()
        ends = list(accumulate(r["count"] for r in counted))
        self.directory = [(r[_PART], end - r["count"], end) for r, end in zip(counted, ends)]

    def __len__(self) -> int:
        return self.directory[-1][2] if self.directory else 0

    def page(self, skip: int, limit: int) -> DataFrame:
        """At most ``limit`` rows after the first ``skip``, in order."""
        held = [(part, start) for part, start, end in self.directory if start < skip + limit and end > skip]
        first = held[0][1] if held else 0
        near = self.rows.where(F.col(_PART).isin([part for part, _ in held]))
        return near.orderBy(*self.order).offset(skip - first if held else 0).limit(limit).select(*self.columns)
