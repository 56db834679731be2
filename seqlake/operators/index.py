"""Dense global row positions without an unpartitioned window.

The input is written once (so it is run once, however costly or nested it is), dealt out by key
range, sorted within each range and written again with the number of its range and its place there.
Only the row counts of the ranges, at most ``MAX_RANGES`` numbers, pass through the driver; they give
each range its offset. The result is read from the written table, so positions stay as they are
when a reader's executors are lost. The order key must be unique (add the row key as the last
tie-breaker). Nulls come first.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.session import release, settle

ROWS_PER_RANGE = 200_000   # target size of a range
MAX_RANGES = 10_000        # beyond, ranges grow instead
PLACE_BITS = 33            # monotonically_increasing_id: partition above, place within it below


def row_index(df: DataFrame, order: list[str], name: str = "pos", rows_per_range: int = ROWS_PER_RANGE, cheap: bool = False) -> DataFrame:
    """``cheap``: the input is a scan with expressions, the same on every run, so it is run again instead of written first."""
    if not all(isinstance(c, str) for c in order):
        raise TypeError("row_index takes column names (ascending order)")
    rows = df if cheap else settle(df)
    ranges = min(MAX_RANGES, max(1, math.ceil(rows.count() / rows_per_range)))
    place = F.monotonically_increasing_id()
    dealt = settle(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        "*", F.shiftright(place, PLACE_BITS).cast("int").alias("_range"),
        place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place")))
    release(rows)
    offset, offsets = 0, []
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():    # at most MAX_RANGES rows
        offsets.append((r["_range"], offset))
        offset += r["count"]
    table = df.sparkSession.createDataFrame(offsets, "_range int, _offset bigint")
    return (dealt.join(F.broadcast(table), "_range")
            .withColumn(name, F.col("_offset") + F.col("_place")).drop("_range", "_offset", "_place"))
