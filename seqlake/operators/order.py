"""Exact order statistics of groups by radix selection: no group's values are ever sorted or buffered.

Values become 64-bit keys of the same order. Four passes count, for every group, the keys that
share the digits found so far by their next 16 bits (partial counts per task, at most 65,536 sums
a group), and pick the digit in which the asked rank lies. All groups and ranks go together.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.session import release, settle

DIGIT_BITS, DIGITS = 16, 4


@F.pandas_udf(T.LongType())
def ordered_key(value: pd.Series) -> pd.Series:
    """Doubles as integers of the same order; -0.0 is 0.0."""
    bits = (value.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(2 ** 63 - 1), bits))     # of negative numbers the magnitude bits turn round


@F.pandas_udf(T.DoubleType())
def value_of(key: pd.Series) -> pd.Series:
    """The double of an ordered key."""
    k = key.to_numpy(dtype=np.int64)
    return pd.Series(np.where(k < 0, k ^ np.int64(2 ** 63 - 1), k).view(np.float64))


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)], F.lit(True))


def order_statistics(df: DataFrame, by: list[str], value: Column, ranks: dict[str, Column]) -> DataFrame:
    """(by..., n, one double per name of ``ranks``): the values of these 0-based ranks (expressions of the column ``n``, the number of
    values of the group). Null and NaN values do not count; a group without values has no row."""
    keyed = settle(df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], value.cast("double").alias("v"))
                   .where(F.col("v").isNotNull() & ~F.isnan("v")).select(*[f"g{i}" for i in range(len(by))], ordered_key("v").alias("key")))
    groups, state_groups = [f"g{i}" for i in range(len(by))], [f"s{i}" for i in range(len(by))]
    sizes = keyed.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()]))
    state = (sizes.select(*groups, "n", named.alias("r")).select(*[F.col(g).alias(s) for g, s in zip(groups, state_groups)], "n",
             F.col("r.name").alias("name"), F.col("r.rank").alias("rank"), F.lit(None).cast("bigint").alias("prefix")))
    before = None
    for p in range(DIGITS):
        state = settle(state)
        release(*[t for t in (before,) if t is not None])
        before = state
        shift = DIGIT_BITS * (DIGITS - 1 - p)
        rows = keyed if p == 0 else keyed.withColumn("high", F.shiftright("key", shift + DIGIT_BITS))
        asked = state.select(*state_groups, "prefix").distinct()
        on = _same(groups, state_groups)
        on = on if p == 0 else on & (F.col("high") == F.col("prefix"))
        # the first digit carries the sign, so it is taken as it is; the others are 0 .. 65535
        digit = F.shiftright("key", shift) if p == 0 else F.shiftright("key", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        counts = rows.join(asked, on).groupBy(*state_groups, "prefix", digit.alias("digit")).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*state_groups, "prefix").orderBy("digit"))
        counts = counts.withColumn("upto", upto).toDF(*groups, "q", "digit", "c", "upto")
        on = _same(state_groups, groups) & F.col("prefix").eqNullSafe(F.col("q"))
        hit = state.join(counts, on).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        longer = F.col("digit") if p == 0 else F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("digit"))
        state = hit.select(*state_groups, "n", "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), longer.alias("prefix"))
    found = settle(state.select(*state_groups, "n", "name", value_of("prefix").alias("v")))
    release(keyed, before)
    out = found.groupBy(*state_groups, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return out.toDF(*by, "n", *ranks)
