"""Exact percentiles of groups of any size, by rounds of histogram refinement.

A double's bits, made to sort as unsigned numbers do, are a path of four digits. A round counts rows by the next digit, only
in the bins that hold a wanted rank, for all groups at once, and the ranks go on into one bin each. A rank is found when its bin
has one value. So no group is sorted or held: rows combine to counts before the shuffle, and a bin has 65,536 next ones at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracemark.scratch import materialise

DIGIT = 16


@F.arrow_udf(LongType())
def ordered_bits(values: pa.Array) -> pa.Array:
    """64 bits that sort, as unsigned numbers, as the doubles do; NaN comes last."""
    bits = (values.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)  # adding 0 makes one zero of the two
    return pa.array(np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))))


def percentiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """One row for each group of rows by keys (nulls are a group): a column for each share, with linear interpolation between the
    two rows next to it. Null values are left out; a group of nothing else has no row. Without keys, all rows are one group.
    Runs jobs when called: four rounds at most, over a narrow copy of the values.
    """
    names = {k: f"_key{i}" for i, k in enumerate(keys)} or {"": "_key0"}
    group = list(names.values())
    held = rows.select(*[(F.col(k) if k else F.lit(0)).alias(n) for k, n in names.items()], value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    held = materialise(held.withColumn("_bits", ordered_bits("_v")), "values")
    sizes = held.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    at = [F.lit(p) * (F.col("_n") - 1) for p in shares.values()]
    ranks = F.array_distinct(F.array(*[side(a).cast("long") for a in at for side in (F.floor, F.ceil)]))
    wanted = materialise(sizes.select(*group, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_path"), F.lit(0).cast("long").alias("_below")), "ranks")
    found = []
    for depth in range(0, 64, DIGIT):
        step = materialise(_refined(held, wanted, group, depth), "ranks")
        found.append(step.filter("_least <=> _most").select(*group, "_rank", F.col("_least").alias("_value")))
        wanted = step.filter("not _least <=> _most").drop("_least", "_most")
        if wanted.isEmpty():
            break
    per_group = reduce(DataFrame.unionByName, found).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    joined = sizes.alias("s").join(per_group.alias("p"), _same(group)("s", "p")).select("s.*", "p._at")

    def between(a: Column) -> Column:
        low, high = F.col("_at")[F.floor(a).cast("long")], F.col("_at")[F.ceil(a).cast("long")]
        return F.when(low.eqNullSafe(high), low).otherwise(low + (high - low) * (a - F.floor(a)))
    return joined.select(*[F.col(n).alias(k) for k, n in names.items() if k], *[between(a).alias(c) for c, a in zip(shares, at, strict=True)])


def _same(columns: list[str]) -> Callable[[str, str], Column]:
    return lambda x, y: reduce(Column.__and__, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in columns])


def _refined(held: DataFrame, wanted: DataFrame, group: list[str], depth: int) -> DataFrame:
    """Wanted ranks (group, _rank, _path, _below) with paths longer by a digit, and the least and greatest value of their bins."""
    path = F.shiftrightunsigned("_bits", 64 - depth) if depth else F.lit(0).cast("long")
    digit = F.shiftrightunsigned("_bits", 64 - DIGIT - depth).bitwiseAND((1 << DIGIT) - 1)
    bins = wanted.groupBy(*group, "_path").agg(F.first("_below").alias("_below"))
    rows = held.withColumn("_path", path).alias("r").join(bins.alias("b"), _same([*group, "_path"])("r", "b")).select("r.*", "b._below")
    counts = rows.groupBy(*group, "_path", "_below", digit.alias("_digit")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    before = Window.partitionBy(*group, "_path").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = (F.col("w._rank") >= F.col("c._start")) & (F.col("w._rank") < F.col("c._start") + F.col("c._n"))
    met = wanted.alias("w").join(counts.alias("c"), _same([*group, "_path"])("w", "c") & inside)
    longer = F.shiftleft("w._path", DIGIT).bitwiseOR(F.col("c._digit"))
    return met.select(*[F.col(f"w.{g}") for g in group], "w._rank", longer.alias("_path"), F.col("c._start").alias("_below"), "c._least", "c._most")
