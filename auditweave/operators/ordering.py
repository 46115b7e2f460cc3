"""Running sums, dense positions and exact quantiles that no hot key can stall.

A plain window sorts a whole group in one task. Here the rows are range
partitioned on (group, order), so one group may span many partitions; each
partition sums its own rows and a table with at most one row per partition
carries the totals forward.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.session import durable

_PART = "__part"
_CARRY = "__carry"


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    amount: Column,
    name: str,
) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over earlier rows of the same group.

    ``order`` must be unique within a group and both must be non-NULL. The range
    bounds come from a sample, so the partition ids are fixed by a durable write
    before they are used twice.
    """
    zero = F.lit(0)
    return _running(df, group, order, amount, name, F.sum, lambda own, carry: F.coalesce(own, zero) + F.coalesce(carry, zero))


def running_max(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the largest ``value`` of earlier rows of the same group, NULL where there is none."""
    return _running(df, group, order, value, name, F.max, F.greatest)


def _running(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: Column, name: str,
             total: Callable[[str], Column], joined: Callable[[Column, Column], Column]) -> DataFrame:
    group, order = list(group), list(order)
    # Range partitioning reads its input twice, for the bounds and for the rows.
    written = durable(df.withColumn("__amount", amount))
    ranged = written.repartitionByRange(*group, *order)
    ranged = durable(ranged.withColumn(_PART, F.spark_partition_id()))

    local = Window.partitionBy(_PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(_PART, *group).agg(total("__amount").alias("__total"))
    # One group crosses any partition border, so few rows have a predecessor.
    chain = Window.partitionBy(*(group or [F.lit(0)])).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn(_CARRY, total("__total").over(chain))
        .where(F.col(_CARRY).isNotNull())
        .drop("__total")
    )
    return (
        ranged.withColumn(name, total("__amount").over(local))
        .join(F.broadcast(carry), [_PART, *group], "left")
        .withColumn(name, joined(F.col(name), F.col(_CARRY)))
        .drop(_PART, _CARRY, "__amount")
    )


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Dense 1-based position of each row in its group."""
    counted = running_total(df, group, order, F.lit(1).cast("bigint"), name)
    return counted.withColumn(name, F.col(name) + 1)


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float], prefix: str = "q", weight: str | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group, one row per group.

    Equal values are counted before the sort, so a value held by a third of the
    rows costs one row. ``weight`` names a column of whole numbers: a row then
    stands for so many.
    """
    asked = list(group)
    group = asked or ["__all"]
    if not asked:
        df = df.withColumn("__all", F.lit(1))
    counts = durable(df.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n")))
    ranked = running_total(counts, group, [value], F.col("__n"), "__before")
    sizes = counts.groupBy(*group).agg(F.sum("__n").alias("__size"))
    ranked = ranked.join(sizes, group)
    picks = []
    for p in probabilities:
        target = F.lit(float(p)) * (F.col("__size") - 1)
        for rank in (F.floor(target), F.ceil(target)):
            held = (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
            picks.append(F.max(F.when(held, F.col(value))).alias(f"__v{len(picks)}"))
    picked = ranked.groupBy(*group).agg(F.max("__size").alias("__size"), *picks)
    out = [F.col(g) for g in asked]
    for i, p in enumerate(probabilities):
        target = F.lit(float(p)) * (F.col("__size") - 1)
        low, high = F.col(f"__v{2 * i}"), F.col(f"__v{2 * i + 1}")
        out.append((low + (high - low) * (target - F.floor(target))).alias(f"{prefix}{int(round(p * 100))}"))
    return picked.select(*out)


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows of each group, ranked.

    Rows are first cut to ``limit`` within hashed slices of the group, so the
    final window sees at most ``limit`` rows per slice. Spark also keeps a
    per-task group limit in front of each shuffle.
    """
    slices = 64
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)))
    inner = Window.partitionBy(*group, "__slice").orderBy(*order)
    kept = sliced.withColumn("__r", F.row_number().over(inner)).where(F.col("__r") <= limit)
    outer = Window.partitionBy(*group).orderBy(*order)
    ranked = kept.withColumn(name, F.row_number().over(outer).cast("bigint"))
    return ranked.where(F.col(name) <= limit).drop("__slice", "__r")
