"""Running sums and row numbers over ordered groups of any size, without a window that holds a group.

Rows are dealt by ranges of (group, order), so a group that holds most rows is spread over many tasks, and written once, sorted,
with each row's number within its part. Spark numbers rows part by part, so the totals of a group's parts, one row for each part
that has some of it, give what stands before each part; a window runs over these totals only, and over a part's own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.session import free_name, saved

#: monotonically_increasing_id() has the partition above these bits and the row's number in it below.
ROW_BITS = 33


def _dealt(df: DataFrame, group: list[str], order: list[Column], label: str) -> tuple[DataFrame, str]:
    """df dealt by ranges, sorted and written, with a column that numbers the rows of each part in order."""
    at, spread = free_name(df, "at"), free_name(df, "spread")
    keys = [F.col(f"`{g}`").asc_nulls_first() for g in group] + list(order)
    # rows that are equal in all keys may be the most of a group; what stood where before parts them
    spaced = df.withColumn(spread, F.monotonically_increasing_id())
    ranged = spaced.repartitionByRange(*keys, F.col(spread)).sortWithinPartitions(*keys, F.col(spread)).drop(spread)
    return saved(ranged.withColumn(at, F.monotonically_increasing_id()), label), at


def numbered(df: DataFrame, group: list[str], order: list[Column], into: str = "pos", size: str | None = None) -> DataFrame:
    """df with `into`: each row's place in its group, from 0 on; size: a column for the group's number of rows.

    order are sort expressions such as F.col("x").asc_nulls_first(). Rows equal in all of them get different places, in any
    order; a null in a group column is a group of its own. No rows: no rows.
    """
    dealt, at = _dealt(df, group, order, "numbered")
    part = F.shiftright(at, ROW_BITS)
    totals = dealt.groupBy(part.alias("_part"), *[F.col(f"`{g}`").alias(f"_g{k}") for k, g in enumerate(group)]).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    mine = [f"_g{k}" for k in range(len(group))]
    # as many rows as parts that have some of the group; without a group one row for each part
    along = Window.partitionBy(*mine).orderBy("_part") if mine else Window.partitionBy(F.lit(0)).orderBy("_part")
    every = Window.partitionBy(*mine) if mine else Window.partitionBy(F.lit(0))
    totals = totals.select("_part", *mine, (F.sum("_n").over(along) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(every).alias("_size"))
    on = part == F.col("_part")
    for k, g in enumerate(group):
        on = on & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{k}"))
    extra = [F.col("_size").alias(size)] if size else []
    return dealt.join(totals, on).select(*[F.col(f"`{c}`") for c in df.columns], (F.col(at) + F.col("_shift")).alias(into), *extra)


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums: sums names, for each column of numbers, the column for its sum over the rows up to and with each row.

    Rows that tie in `order` are added one after another, in any order; group by the order first where ties must stay together.
    Nulls add nothing. Group columns as in numbered().
    """
    dealt, at = _dealt(df, group, order, "running")
    part, mine = F.shiftright(at, ROW_BITS), [f"_g{k}" for k in range(len(group))]
    totals = dealt.groupBy(part.alias("_part"), *[F.col(f"`{g}`").alias(m) for g, m in zip(group, mine, strict=True)]).agg(*[F.sum(f"`{c}`").alias(f"_s{k}") for k, c in enumerate(sums)])
    before = Window.partitionBy(*(mine or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *mine, *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    own = F.struct(F.shiftright(at, ROW_BITS).alias("p"), *[F.col(f"`{g}`") for g in group])
    inside = Window.partitionBy(own).orderBy(at)  # a part's rows, in the memory that sorting them took
    within = dealt.withColumns({f"_w{k}": F.coalesce(F.sum(f"`{c}`").over(inside), F.lit(0)) for k, c in enumerate(sums)})
    on = part == F.col("_part")
    for g, m in zip(group, mine, strict=True):
        on = on & F.col(f"`{g}`").eqNullSafe(F.col(m))
    return within.join(totals, on).select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_w{k}") + F.col(f"_b{k}")).alias(out) for k, out in enumerate(sums.values())])


def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns that may be null, which then match; right's own copies of them go. They can come from one frame."""
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`_on_{c}`"))
    return left.join(right, same).drop(*[f"_on_{c}" for c in on])
