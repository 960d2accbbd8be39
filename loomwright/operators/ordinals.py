"""Running sums and row numbers over a whole table, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage


def running_sums(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column | str]) -> DataFrame:
    """df with {name: sum of the column over the rows before}, in an order that should be total.

    Rows are dealt out by ranges of the order; sums run inside each range, and the totals of the ranges, one
    row a partition, are added up separately.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = stage(dealt.withColumn("_part", F.shiftright("_at", 33)), "ranges")  # numbers are fixed from here on
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    values = {name: F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
    totals = held.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    above = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_a_{n}") for n in values])
    local = held.withColumns({f"_s_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    out = local.join(F.broadcast(above), "_part")
    return out.withColumns({n: F.col(f"_s_{n}") + F.col(f"_a_{n}") for n in values}).select(*df.columns, *values)


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "ordinal") -> DataFrame:
    """df with the row's number from 0, in an order that should be total."""
    return running_sums(df, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("long"))


def number_in_groups(df: DataFrame, group: str, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """df with the row's number from 0 in its group, and the group's size; groups may be as large as the table."""
    numbered = stage(number_rows(df, [group, *order], "_n"), "numbered")
    starts = numbered.groupBy(group).agg(F.min("_n").alias("_start"), F.count("*").alias(f"{name}_size"))
    out = numbered.join(starts, numbered[group].eqNullSafe(starts[group])).drop(starts[group])
    return out.withColumn(name, F.col("_n") - F.col("_start")).drop("_n", "_start")
