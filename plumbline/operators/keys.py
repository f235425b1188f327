"""Row numbers over a whole table without gathering it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.scratch import Scratch


def numbered(spark: SparkSession, df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with a dense number in the order of the columns.

    Rows are dealt by range, sorted, and written once with their task and place in it, as the sampled bounds may differ when
    they are dealt again; each task's number of rows, one small row each, gives the tasks' first numbers.
    """
    columns = [F.col(c) for c in order]
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__at", F.monotonically_increasing_id())
    dealt = Scratch(spark, "numbered").keep(dealt, "dealt")
    # The id has the task's number above 33 bits of the row's place in it.
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbers = dealt.withColumn("__part", part).join(F.broadcast(starts), "__part")  # one row a task
    return numbers.withColumn(name, F.col("__before") + place + F.lit(first)).drop("__part", "__before", "__at")


def cyclic(df: DataFrame, ring: list[str], order: str, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``before`` and ``after``: the columns' values in the rows before and after in the ring, whose last row is
    followed by its first. Rings are the unit, so a window holds one ring."""
    whole = Window.partitionBy(*ring).orderBy(order)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Structs, as a value that is null there is not one that is missing.
    step = {"before": (F.lag, F.last), "after": (F.lead, F.first)}
    made = {name: F.coalesce(step[name][0](F.struct(c.alias("v"))).over(whole), step[name][1](F.struct(c.alias("v"))).over(every))["v"] for name, c in columns.items()}
    return df.withColumns(made)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is dealt by key and sorted.

    Rows that were made by explode, or that compress well, look small to the planner: what it takes for a few megabytes was
    gathered by the driver and sent whole to all tasks. Sides that grow with the input are joined this way.
    """
    return df.hint("merge")
