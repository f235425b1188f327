"""Counts of what a pass reads, makes and skips, taken while it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Counters:
    """Aggregates that ride along with tables on their way to an action; nothing is read a second time.

    Each watched table must be run by exactly one action (a write, say) before the values are asked for.
    """

    def __init__(self) -> None:
        self._watched: list[Observation] = []

    def watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df`` with these aggregates taken on the way."""
        seen = Observation()
        self._watched.append(seen)
        return df.observe(seen, *[c.alias(name) for name, c in counts.items()])

    def values(self) -> dict[str, int]:
        """All counts so far by name; waits for the actions."""
        return {k: v for o in self._watched for k, v in o.get.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(counter, value), one row a counter."""
        return spark.createDataFrame(sorted(self.values().items()), "counter string, value long")
