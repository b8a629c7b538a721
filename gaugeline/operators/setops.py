"""Tagged rows ↔ typed relations (SET-1, SET-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.schema import COUNTER, GAUGE


def union_kinds(counters: DataFrame, gauges: DataFrame) -> DataFrame:
    """SET-1: typed tables ``(id, value)`` → METRIC rows, counters first in
    the union (row order is not kept by later stages; sinks sort by key)."""
    c = counters.select("id", F.lit(COUNTER).alias("type"), F.col("value").cast("bigint").alias("delta"),
                        F.lit(None).cast("double").alias("value"))
    g = gauges.select("id", F.lit(GAUGE).alias("type"), F.lit(None).cast("bigint").alias("delta"),
                      F.col("value").cast("double").alias("value"))
    return c.unionByName(g)


def split_kinds(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET-2: METRIC rows → ``(gauges, counters)`` typed tables.  Two
    filters over the same input; persist the input first if it is costly
    to recompute."""
    t = F.col("type")
    gauges = state.filter((t == GAUGE) & F.col("value").isNotNull()).select("id", "value")
    counters = state.filter((t == COUNTER) & F.col("delta").isNotNull()).select(
        "id", F.col("delta").alias("value"))
    return gauges, counters
