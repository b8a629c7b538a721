"""Listing report (SNK-2): a heading per kind, then ``name: value`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.text import format_metric_value
from gaugeline.schema import COUNTER, GAUGE

# The two headings of the listing (HTML tags dropped).
HEADINGS = {GAUGE: "Gauges", COUNTER: "Counters"}


def listing_lines(state: DataFrame) -> DataFrame:
    """``(section, id, line)``: heading rows (``id`` null) and metric lines.
    ``section`` 0 is gauges, 1 counters; sort by ``section, id`` to print."""
    spark = state.sparkSession
    section = F.when(F.col("type") == GAUGE, F.lit(0)).otherwise(F.lit(1))
    lines = state.filter(F.col("type").isin(GAUGE, COUNTER)).select(
        section.alias("section"), "id",
        F.concat(F.col("id"), F.lit(": "), format_metric_value("type", "delta", "value")).alias("line"))
    heads = spark.createDataFrame([(0, None, HEADINGS[GAUGE]), (1, None, HEADINGS[COUNTER])],
                                  "section int, id string, line string")
    return heads.unionByName(lines)


def write_listing(state: DataFrame, path: str) -> None:
    """Text file(s) of the listing in print order (a global sort by
    ``section, id``: range-partitioned, so it scales)."""
    listing_lines(state).orderBy("section", F.col("id").asc_nulls_first()).select("line") \
        .write.mode("overwrite").text(path)
