"""Snapshot writes (SNK-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.schema import COUNTER
from gaugeline.sources.state import current_version, publish_version


def _nonfinite() -> F.Column:
    return F.coalesce(F.isnan("value") | F.col("value").isin(float("inf"), float("-inf")), F.lit(False))


def _snapshot_rows(state: DataFrame, nonfinite: str) -> DataFrame:
    rows = state.select("id", "type", "delta", "value")
    if nonfinite == "error":
        rows = rows.withColumn("value", F.when(_nonfinite(), F.raise_error(
            F.concat(F.lit("non-finite gauge in snapshot: "), F.col("id")))).otherwise(F.col("value")))
    elif nonfinite == "reject":
        rows = rows.filter(~_nonfinite())
    elif nonfinite != "string":
        raise ValueError(f"unknown nonfinite policy {nonfinite!r}")
    return rows


def write_snapshot(state: DataFrame, path: str, nonfinite: str = "reject",
                   reject_path: str | None = None) -> int:
    """State as JSON Lines of METRIC rows (counters keep their total in
    ``delta``), written by all tasks in parallel.  Sorted by kind (counters
    first) and name within each file.

    Crash-safe: each snapshot is a new version ``<path>/v=<n>``, published
    by a marker only once complete (``read_snapshot`` follows it), so a
    failed write never destroys the previous snapshot.  Returns ``n``.

    JSON has no NaN or Infinity.  ``nonfinite``: ``reject`` (default) leaves
    such gauges out of the snapshot and writes them to a lane, ``reject_path``
    or else ``<path>/_rejects/v=<n>``; ``error`` fails the write; ``string`` writes them as strings
    (readable back by Spark, not by strict JSON readers).
    """
    spark = state.sparkSession
    cur = current_version(spark, path)
    version = 0 if cur is None else cur + 1
    if nonfinite == "reject":
        reject_path = reject_path or f"{path}/_rejects/v={version}"
        state = state.persist()
    try:
        rows = _snapshot_rows(state, nonfinite)
        (rows.sortWithinPartitions(F.col("type") != COUNTER, "id")
         .write.mode("overwrite").option("ignoreNullFields", "true").json(f"{path}/v={version}"))
        if nonfinite == "reject":
            (state.select("id", "type", "delta", F.col("value").cast("string").alias("value"))
             .filter(F.col("type") == "gauge").filter(_nonfinite_text())
             .write.mode("overwrite").json(reject_path))
    finally:
        if nonfinite == "reject":
            state.unpersist()
    publish_version(spark, path, version)
    return version


def _nonfinite_text() -> F.Column:
    return F.col("value").isin("NaN", "Infinity", "-Infinity")


def write_snapshot_array(state: DataFrame, path: str, max_rows: int = 100_000,
                         nonfinite: str = "error") -> None:
    """Interchange form: files that each hold one JSON array, counters first
    and then by name (a single ``null`` when the state is empty).  A state of
    about ``max_rows`` rows or fewer is one file; a larger one is cut by ranges
    of (kind, name) into arrays of about that many rows, built and written by
    separate tasks.  Positions count within a file."""
    rows = _snapshot_rows(state, nonfinite)
    files = max(1, -(-rows.count() // max_rows))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(
        (F.col("type") != COUNTER).alias("k"), F.col("id"), F.struct("id", "type", "delta", "value").alias("m")))),
        lambda x: x["m"])
    text = F.when(F.size("a") > 0, F.to_json("a")).otherwise(F.lit("null")).alias("value")
    if files == 1:
        rows.agg(ordered.alias("a")).select(text).coalesce(1).write.mode("overwrite").text(path)
        return
    parts = rows.repartitionByRange(files, F.col("type") != COUNTER, "id").withColumn("part", F.spark_partition_id())
    (parts.groupBy("part").agg(ordered.alias("a")).repartitionByRange(files, "part").select(text)
     .write.mode("overwrite").option("maxRecordsPerFile", 1).text(path))


def write_update_array(updates: DataFrame, path: str, max_rows: int = 100_000, seq: str = "seq") -> None:
    """An update log as files of one JSON array each, in log order: ranges of
    about ``max_rows`` rows, the ranges in the order of the files' numbers."""
    files = max(1, -(-updates.count() // max_rows))
    parts = updates.repartitionByRange(files, seq).withColumn("part", F.spark_partition_id())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.struct("id", "type", "delta", "value").alias("m")))),
                          lambda x: x["m"])
    (parts.groupBy("part").agg(F.to_json(ordered).alias("value")).repartitionByRange(files, "part").sortWithinPartitions("part").select("value")
     .write.option("maxRecordsPerFile", 1).mode("overwrite").text(path))
