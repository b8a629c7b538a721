"""Snapshot scan (SRC-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.schema import METRIC
from gaugeline.sources.array_scan import scan_array
from gaugeline.sources.state import current_version


def read_snapshot(spark: SparkSession, path: str, whole_array: bool = False) -> DataFrame:
    """Metric rows of a snapshot: ``(id, type, delta, value, file, pos)``.

    Default: JSON Lines written by ``sinks.write_snapshot`` (many part files,
    read in parallel; ``pos`` is null as the writer never repeats a key).
    ``whole_array=True`` reads the interchange form, one JSON array per file
    (a file holding ``null`` is an empty snapshot), by byte ranges in many tasks;
    ``pos`` is the array position, used for last-wins on repeated ids.
    """
    if not whole_array:
        # A snapshot written by ``sinks.write_snapshot`` is versioned: read
        # the newest published version.  Plain JSON files are read as given.
        version = current_version(spark, path)
        df = spark.read.schema(METRIC).json(path if version is None else f"{path}/v={version}")
        return (df.filter(~(F.col("id").isNull() & F.col("type").isNull()
                            & F.col("delta").isNull() & F.col("value").isNull()))
                .withColumns({"file": F.col("_metadata.file_path"), "pos": F.lit(None).cast("bigint")}))
    return scan_array(spark, path).select("id", "type", "delta", "value", "file", "pos")
