"""State tables in the catalog (SNK-7): create if missing, drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.schema import COUNTER, GAUGE

# The two typed tables of the database backend.
GAUGE_TABLE = "gauge"
COUNTER_TABLE = "counter"


def create_state_tables(spark: SparkSession, location: str | None = None, prefix: str = "") -> None:
    """``CREATE TABLE IF NOT EXISTS`` the typed tables as parquet tables."""
    for name, vtype in ((GAUGE_TABLE, "DOUBLE"), (COUNTER_TABLE, "BIGINT")):
        loc = f" LOCATION '{location}/{prefix}{name}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} (id STRING, value {vtype}) USING parquet{loc}")


def drop_state_tables(spark: SparkSession, prefix: str = "") -> None:
    for name in (GAUGE_TABLE, COUNTER_TABLE):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}")


def write_state_tables(state: DataFrame, location: str, prefix: str = "", buckets: int = 64) -> None:
    """The two typed tables as catalog tables bucketed and sorted by ``id``, so
    that merges and lookups by id read them without an exchange."""
    for name, kind, value in ((GAUGE_TABLE, GAUGE, "value"), (COUNTER_TABLE, COUNTER, "delta")):
        (state.where(F.col("type") == kind).select("id", F.col(value).alias("value")).repartition(buckets, "id")
         .write.mode("overwrite").format("parquet").option("path", f"{location}/{prefix}{name}")
         .bucketBy(buckets, "id").sortBy("id").saveAsTable(f"{prefix}{name}"))
