"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Schema per table path, read once per process (the role a catalog plays):
# without it every plan build starts small footer-reading jobs.
_SCHEMAS: dict[str, StructType] = {}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data set.  Callers select the columns they
    use, so the scan's ReadSchema holds only those and filters push down."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is None:
        schema = spark.read.parquet(path).schema
        _SCHEMAS[path] = schema
    return spark.read.schema(schema).parquet(path)
