"""Stored state (SRC-5) and its versioned layout (H5).

Parquet has no MERGE and a path cannot be overwritten while it is read, so
state lives in versions ``<root>/v=<n>``.  A writer produces version n
completely, then publishes it by writing the marker ``_pointers/version=<n>``
(a one-row text write, committed atomically by Spark's output committer);
readers take the highest published version.  A failed write publishes
nothing, and the next write reuses its number.  A marker also names the
writer (a streaming query's id), its epoch and the version it built on, so a
replayed epoch finds that it was published.  Each version is partitioned by
``type`` (kind pruning) and sorted by ``id`` inside files (row-group min/max
prune point lookups).
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.schema import COUNTER

POINTERS = "_pointers"


STATE_SCHEMA = "id string, delta bigint, value double, type string"
MARK_SCHEMA = "version int, writer string, epoch bigint, base int"


def _marks(spark: SparkSession, root: str) -> DataFrame | None:
    """The published markers of ``root``; None when nothing was ever published.

    Any other read error is raised: an unreadable store is not an empty one.
    """
    try:
        marks = spark.read.text(f"{root}/{POINTERS}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if "version" not in marks.columns:
        return None
    m = F.from_json("value", MARK_SCHEMA)
    return marks.select(F.col("version").cast("int").alias("version"), m["writer"].alias("writer"),
                        m["epoch"].alias("epoch"), m["base"].alias("base"))


def current_version(spark: SparkSession, root: str) -> int | None:
    """Highest published version, or None for a store never written."""
    marks = _marks(spark, root)
    return None if marks is None else marks.agg(F.max("version")).first()[0]


def published_epoch(spark: SparkSession, root: str, writer: str, epoch: int) -> int | None:
    """The version that ``writer`` published for ``epoch``, or None."""
    marks = _marks(spark, root)
    if marks is None:
        return None
    return marks.filter((F.col("writer") == writer) & (F.col("epoch") == epoch)).agg(F.max("version")).first()[0]


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Structured Streaming keeps in a checkpoint: the same after a
    restart, another one under a fresh checkpoint."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def first_mark(spark: SparkSession, root: str, writer: str) -> tuple[bool, int | None]:
    """Whether ``writer`` has published, and the version its first epoch built on."""
    marks = _marks(spark, root)
    row = None if marks is None else (
        marks.filter(F.col("writer") == writer).agg(F.min_by("base", "epoch").alias("base"), F.count("*").alias("n")).first())
    return (False, None) if row is None or row.n == 0 else (True, row.base)


def publish_version(spark: SparkSession, root: str, version: int, writer: str | None = None,
                    epoch: int | None = None, base: int | None = None) -> None:
    """Mark version ``version`` under ``root`` as complete."""
    mark = json.dumps({"version": version, "writer": writer, "epoch": epoch, "base": base})
    (spark.createDataFrame([(mark,)], "value string").coalesce(1)
     .write.mode("overwrite").text(f"{root}/{POINTERS}/version={version}"))


def write_state_version(state: DataFrame, root: str, version: int | None = None, writer: str | None = None,
                        epoch: int | None = None, base: int | None = None) -> int:
    """Write ``state`` (METRIC rows) as the next version (or as ``version``)
    and publish it.  Returns the version written."""
    spark = state.sparkSession
    if version is None:
        cur = current_version(spark, root)
        version = 0 if cur is None else cur + 1
    # A folded state is already hash-partitioned by (type, id); only sort.
    (state.sortWithinPartitions("type", "id")
     .write.mode("overwrite").partitionBy("type").parquet(f"{root}/v={version}"))
    publish_version(spark, root, version, writer, epoch, base)
    return version


def read_state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Current (or a given) state version as ``(id, delta, value, type)``."""
    if version is None:
        version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no state written under {root}")
    return spark.read.schema(STATE_SCHEMA).parquet(f"{root}/v={version}")


def read_typed_state(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """One kind as the typed table ``(id, value)``; the kind filter prunes
    the other partition and only two columns are read."""
    s = read_state(spark, root).filter(F.col("type") == kind)
    return s.select("id", (F.col("delta") if kind == COUNTER else F.col("value")).alias("value"))
