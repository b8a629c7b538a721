"""Keyed tables in hash buckets: a commit rewrites only the buckets it touches.

Layout under ``root``::

    data/v=<n>/bucket=<b>/   rows of bucket b as commit n left them
    manifests/version=<n>/   (bucket, v): where each bucket's rows are at version n
    _pointers/version=<n>    marker: version n is complete (``sources.state``)

A version is a manifest, so versions share the buckets that did not change, and a
reader of an older version is not disturbed by later commits.  A commit writes
its buckets, then its manifest, then the marker; one that fails publishes
nothing and the next commit reuses its number.  The marker names the writer and
its epoch, so a replayed epoch is not applied again.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.operators.fold import add_totals
from gaugeline.schema import COUNTER, GAUGE
from gaugeline.sources.state import POINTERS, current_version, published_epoch, publish_version


@dataclass(frozen=True)
class KeyedTable:
    """A table with one row per ``keys``.  ``merge(old, new)`` joins two frames
    of that kind into one; ``buckets`` is fixed when the table is first written and
    bounds what the driver sees of a manifest."""

    root: str
    keys: tuple[str, ...]
    schema: str
    merge: Callable[[DataFrame, DataFrame], DataFrame]
    buckets: int = 64
    row_group_bytes: int = 16 << 20     # small groups: point reads skip most of a bucket

    def version(self, spark: SparkSession) -> int | None:
        return current_version(spark, self.root)

    def manifest(self, spark: SparkSession, version: int | None) -> dict[int, int]:
        """Version of the files of each bucket."""
        if version is None:
            return {}
        m = spark.read.schema("bucket int, v int").parquet(f"{self.root}/manifests/version={version}")
        return {r.bucket: r.v for r in m.collect()}

    def _rows(self, spark: SparkSession, places: dict[int, int]) -> DataFrame:
        if not places:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(places.items())]
        return spark.read.schema(self.schema).parquet(*paths)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The rows of the newest (or a given) version; none before the first commit."""
        return self._rows(spark, self.manifest(spark, self.version(spark) if version is None else version))

    def read_for(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """``read`` of the buckets that hold any of ``keys`` (columns ``self.keys``)."""
        spark = keys.sparkSession
        places = self.manifest(spark, self.version(spark) if version is None else version)
        wanted = {r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect()}
        return self._rows(spark, {b: v for b, v in places.items() if b in wanted})

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def commit(self, new: DataFrame, writer: str | None = None, epoch: int | None = None) -> int | None:
        """Merge ``new`` (one row per key) and publish the next version; None
        when ``writer`` has published ``epoch`` before."""
        spark = new.sparkSession
        if writer is not None and published_epoch(spark, self.root, writer, epoch) is not None:
            return None
        base = self.version(spark)
        version = 0 if base is None else base + 1
        places = self.manifest(spark, base)
        new = new.withColumn("bucket", self.bucket()).persist()
        try:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]
            if touched:
                old = self._rows(spark, {b: places[b] for b in touched if b in places})
                merged = self.merge(old, new.drop("bucket")).withColumn("bucket", self.bucket())
                options = {f"parquet.bloom.filter.enabled#{k}": "true" for k in self.keys}
                (merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", *self.keys)
                 .write.options(**options, **{"parquet.block.size": str(self.row_group_bytes)})
                 .mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={version}"))
        finally:
            new.unpersist()
        places.update((b, version) for b in touched)
        (spark.createDataFrame(sorted(places.items()), "bucket int, v int").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/manifests/version={version}"))
        publish_version(spark, self.root, version, writer, epoch, base)
        return version

    def retain(self, spark: SparkSession, keep: int = 2) -> None:
        """Remove what none of the newest ``keep`` versions reaches: buckets,
        manifests and markers.  Readers of those versions are not disturbed."""
        newest = self.version(spark)
        if newest is None:
            return
        files = Files(spark)
        there = {int(x.partition("=")[2]) for x in files.names(f"{self.root}/manifests") if x.startswith("version=")}
        kept = sorted(n for n in there if newest - max(1, keep) < n <= newest)
        reached = {(v, b) for n in kept for b, v in self.manifest(spark, n).items()}
        for name in files.names(f"{self.root}/data"):
            v = int(name.partition("=")[2])
            held = files.names(f"{self.root}/data/{name}")
            dead = [x for x in held if x.startswith("bucket=") and (v, int(x.partition("=")[2])) not in reached]
            if v > newest:
                continue                       # a commit under way
            if len(dead) == sum(x.startswith("bucket=") for x in held):
                files.remove(f"{self.root}/data/{name}")
            else:
                for x in dead:
                    files.remove(f"{self.root}/data/{name}/{x}")
        for folder in ("manifests", POINTERS):
            for name in files.names(f"{self.root}/{folder}"):
                if name.startswith("version=") and int(name.partition("=")[2]) < kept[0]:
                    files.remove(f"{self.root}/{folder}/{name}")


class Files:
    """Names and removal on whatever file system a path is on."""

    def __init__(self, spark: SparkSession):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        fs = p.getFileSystem(self.conf)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def remove(self, path: str) -> None:
        p = self.path(path)
        p.getFileSystem(self.conf).delete(p, True)


# State with the order of each gauge's last write, so that merging does not
# depend on which of two commits comes first.
ORDERED_STATE = "type string, id string, delta bigint, value double, seq bigint"


def ordered_fold(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Valid updates folded to ORDERED_STATE rows."""
    t = F.col("type")
    return updates.groupBy("type", "id").agg(
        F.sum(F.when(t == COUNTER, F.col("delta"))).alias("delta"),
        F.max_by(F.when(t == GAUGE, F.col("value")), F.col(seq)).alias("value"), F.max(seq).alias("seq"))


def _merge_ordered(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select("type", "id", *[F.col(c).alias(f"_o{c}") for c in ("delta", "value", "seq")])
    n = new.select("type", "id", *[F.col(c).alias(f"_n{c}") for c in ("delta", "value", "seq")])
    later = F.coalesce(F.col("_nseq") >= F.col("_oseq"), F.col("_nseq").isNotNull())
    return o.join(n, ["type", "id"], "full_outer").select(
        "type", "id", F.when(F.col("type") == COUNTER, add_totals(F.col("_odelta"), F.col("_ndelta"))).alias("delta"),
        F.when(F.col("type") == GAUGE, F.when(later, F.col("_nvalue")).otherwise(F.col("_ovalue"))).alias("value"),
        F.greatest("_oseq", "_nseq").alias("seq"))


def state_table(root: str, buckets: int = 64, row_group_bytes: int = 16 << 20) -> KeyedTable:
    """MRG-3 on stored state."""
    return KeyedTable(root, ("type", "id"), ORDERED_STATE, _merge_ordered, buckets, row_group_bytes)
