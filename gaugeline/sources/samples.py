"""Producer samples → metric rows (SRC-7 wide samples, SRC-8 array samples)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.schema import COUNTER, GAUGE

# The producer's tick counter name and per-CPU gauge prefix.
POLL_COUNTER = "PollCount"
CPU_PREFIX = "CPUutilization"


def unpivot_samples(samples: DataFrame, keys: list[str], readings: list[str],
                    counter: str | None = POLL_COUNTER) -> DataFrame:
    """Each named reading of a wide sample row becomes a gauge row; with
    ``counter`` set, each sample also yields one counter row of delta 1.
    Output ``(keys..., type, id, delta, value)``; a narrow projection, no shuffle.
    """
    wide = samples.select(*keys, *[F.col(c).cast("double").alias(c) for c in readings])
    gauges = (wide.unpivot(keys, readings, "id", "value")
              .select(*keys, F.lit(GAUGE).alias("type"), "id",
                      F.lit(None).cast("bigint").alias("delta"), "value"))
    if counter is None:
        return gauges
    ticks = samples.select(*keys, F.lit(COUNTER).alias("type"), F.lit(counter).alias("id"),
                           F.lit(1).cast("bigint").alias("delta"), F.lit(None).cast("double").alias("value"))
    return gauges.unionByName(ticks)


def explode_samples(samples: DataFrame, keys: list[str], array_col: str,
                    prefix: str = CPU_PREFIX) -> DataFrame:
    """Element i (0-based) of an array sample becomes gauge ``<prefix><i+1>``."""
    return samples.select(*keys, F.posexplode(array_col).alias("pos", "reading")).select(
        *keys, F.lit(GAUGE).alias("type"),
        F.concat(F.lit(prefix), (F.col("pos") + 1).cast("string")).alias("id"),
        F.col("reading").cast("double").alias("value"))
