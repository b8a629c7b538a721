"""Keyed merges of folded updates into stored state (MRG-1..MRG-4).

Each side is folded to one row per key before the join, so the join is
skew-free whatever the update distribution, and the fold's hash
partitioning on the key is reused by the join (no second exchange on that
side).  The result is written as a new state version (``sources.state``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.operators.fold import add_totals, counter_totals, fold_state, gauge_latest
from gaugeline.schema import COUNTER, GAUGE


def merge_gauges(gauges: DataFrame, updates: DataFrame) -> DataFrame:
    """MRG-1: insert or overwrite: ``(id, value)``."""
    new = gauge_latest(updates).withColumnRenamed("value", "_new")
    return (gauges.withColumnRenamed("value", "_old").join(new, "id", "full_outer")
            .select("id", F.coalesce("_new", "_old").alias("value")))


def merge_counters(counters: DataFrame, updates: DataFrame, overflow: str = "error") -> DataFrame:
    """MRG-2: insert or add: ``(id, value)``."""
    new = counter_totals(updates, overflow).withColumnRenamed("value", "_new")
    return (counters.withColumnRenamed("value", "_old").join(new, "id", "full_outer")
            .select("id", add_totals(F.col("_old"), F.col("_new"), overflow).alias("value")))


def merge_state(state: DataFrame, updates: DataFrame, overflow: str = "error", seq: str = "seq") -> DataFrame:
    """MRG-3: apply a validated update log to METRIC state as one unit."""
    new = fold_state(updates, overflow, seq).select(
        "type", "id", F.col("delta").alias("_nd"), F.col("value").alias("_nv"))
    old = state.select("type", "id", F.col("delta").alias("_od"), F.col("value").alias("_ov"))
    j = old.join(new, ["type", "id"], "full_outer")
    return j.select(
        "type", "id",
        F.when(F.col("type") == COUNTER, add_totals(F.col("_od"), F.col("_nd"), overflow)).alias("delta"),
        F.when(F.col("type") == GAUGE, F.coalesce("_nv", "_ov")).alias("value"))


def restore_merge(current: DataFrame, snapshot: DataFrame, keep_zero_counters: bool = False) -> DataFrame:
    """MRG-4: merge a snapshot into current state the way start-up restore does.

    Gauges take the snapshot value.  Counters take the snapshot's absolute
    total (the restore adds ``want - cur``).  Names absent from the snapshot
    keep their value; rows with a null value or an unknown kind are skipped;
    a name repeated in the snapshot takes its last non-null entry (by
    ``pos``).  Quirk kept by default: a counter known only to the snapshot is
    created only if some entry for it is non-zero (an increment of 0 is
    never applied).
    """
    t = F.col("type")
    usable = snapshot.filter(((t == GAUGE) & F.col("value").isNotNull())
                             | ((t == COUNTER) & F.col("delta").isNotNull()))
    order = F.coalesce(F.col("pos"), F.lit(0))
    snap = usable.groupBy("type", "id").agg(
        F.max_by("value", order).alias("_sv"),
        F.max_by("delta", order).alias("_sd"),
        F.bool_or(F.col("delta") != 0).alias("_nonzero"))
    cur = current.select("type", "id", F.col("delta").alias("_cd"), F.col("value").alias("_cv"),
                         F.lit(True).alias("_has_cur"))
    j = cur.join(snap, ["type", "id"], "full_outer")
    has_cur = F.coalesce(F.col("_has_cur"), F.lit(False))
    create_ok = has_cur | F.lit(keep_zero_counters) | F.coalesce(F.col("_nonzero"), F.lit(False))
    delta = F.when(t == COUNTER, F.when(F.col("_sd").isNotNull() & create_ok, F.col("_sd")).otherwise(F.col("_cd")))
    value = F.when(t == GAUGE, F.coalesce("_sv", "_cv"))
    out = j.select("type", "id", delta.alias("delta"), value.alias("value"))
    return out.filter(((t == COUNTER) & F.col("delta").isNotNull())
                      | ((t == GAUGE) & F.col("value").isNotNull()))
