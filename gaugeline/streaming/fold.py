"""Continuous fold (STR-1) and periodic snapshots (STR-3).

The streaming aggregation keeps one state row per ``(type, id)`` in the
state store, never expired (the service never forgets a metric); choose the
RocksDB state store provider for large key sets.  Checkpoints go under the
session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeline.operators.merge import merge_state
from gaugeline.operators.validate import lenient_filter
from gaugeline.schema import COUNTER, GAUGE
from gaugeline.session import checkpoint_root
from gaugeline.sources.state import current_version, first_mark, published_epoch, query_id, read_state, write_state_version


def continuous_fold(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Streaming state of an update stream: invalid rows are skipped (the
    store-level rule), counters add up, gauges keep the highest ``seq``."""
    ok = lenient_filter(updates)
    t = F.col("type")
    return ok.groupBy("type", "id").agg(
        F.sum(F.when(t == COUNTER, F.col("delta"))).alias("delta"),
        F.max_by(F.when(t == GAUGE, F.col("value")), F.col(seq)).alias("value"))


def _checkpoint(updates: DataFrame, name: str, checkpoint: str | None) -> str:
    return checkpoint or f"{checkpoint_root(updates.sparkSession)}/streams/{name}"


def start_continuous_fold(updates: DataFrame, query_name: str, checkpoint: str | None = None,
                          output_mode: str = "update", sink: str = "memory",
                          trigger: dict | None = None) -> StreamingQuery:
    """Run STR-1 into a sink (``memory`` for tests; ``update`` mode emits
    only changed keys per micro-batch, ``complete`` the whole state)."""
    w = (continuous_fold(updates).writeStream.outputMode(output_mode).format(sink)
         .queryName(query_name).option("checkpointLocation", _checkpoint(updates, query_name, checkpoint)))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def start_periodic_snapshot(updates: DataFrame, state_root: str, query_name: str = "snapshot",
                            checkpoint: str | None = None, interval: str | None = "300 seconds") -> StreamingQuery:
    """STR-3: keep the folded state and write it as a state version every
    ``interval`` (``None`` = one run over what is available, the start-up
    save).  A store that held state before the query's first epoch is restored
    first: every snapshot is that version with the stream's updates on top.
    A replayed epoch that was published is not written again."""
    ck = _checkpoint(updates, query_name, checkpoint)

    def save(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        writer = query_id(spark, ck)
        if published_epoch(spark, state_root, writer, epoch_id) is not None:
            return
        newest = current_version(spark, state_root)
        began, base = first_mark(spark, state_root, writer)
        base = base if began else newest
        state = batch.select("type", "id", "delta", "value")
        if base is not None:
            state = merge_state(read_state(spark, state_root, base), state.withColumn("seq", F.lit(0).cast("bigint")))
        write_state_version(state, state_root, 0 if newest is None else newest + 1, writer, epoch_id, base)

    trig = {"processingTime": interval} if interval else {"availableNow": True}
    return (continuous_fold(updates).writeStream.outputMode("complete").foreachBatch(save)
            .queryName(query_name).option("checkpointLocation", ck)
            .trigger(**trig).start())
