"""Streams into keyed tables (STR-1..STR-4) and audit delivery (STR-5, SNK-4).

Each micro-batch is folded to one row per key and merged into a
``sources.buckets.KeyedTable``: the table is the state, so a stream continues
whatever the table already holds, an epoch's writing follows the buckets it
touches, a replayed epoch is applied once, and late rows amend what is stored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeline.operators.validate import lenient_filter
from gaugeline.plans.ingest import evaluate_requests, evaluate_routes, folded_rows, request_audit
from gaugeline.session import checkpoint_root
from gaugeline.sources.buckets import Files, KeyedTable, ordered_fold, state_table
from gaugeline.sources.state import current_version, publish_version, query_id

log = logging.getLogger(__name__)


def _start(stream: DataFrame, each: Callable[[DataFrame, int, str], None], name: str, checkpoint: str | None,
           trigger: dict | None) -> StreamingQuery:
    ck = checkpoint or f"{checkpoint_root(stream.sparkSession)}/streams/{name}"
    return (stream.writeStream.foreachBatch(lambda df, epoch: each(df, epoch, query_id(df.sparkSession, ck))).queryName(name)
            .option("checkpointLocation", ck).trigger(**(trigger or {"availableNow": True})).start())


def _commit(table: KeyedTable, rows: DataFrame, epoch: int, writer: str, keep: int | None) -> None:
    table.commit(rows, writer, epoch)
    if keep is not None:
        table.retain(rows.sparkSession, keep)


def start_state_fold(updates: DataFrame, root: str, query_name: str = "state_fold", checkpoint: str | None = None,
                     trigger: dict | None = None, buckets: int = 64, keep: int | None = None) -> StreamingQuery:
    """STR-1: the state table at ``root`` follows an update stream (invalid rows
    are skipped).  STR-3: every epoch is a snapshot, one per ``trigger``
    interval; with ``keep`` only the newest that many stay."""
    table = state_table(root, buckets)
    return _start(updates, lambda df, epoch, writer: _commit(table, ordered_fold(lenient_filter(df)), epoch, writer, keep),
                  query_name, checkpoint, trigger)


def start_state_apply(requests: DataFrame, root: str, key: str | None, query_name: str = "state_apply",
                      checkpoint: str | None = None, trigger: dict | None = None, buckets: int = 64,
                      keep: int | None = None, all_routes: bool = False) -> StreamingQuery:
    """STR-2: the state table follows a request stream through the strict gate."""
    table = state_table(root, buckets)
    evaluate = evaluate_routes if all_routes else evaluate_requests

    def each(df: DataFrame, epoch: int, writer: str) -> None:
        _commit(table, ordered_fold(folded_rows(evaluate(df, key)), "request_id"), epoch, writer, keep)
    return _start(requests, each, query_name, checkpoint, trigger)


def window_table(root: str, producer: str, producer_type: str = "bigint", buckets: int = 64) -> KeyedTable:
    """Poll windows, one row per producer and window start."""
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        keys = [producer, "window_start"]
        return old.unionByName(new).groupBy(*keys).agg(
            F.max("window_end").alias("window_end"), F.sum("poll_count").alias("poll_count"),
            F.max_by("last_value", "last_seq").alias("last_value"), F.max("last_seq").alias("last_seq"))
    schema = f"{producer} {producer_type}, window_start timestamp_ntz, window_end timestamp_ntz, poll_count bigint, last_value double, last_seq bigint"
    return KeyedTable(root, (producer, "window_start"), schema, merge, buckets)


def start_window_table(samples: DataFrame, root: str, producer: str, ts: str, value: str, seq: str, width: str,
                       query_name: str = "poll_table", checkpoint: str | None = None, trigger: dict | None = None,
                       buckets: int = 64) -> StreamingQuery:
    """STR-4 without loss: every poll counts, however late; each epoch amends
    the windows it has polls for, and open windows are in the table as well."""
    table = window_table(root, producer, dict(samples.dtypes)[producer], buckets)

    def each(df: DataFrame, epoch: int, writer: str) -> None:
        # Naive timestamps window by wall clock, whatever the session zone.
        rows = (df.withColumn(ts, F.col(ts).cast("timestamp_ntz")).groupBy(producer, F.window(ts, width).alias("w"))
                .agg(F.count(F.lit(1)).alias("poll_count"), F.max_by(value, seq).alias("last_value"), F.max(seq).alias("last_seq"))
                .select(producer, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "poll_count",
                        "last_value", "last_seq"))
        table.commit(rows, writer, epoch)
    return _start(samples, each, query_name, checkpoint, trigger)


def json_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A folder of JSON Lines, one subfolder an epoch, overwritten when sent again."""
    def send(events: DataFrame, epoch: int) -> None:
        events.select("ts", "metrics", "ip_address").write.mode("overwrite").json(f"{path}/epoch={epoch}")
    return send


def deliver(spark: SparkSession, outbox: str, sinks: dict[str, Callable[[DataFrame, int], None]]) -> dict[str, Exception]:
    """SNK-4: send each sink the outbox epochs it has not confirmed, in order.

    A sink's marker is the last epoch it took.  One that fails keeps its place, is
    logged and does not stop the others; it is sent the same epochs by the next
    call.  Returns the failures by sink."""
    ready = sorted(int(n.partition("=")[2]) for n in Files(spark).names(f"{outbox}/events") if n.startswith("epoch="))
    written = current_version(spark, f"{outbox}/complete")
    failed: dict[str, Exception] = {}
    for name, send in sinks.items():
        done = current_version(spark, f"{outbox}/delivered/{name}")
        for epoch in ready:
            if (done is not None and epoch <= done) or written is None or epoch > written:
                continue
            try:
                send(spark.read.schema(OUTBOX).parquet(f"{outbox}/events/epoch={epoch}"), epoch)
            except Exception as e:  # noqa: BLE001 - one sink must not stop the rest
                log.error("audit sink %s failed at epoch %s: %s", name, epoch, e)
                failed[name] = e
                break
            publish_version(spark, f"{outbox}/delivered/{name}", epoch)
    return failed


OUTBOX = "request_id bigint, ts bigint, metrics array<string>, ip_address string"


def start_audit_delivery(requests: DataFrame, key: str | None, outbox: str, sinks: dict[str, Callable[[DataFrame, int], None]],
                         query_name: str = "audit_delivery", checkpoint: str | None = None, trigger: dict | None = None,
                         all_routes: bool = False) -> StreamingQuery:
    """STR-5: each epoch's audit events are kept in the outbox (overwritten by
    a replay) and sent to every sink once.  One stream an outbox."""
    evaluate = evaluate_routes if all_routes else evaluate_requests

    def each(df: DataFrame, epoch: int, _: str) -> None:
        spark = df.sparkSession
        (request_audit(evaluate(df, key)).select("request_id", "ts", "metrics", "ip_address")
         .write.mode("overwrite").parquet(f"{outbox}/events/epoch={epoch}"))
        publish_version(spark, f"{outbox}/complete", epoch)
        deliver(spark, outbox, sinks)
    return _start(requests, each, query_name, checkpoint, trigger)
