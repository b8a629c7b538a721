"""Folding updates into state and per-batch aggregates (AGG-1..AGG-6).

Every fold here is a partial/final hash aggregate: map-side partials mean a
hot key (one id carrying a third of all rows) ships one partial per task,
not its rows.  The gauge fold orders by one bigint ``seq``; a struct or
string ordering would push the aggregate onto the sort-based path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.schema import COUNTER, GAUGE, STATE_DOC

_TWO_63 = "CAST('9223372036854775808' AS DECIMAL(38,0))"
_TWO_64 = "CAST('18446744073709551616' AS DECIMAL(38,0))"


def sum_deltas(c: Column, overflow: str = "error") -> Column:
    """Counter total with an overflow policy.

    ``error`` (default, as a BIGINT column in a database): ANSI sum raises.
    ``null``: the total becomes null.  ``wrap``: two's-complement wrap like
    Go int64 addition, summed exactly as DECIMAL(38,0) then folded mod 2^64.
    """
    if overflow == "error":
        return F.sum(c)
    if overflow == "null":
        return F.try_sum(c)
    if overflow == "wrap":
        exact = F.sum(c.cast("decimal(38,0)"))
        wrapped = F.pmod(exact + F.expr(_TWO_63), F.expr(_TWO_64)) - F.expr(_TWO_63)
        return wrapped.cast("bigint")
    raise ValueError(f"unknown overflow policy {overflow!r}")


def add_totals(a: Column, b: Column, overflow: str = "error") -> Column:
    """``a + b`` for counter totals under the same overflow policy as
    ``sum_deltas`` (a null side counts as 0)."""
    a, b = F.coalesce(a, F.lit(0).cast("bigint")), F.coalesce(b, F.lit(0).cast("bigint"))
    if overflow == "error":
        return a + b
    if overflow == "null":
        return F.try_add(a, b)
    if overflow == "wrap":
        exact = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
        return (F.pmod(exact + F.expr(_TWO_63), F.expr(_TWO_64)) - F.expr(_TWO_63)).cast("bigint")
    raise ValueError(f"unknown overflow policy {overflow!r}")


def fold_state(updates: DataFrame, overflow: str = "error", seq: str = "seq") -> DataFrame:
    """AGG-3: current state of a validated update log, as METRIC rows
    ``(type, id, delta, value)``: counters sum their deltas, gauges keep the
    value of the highest ``seq``."""
    t = F.col("type")
    return updates.groupBy("type", "id").agg(
        sum_deltas(F.when(t == COUNTER, F.col("delta")), overflow).alias("delta"),
        F.max_by(F.when(t == GAUGE, F.col("value")), F.col(seq)).alias("value"),
    )


def salvage_fold(lanes: DataFrame, batch: str = "batch_id", pos: str = "pos", overflow: str = "error") -> DataFrame:
    """VAL-7 applied to state: ``lanes`` (from ``batch_lanes``) without the
    quarantined rows, in the order in which they land: batch by batch, and
    the salvaged rows of a batch, sent again one by one, after it and before
    the next.  Each batch is folded by position first, so the order of the
    state is one number, twice the batch and the phase."""
    t = F.col("type")
    rows = lanes.where(F.col("lane") != "quarantined")
    phase = F.when(F.col("lane") == "salvaged", F.lit(1)).otherwise(F.lit(0))
    each = rows.groupBy((F.col(batch) * 2 + phase).alias("_landed"), "type", "id").agg(
        sum_deltas(F.when(t == COUNTER, F.col("delta")), overflow).alias("delta"),
        F.max_by(F.when(t == GAUGE, F.col("value")), F.col(pos)).alias("value"))
    return fold_state(each, overflow, seq="_landed")


def counter_totals(updates: DataFrame, overflow: str = "error") -> DataFrame:
    """AGG-1: ``(id, value)`` total per counter; a zero delta creates the id."""
    return (updates.filter(F.col("type") == COUNTER).groupBy("id")
            .agg(sum_deltas(F.col("delta"), overflow).alias("value")))


def gauge_latest(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """AGG-2: ``(id, value)`` last written value per gauge."""
    return (updates.filter(F.col("type") == GAUGE).groupBy("id")
            .agg(F.max_by("value", seq).alias("value")))


def batch_names(updates: DataFrame, batch: str = "batch_id", pos: str = "pos",
                chunk_rows: int | None = None) -> DataFrame:
    """AGG-4: ordered names of each batch, duplicates kept.

    Output ``(batch, chunk, names)``: one list per batch (chunk 0), as in the
    reference.  Only a caller who gives ``chunk_rows`` gets chunks of at most
    that many positions.
    """
    chunk = F.lit(0).cast("bigint") if chunk_rows is None else F.floor(F.col(pos) / chunk_rows).cast("bigint")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("id")))),
                          lambda x: x["id"])
    return updates.groupBy(batch, chunk.alias("chunk")).agg(ordered.alias("names"))


def batch_summary(updates: DataFrame, batch: str = "batch_id") -> DataFrame:
    """AGG-5: per batch ``n_rows, n_gauges, n_counters, json_bytes``.

    ``json_bytes`` is the byte length of the batch's JSON array, summed from
    the element lengths (plus commas and brackets) so no body is built.
    """
    elem = F.octet_length(F.to_json(F.struct("id", "type", "delta", "value")))
    return updates.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("type") == GAUGE).alias("n_gauges"),
        F.count_if(F.col("type") == COUNTER).alias("n_counters"),
        (F.sum(elem) + F.count(F.lit(1)) + 1).cast("bigint").alias("json_bytes"),
    )


def state_documents(state: DataFrame, buckets: int = 1) -> DataFrame:
    """AGG-6: state as ``{"gauges": {...}, "counters": {...}}`` documents.

    The whole state as one value does not scale, so the document is split
    into ``buckets`` documents by a hash of the name; choose ``buckets`` so
    that each stays small (``state_rows / buckets`` entries).
    Output ``(bucket, doc)`` with ``doc`` the JSON text.
    """
    t = F.col("type")
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
    docs = state.groupBy(bucket).agg(
        F.map_from_entries(F.collect_list(F.when(t == GAUGE, F.struct("id", "value")))).alias("gauges"),
        F.map_from_entries(F.collect_list(F.when(t == COUNTER, F.struct("id", "delta")))).alias("counters"))
    return docs.select("bucket", F.to_json(F.struct("gauges", "counters")).alias("doc"))


def sized_state_documents(state: DataFrame, max_entries: int = 100_000) -> DataFrame:
    """``state_documents`` with the bucket count chosen from the state size
    (one counting job) so no document holds more than about ``max_entries``
    names whatever the state grows to."""
    n = state.count()
    return state_documents(state, buckets=max(1, -(-n // max_entries)))


def documents_to_rows(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Decode state documents back into METRIC rows ``(type, id, delta, value)``."""
    d = docs.select(F.from_json(doc, STATE_DOC).alias("d"))
    g = d.select(F.explode("d.gauges").alias("id", "value")).select(
        F.lit(GAUGE).alias("type"), "id", F.lit(None).cast("bigint").alias("delta"), "value")
    c = d.select(F.explode("d.counters").alias("id", "delta")).select(
        F.lit(COUNTER).alias("type"), "id", "delta", F.lit(None).cast("double").alias("value"))
    return g.unionByName(c)
