"""Registered plans that run a stream over the given tables into stored tables
(STR-1..STR-5, SNK-4, SNK-7).

Each call writes its input as files of a new folder under the shared checkpoint
root, runs the stream over them in several epochs (``availableNow``), and returns
what it stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from gaugeline import operators as op
from gaugeline.plans import oracle_sql as q
from gaugeline.plans.catalog import _after, _before, accepted, register
from gaugeline.plans.catalog_requests import _ACC_REQ, REQ, envelopes
from gaugeline.session import checkpoint_root
from gaugeline.sinks import write_state_tables
from gaugeline.sources import load_table, read_requests, update_log
from gaugeline.sources.buckets import ordered_fold, state_table
from gaugeline.sources.updates import SIGNING_KEY
from gaugeline.streaming.keyed import (json_sink, start_audit_delivery, start_state_apply, start_state_fold, start_window_table,
                                       window_table)

STATE_COLS = ["type", "id", "delta", "value"]

LENIENT = q.with_(q.U, q.C) + """
 SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
        ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
 FROM c WHERE err_code = 0 GROUP BY type, id"""

GATED = q.with_(q.U, q.C, q.BODIES, REQ) + _ACC_REQ + """
 SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
        ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
 FROM c WHERE batch_id IN (SELECT batch_id FROM okb) GROUP BY type, id"""


def fresh_folder(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def as_stream(df: DataFrame, root: str, files: int = 4, at_once: int = 2) -> DataFrame:
    """``df`` written as ``files`` files and read back ``at_once`` an epoch.  Rows
    are dealt by their hash, so each epoch holds early and late ones."""
    df.repartition(files).write.parquet(f"{root}/input")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", at_once).parquet(f"{root}/input")


@register("str_batch_apply", GATED)
def str_batch_apply(spark, sf_dir):
    """STR-2 + MRG-3: a request stream through the strict gate into the
    bucketed state table, in two epochs."""
    root = fresh_folder(spark, "str_batch_apply")
    stream = as_stream(envelopes(spark, sf_dir), root)
    start_state_apply(stream, f"{root}/state", SIGNING_KEY, f"apply-{uuid.uuid4().hex}", f"{root}/ck").awaitTermination()
    return state_table(f"{root}/state").read(spark).select(*STATE_COLS)


@register("str_fold", LENIENT)
def str_fold(spark, sf_dir):
    """STR-1 continuing a stored state: the first half of the log is a stored
    version, the second half arrives in two epochs."""
    root = fresh_folder(spark, "str_fold")
    events = load_table(spark, sf_dir, "events")
    state_table(f"{root}/state").commit(ordered_fold(op.lenient_filter(update_log(_before(events)))))
    stream = as_stream(_after(events), root)
    start_state_fold(update_log(stream), f"{root}/state", f"fold-{uuid.uuid4().hex}", f"{root}/ck").awaitTermination()
    return state_table(f"{root}/state").read(spark).select(*STATE_COLS)


@register("str_snapshot", LENIENT)
def str_snapshot(spark, sf_dir):
    """STR-3: a snapshot an epoch, of which the newest two are kept."""
    root = fresh_folder(spark, "str_snapshot")
    stream = as_stream(load_table(spark, sf_dir, "events"), root, at_once=1)
    start_state_fold(update_log(stream), f"{root}/state", f"snapshot-{uuid.uuid4().hex}", f"{root}/ck", keep=2).awaitTermination()
    return state_table(f"{root}/state").read(spark).select(*STATE_COLS)


@register("str_windows", """
 SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
        COUNT(*) AS poll_count, ARG_MAX(value, event_id) AS last_value
 FROM events GROUP BY user_id, date_trunc('hour', ts)""")
def str_windows(spark, sf_dir):
    """STR-4 on a stream: polls arrive in any order and none is lost."""
    root = fresh_folder(spark, "str_windows")
    stream = as_stream(load_table(spark, sf_dir, "events"), root)
    start_window_table(stream, f"{root}/windows", "user_id", "ts", "value", "event_id", "1 hour",
                       f"windows-{uuid.uuid4().hex}", f"{root}/ck").awaitTermination()
    table = window_table(f"{root}/windows", "user_id", dict(stream.dtypes)["user_id"])
    return table.read(spark).select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                                    "poll_count", "last_value")


@register("str_audit", q.with_(q.U, q.C, q.BODIES, REQ) + _ACC_REQ + f"""
 SELECT s.sink, CAST(epoch_us(req.arrival_ts) // 1000000 AS BIGINT) AS ts,
        to_json(l.names) AS metrics_json, {q.client_ip_sql('real_ip', 'xff', 'remote_addr')} AS ip_address
 FROM req JOIN (SELECT batch_id, list(id ORDER BY pos) AS names FROM u GROUP BY batch_id) l
   ON req.batch_id = l.batch_id, (SELECT unnest(['file', 'mirror']) AS sink) s
 WHERE req.batch_id IN (SELECT batch_id FROM okb)""")
def str_audit(spark, sf_dir):
    """STR-5 + SNK-4: audit events of a request stream, delivered once to each of two sinks."""
    root = fresh_folder(spark, "str_audit")
    stream = as_stream(envelopes(spark, sf_dir), root)
    sinks = {name: json_sink(f"{root}/{name}") for name in ("file", "mirror")}
    start_audit_delivery(stream, SIGNING_KEY, f"{root}/outbox", sinks, f"audit-{uuid.uuid4().hex}", f"{root}/ck").awaitTermination()
    out = None
    for name in sinks:
        got = spark.read.schema("ts bigint, metrics array<string>, ip_address string").json(f"{root}/{name}").select(
            F.lit(name).alias("sink"), "ts", F.to_json("metrics").alias("metrics_json"), "ip_address")
        out = got if out is None else out.unionByName(got)
    return out


@register("state_tables", q.with_(q.U, q.C, q.ACC, q.STATE) + " SELECT type, id, delta, value FROM st")
def state_tables(spark, sf_dir):
    """SNK-7 with MRG-1/2: the first half's state as bucketed catalog tables, the
    second half's updates merged into them without an exchange of the tables."""
    root, prefix = fresh_folder(spark, "state_tables"), f"s{uuid.uuid4().hex}_"
    acc = accepted(spark, sf_dir)
    write_state_tables(op.fold_state(_before(acc)), root, prefix, buckets=8)
    gauges = op.merge_gauges(spark.table(f"{prefix}gauge"), _after(acc))
    counters = op.merge_counters(spark.table(f"{prefix}counter"), _after(acc))
    return op.union_kinds(counters, gauges).select(*STATE_COLS)


@register("stored_lookup", q.with_(q.U, q.C, q.ACC, q.STATE, q.READS) + f"""
 SELECT rq.request_id, rq.type, rq.id,
        CASE WHEN rq.type NOT IN ('gauge', 'counter') THEN 400 WHEN st.id IS NULL THEN 404 ELSE 200 END AS status,
        CASE WHEN st.id IS NOT NULL THEN {q.metric_text('st.type', 'st.delta', 'st.value')} END AS text
 FROM rq LEFT JOIN st ON rq.type = st.type AND rq.id = st.id""")
def stored_lookup(spark, sf_dir):
    """LKP-2 on the stored state table: only buckets with requested keys are read."""
    table = state_table(fresh_folder(spark, "stored_lookup"))
    table.commit(ordered_fold(accepted(spark, sf_dir)))
    reads = read_requests(load_table(spark, sf_dir, "events"))
    return op.stored_lookup(reads, table).select("request_id", "type", "id", "status", "text")
