"""Registered plans for requests, batches, restore, reports and windows
(VAL-8, FN-4, FN-5, AGG-4..6, MRG-4, SNK-*, STR-4 batch form)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gaugeline import functions as fn
from gaugeline import operators as op
from gaugeline.plans import oracle_sql as q
from gaugeline.plans.catalog import _after, _before, accepted, register, state, updates
from gaugeline.plans.ingest import evaluate_requests, ingest, request_audit
from gaugeline.schema import H_FORWARDED_FOR, H_HASH, H_REAL_IP
from gaugeline.session import checkpoint_root
from gaugeline.sinks import (listing_lines, request_log, signed_batches as sign_batches, single_update_audit,
                             write_snapshot, write_snapshot_array, write_update_array)
from gaugeline.sources import (batch_bodies, load_table, mixed_requests, parse_update_paths, path_requests, read_requests, read_snapshot,
                               request_envelopes)
from gaugeline.sources.gzip import deflate, inflate
from gaugeline.sources.updates import SIGNING_KEY
from gaugeline.streaming.ticks import poll_windows as poll_windows_op

REQ = q.requests_cte(SIGNING_KEY)


def envelopes(spark, sf_dir):
    return request_envelopes(batch_bodies(updates(spark, sf_dir)))


@register("client_ip", q.with_(q.U, q.BODIES, REQ) + f"""
 SELECT batch_id AS request_id, {q.client_ip_sql('real_ip', 'xff', 'remote_addr')} AS ip_address FROM req""")
def client_ip(spark, sf_dir):
    """FN-4: client address of every batch request."""
    r = envelopes(spark, sf_dir)
    ip = fn.client_ip(fn.header("headers", H_REAL_IP), fn.header("headers", H_FORWARDED_FOR), "remote_addr")
    return r.select("request_id", ip.alias("ip_address"))


@register("mask_hash", q.with_(q.U, q.BODIES, REQ) + """
 SELECT batch_id AS request_id,
        CASE WHEN hash IS NULL OR hash = '' THEN '' WHEN strlen(hash) <= 10 THEN hash
             ELSE left(hash, 10) || '…' END AS masked FROM req""")
def mask_hash(spark, sf_dir):
    """FN-5: masked signature header of every batch request."""
    r = envelopes(spark, sf_dir)
    return r.select("request_id", fn.mask_hash(r["headers"].getItem(H_HASH)).alias("masked"))


@register("verify_signature", q.with_(q.U, q.BODIES, REQ) + """
 SELECT batch_id AS request_id, hash AS presented,
        CASE WHEN hash IS NULL OR hash = '' THEN 'unsigned' WHEN hash = right_hash THEN 'valid'
             ELSE 'invalid' END AS signature_state FROM req""")
def verify_signature(spark, sf_dir):
    """VAL-8: HMAC check of every batch body against its header."""
    r = envelopes(spark, sf_dir).withColumn("presented", F.col("headers").getItem(H_HASH))
    return op.verify_signatures(r, SIGNING_KEY, hash_col="presented").select(
        "request_id", "presented", "signature_state")


_ACC_REQ = """
 , okb AS (SELECT batch_id FROM req WHERE batch_id % 10 <> 0 AND NOT undecodable
           AND batch_id NOT IN (SELECT batch_id FROM c WHERE err_code <> 0))"""


@register("ingest_state", q.with_(q.U, q.C, q.BODIES, REQ) + _ACC_REQ + """
 SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
        ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
 FROM c WHERE batch_id IN (SELECT batch_id FROM okb) GROUP BY type, id""")
def ingest_state(spark, sf_dir):
    """Write path end to end: signed bodies → verify → decode → gate → fold."""
    return ingest(envelopes(spark, sf_dir), SIGNING_KEY)["state"].select("type", "id", "delta", "value")


# Accepted rows of the mixed requests: a batch whole or not at all, single
# objects and paths one by one.
_MIXED = _ACC_REQ + """
 , ms AS (SELECT c.*, seq % 17 = 16 AS undecodable, seq % 10 = 0 AS wrong_sig FROM c WHERE batch_id % 3 = 1)
 , mp AS (SELECT c.*, (value IS NOT NULL OR delta IS NOT NULL) OR seq % 14 IN (0, 7) AS routed,
                 seq % 14 IN (0, 7) AS suffixed FROM c WHERE batch_id % 3 = 2)
 , mixed AS (
  SELECT seq, type, id, delta, value, batch_id * 10 AS request_id FROM c
  WHERE batch_id % 3 = 0 AND batch_id IN (SELECT batch_id FROM okb)
  UNION ALL SELECT seq, type, id, delta, value, seq FROM ms WHERE err_code = 0 AND NOT undecodable AND NOT wrong_sig
  UNION ALL SELECT seq, type, id, delta, value, seq FROM mp WHERE err_code = 0 AND routed AND NOT suffixed)"""


@register("ingest_mixed_state", q.with_(q.U, q.C, q.BODIES, REQ) + _MIXED + """
 SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
        ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value FROM mixed GROUP BY type, id""")
def ingest_mixed_state(spark, sf_dir):
    """SRC-1/2/3 in one write path: batch, single and path requests in order
    of arrival, signatures over bytes, folded by request."""
    requests = mixed_requests(updates(spark, sf_dir))
    return ingest(requests, SIGNING_KEY, all_routes=True)["state"].select("type", "id", "delta", "value")


@register("ingest_mixed_outcomes", q.with_(q.U, q.C, q.BODIES, REQ) + _MIXED + """
 SELECT batch_id * 10 AS request_id, 'batch' AS route,
        CASE WHEN batch_id IN (SELECT batch_id FROM okb) THEN 200 ELSE 400 END AS status,
        CASE WHEN hash IS NULL THEN 'unsigned' WHEN hash = right_hash THEN 'valid' ELSE 'invalid' END AS signature_state
 FROM req WHERE batch_id % 3 = 0
 UNION ALL
 SELECT seq, 'single', CASE WHEN err_code = 0 AND NOT undecodable AND NOT wrong_sig THEN 200 ELSE 400 END,
        CASE WHEN wrong_sig THEN 'invalid' WHEN seq % 5 <> 0 THEN 'valid' ELSE 'unsigned' END FROM ms
 UNION ALL
 SELECT seq, 'path', CASE WHEN NOT routed THEN 404 WHEN err_code = 0 AND NOT suffixed THEN 200 ELSE 400 END, 'unsigned' FROM mp""")
def ingest_mixed_outcomes(spark, sf_dir):
    """VAL-4 + VAL-8 on every route: the answer to each mixed request."""
    requests = mixed_requests(updates(spark, sf_dir))
    return ingest(requests, SIGNING_KEY, all_routes=True)["outcomes"].select("request_id", "route", "status", "signature_state")


@register("audit_events", q.with_(q.U, q.C, q.BODIES, REQ) + _ACC_REQ + f"""
 SELECT req.batch_id AS request_id, CAST(epoch_us(req.arrival_ts) // 1000000 AS BIGINT) AS ts,
        to_json(l.names) AS metrics_json, {q.client_ip_sql('real_ip', 'xff', 'remote_addr')} AS ip_address
 FROM req JOIN (SELECT batch_id, list(id ORDER BY pos) AS names FROM u GROUP BY batch_id) l
   ON req.batch_id = l.batch_id
 WHERE req.batch_id IN (SELECT batch_id FROM okb)""")
def audit_events(spark, sf_dir):
    """SNK-3: one audit event per accepted batch request."""
    ev = evaluate_requests(envelopes(spark, sf_dir), SIGNING_KEY)
    a = request_audit(ev)
    return a.select("request_id", "ts", F.to_json("metrics").alias("metrics_json"), "ip_address")


@register("request_log", q.with_(q.U, q.C, q.BODIES, REQ) + _ACC_REQ + """
 SELECT batch_id AS request_id, 'POST' AS method, '/updates/' AS url, '/updates/' AS path,
        NULL::VARCHAR AS host, remote_addr AS remote, 'Go-http-client/1.1' AS user_agent,
        'application/json' AS content_type, '' AS content_encoding, '' AS accept_encoding,
        COALESCE(hash, '') AS sha256, CAST(strlen(body) AS BIGINT) AS content_length,
        CAST(strlen(body) AS BIGINT) AS body_bytes, left(body, 512) AS body,
        CASE WHEN batch_id IN (SELECT batch_id FROM okb) THEN 200 ELSE 400 END AS status,
        NULL::INTEGER AS size, NULL::BIGINT AS duration_ms, CAST(arrival_ts AS DATE) AS log_date
 FROM req""")
def request_log_q(spark, sf_dir):
    """SNK-6: one log row per batch request with its outcome."""
    ev = evaluate_requests(envelopes(spark, sf_dir), SIGNING_KEY)
    return request_log(ev)


@register("audit_path_updates", q.with_(q.U) + f"""
 , p AS (SELECT *, (value IS NOT NULL OR delta IS NOT NULL) OR seq % 14 IN (0, 7) AS routed,
                seq % 14 IN (0, 7) AS suffixed FROM u)
 , ok AS (SELECT * FROM p WHERE routed AND NOT suffixed AND type IN ('gauge', 'counter')
          AND NOT (type = 'gauge' AND value IS NULL) AND NOT (type = 'counter' AND delta IS NULL))
 SELECT seq AS request_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, to_json([id]) AS metrics_json,
        {q.client_ip_sql('NULL', "CASE WHEN seq % 3 = 1 THEN '172.16.' || CAST(seq % 250 AS VARCHAR) || '.9, 10.9.9.9' END", "'10.0.' || CAST(user_id % 256 AS VARCHAR) || '.1:' || CAST(1024 + seq % 1000 AS VARCHAR)")} AS ip_address
 FROM ok""")
def audit_path_updates(spark, sf_dir):
    """SNK-3 for single updates: one audit event per accepted path request."""
    outcomes = parse_update_paths(path_requests(updates(spark, sf_dir)))
    a = single_update_audit(outcomes)
    return a.select("request_id", "ts", F.to_json("metrics").alias("metrics_json"), "ip_address")


@register("batch_names", q.with_(q.U, q.C, q.ACC) + """
 SELECT batch_id, CAST(0 AS BIGINT) AS chunk, to_json(list(id ORDER BY pos)) AS names_json
 FROM acc GROUP BY batch_id""")
def batch_names(spark, sf_dir):
    """AGG-4: ordered names of every accepted batch."""
    n = op.batch_names(accepted(spark, sf_dir))
    return n.select("batch_id", "chunk", F.to_json("names").alias("names_json"))


@register("batch_summary", q.with_(q.U, q.BODIES) + """
 SELECT batch_id, COUNT(*) AS n_rows, COUNT_IF(e LIKE '%"type":"gauge"%') AS n_gauges,
        COUNT_IF(e LIKE '%"type":"counter"%') AS n_counters,
        CAST(SUM(strlen(e)) + COUNT(*) + 1 AS BIGINT) AS json_bytes
 FROM el GROUP BY batch_id""")
def batch_summary(spark, sf_dir):
    """AGG-5: what the producer sends per batch."""
    return op.batch_summary(updates(spark, sf_dir))


@register("restore_merge", q.with_(q.U, q.C, q.ACC) + """
 , s0 AS (SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
                 ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
          FROM acc WHERE ts < {mid} GROUP BY type, id)
 , cur AS (SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
                  ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
           FROM acc WHERE ts >= {mid} GROUP BY type, id)
 , sn AS (SELECT type, id, CASE WHEN id = 'hits_click' THEN 0 ELSE delta END AS delta, value FROM s0)
 , m AS (SELECT COALESCE(cur.type, sn.type) AS type, COALESCE(cur.id, sn.id) AS id,
                CASE WHEN COALESCE(cur.type, sn.type) = 'counter' THEN
                     CASE WHEN sn.delta IS NOT NULL AND (cur.id IS NOT NULL OR sn.delta <> 0) THEN sn.delta
                          ELSE cur.delta END END AS delta,
                CASE WHEN COALESCE(cur.type, sn.type) = 'gauge' THEN COALESCE(sn.value, cur.value) END AS value
         FROM cur FULL OUTER JOIN sn ON cur.type = sn.type AND cur.id = sn.id)
 SELECT type, id, delta, value FROM m
 WHERE (type = 'counter' AND delta IS NOT NULL) OR (type = 'gauge' AND value IS NOT NULL)""".format(mid=q.MID))
def restore_merge(spark, sf_dir):
    """MRG-4: a snapshot of the first half (one counter zeroed) restored
    over the state of the second half."""
    acc = accepted(spark, sf_dir)
    cur = op.fold_state(_after(acc))
    gauges, counters = op.split_kinds(op.fold_state(_before(acc)))
    counters = counters.withColumn("value", F.when(F.col("id") == "hits_click", F.lit(0).cast("bigint"))
                                   .otherwise(F.col("value")))
    snapshot = op.union_kinds(counters, gauges).withColumn("pos", F.lit(None).cast("bigint"))
    return op.restore_merge(cur, snapshot).select("type", "id", "delta", "value")


@register("restore_array", q.with_(q.U, q.C, q.ACC) + """
 , cur AS (SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
                  ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
           FROM acc WHERE ts >= {mid} GROUP BY type, id)
 , us AS (SELECT * FROM u WHERE (type = 'gauge' AND value IS NOT NULL) OR (type = 'counter' AND delta IS NOT NULL))
 , sn AS (SELECT type, id, ARG_MAX(delta, seq) AS delta, ARG_MAX(value, seq) AS value, bool_or(delta <> 0) AS nonzero FROM us GROUP BY type, id)
 SELECT COALESCE(cur.type, sn.type) AS type, COALESCE(cur.id, sn.id) AS id,
        CASE WHEN COALESCE(cur.type, sn.type) = 'counter' THEN
             CASE WHEN sn.delta IS NOT NULL AND (cur.id IS NOT NULL OR sn.nonzero) THEN sn.delta ELSE cur.delta END END AS delta,
        CASE WHEN COALESCE(cur.type, sn.type) = 'gauge' THEN COALESCE(sn.value, cur.value) END AS value
 FROM cur FULL OUTER JOIN sn ON cur.type = sn.type AND cur.id = sn.id
 WHERE cur.id IS NOT NULL OR sn.value IS NOT NULL OR sn.nonzero""".format(mid=q.MID))
def restore_array(spark, sf_dir):
    """SRC-4 + MRG-4: the whole update log as JSON array files (names repeat,
    values are absent, kinds unknown), read by byte ranges and restored over the
    state of the second half."""
    path = f"{checkpoint_root(spark)}/restore_array-{uuid.uuid4().hex}"
    log = updates(spark, sf_dir)
    write_update_array(log, path)
    rows = read_snapshot(spark, path, whole_array=True)
    # Files are ranges of the log in the order of their numbers.
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    snapshot = rows.withColumn("pos", part * (1 << 32) + F.col("pos"))
    return op.restore_merge(op.fold_state(_after(accepted(spark, sf_dir))), snapshot).select("type", "id", "delta", "value")


@register("listing_report", q.with_(q.U, q.C, q.ACC, q.STATE) + f"""
 SELECT 0 AS section, NULL::VARCHAR AS id, 'Gauges' AS line
 UNION ALL SELECT 1, NULL, 'Counters'
 UNION ALL SELECT CASE WHEN type = 'gauge' THEN 0 ELSE 1 END, id,
                  id || ': ' || {q.metric_text('type', 'delta', 'value')} FROM st""")
def listing_report(spark, sf_dir):
    """SNK-2: the listing of the folded state."""
    return listing_lines(state(spark, sf_dir))


@register("poll_windows", """
 SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
        COUNT(*) AS poll_count, ARG_MAX(value, event_id) AS last_value
 FROM events GROUP BY user_id, date_trunc('hour', ts)""")
def poll_windows(spark, sf_dir):
    """STR-4 (batch form): polls per producer per 1-hour report window."""
    e = load_table(spark, sf_dir, "events")
    w = poll_windows_op(e, "user_id", "ts", "value", "event_id", "1 hour")
    return w.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "poll_count", "last_value")


def _read_requests(spark, sf_dir, by_path: bool):
    """Every read of ``read_requests`` as a request: in its path, or as a body
    of which every 13th is cut short and every 29th is of the wrong method."""
    rid = F.col("request_id")
    r = read_requests(load_table(spark, sf_dir, "events"))
    body = F.to_json(F.struct("id", "type"))
    path = F.concat(F.lit("/value/"), F.col("type"), F.lit("/"), F.col("id")) if by_path else F.lit("/value/")
    sent = F.lit("") if by_path else F.when(rid % 13 == 12, F.expr("substring(to_json(struct(id, type)), 2)")).otherwise(body)
    right, other = ("GET", "POST") if by_path else ("POST", "GET")
    return r.select("request_id", F.when(rid % 29 == 28, F.lit(other)).otherwise(F.lit(right)).alias("method"), path.alias("path"),
                    sent.cast("binary").alias("body"))


def _reads_sql(by_path: bool) -> str:
    bad = "FALSE" if by_path else "rq.request_id % 13 = 12"
    number = f"CASE WHEN st.type = 'gauge' THEN ',\"value\":' || CAST(st.value AS VARCHAR) ELSE ',\"delta\":' || CAST(st.delta AS VARCHAR) END"
    answer = q.metric_text("st.type", "st.delta", "st.value") if by_path else \
        f"'{{\"id\":\"' || st.id || '\",\"type\":\"' || st.type || '\"' || {number} || '}}'"
    return q.with_(q.U, q.C, q.ACC, q.STATE, q.READS) + f"""
 , x AS (SELECT rq.request_id, CASE WHEN rq.request_id % 29 = 28 THEN 405 WHEN {bad} THEN 400 WHEN rq.type NOT IN ('gauge', 'counter') THEN 400
                WHEN st.id IS NULL THEN 404 ELSE 200 END AS status, {bad} AS bad, {answer} AS answer
         FROM rq LEFT JOIN st ON rq.type = st.type AND rq.id = st.id)
 SELECT request_id, status, CASE WHEN status = 405 OR status = 200 THEN NULL WHEN bad THEN 'decode error'
        WHEN status = 400 THEN 'invalid metric type' ELSE 'metric not found' END AS err,
        CASE WHEN status = 200 THEN answer END AS response FROM x"""


@register("read_path", _reads_sql(True))
def read_path(spark, sf_dir):
    """LKP-2 over ``GET /value/{type}/{name}`` requests."""
    return op.read_responses(_read_requests(spark, sf_dir, True), state(spark, sf_dir)).select("request_id", "status", "err", "response")


@register("read_json", _reads_sql(False))
def read_json(spark, sf_dir):
    """LKP-2 over ``POST /value/`` requests with a metric object as body."""
    return op.read_responses(_read_requests(spark, sf_dir, False), state(spark, sf_dir)).select("request_id", "status", "err", "response")


# ------------------------------------------------ encodings round trips --

@register("state_map", q.with_(q.U, q.C, q.ACC, q.STATE) + " SELECT type, id, delta, value FROM st")
def state_map(spark, sf_dir):
    """AGG-6: state encoded as JSON map documents (a given number of hash
    buckets) and decoded back into rows."""
    s = state(spark, sf_dir)
    return op.documents_to_rows(op.state_documents(s, buckets=16)).select("type", "id", "delta", "value")


@register("signed_batches", q.with_(q.U, q.BODIES) + f"""
 SELECT batch_id, CAST(0 AS BIGINT) AS part, CAST(strlen(body0) AS BIGINT) AS json_bytes,
        {q.hmac_sql('encode(body0)', SIGNING_KEY)} AS hash
 FROM bb""")
def signed_batches(spark, sf_dir):
    """SNK-5: per batch the JSON array body's byte length and its HMAC."""
    return sign_batches(updates(spark, sf_dir), SIGNING_KEY).select("batch_id", "part", "json_bytes", "hash")


@register("src_gzip", q.with_(q.U, q.BODIES) + """
 SELECT batch_id, TRUE AS roundtrip_ok, CAST(strlen(body0) AS BIGINT) AS body_bytes FROM bb""")
def src_gzip(spark, sf_dir):
    """SRC-6: bodies gzipped and inflated back through the Arrow UDF."""
    b = batch_bodies(updates(spark, sf_dir), corrupt=False)
    z = b.select("batch_id", "body", deflate("body").alias("gz"))
    return z.select("batch_id", (inflate("gz").cast("string") == F.col("body")).alias("roundtrip_ok"),
                    F.octet_length("body").cast("bigint").alias("body_bytes"))


# ------------------------------------------------------------ snapshots --

def _scratch(spark, name, sf_dir):
    return f"{checkpoint_root(spark)}/{name}/{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"


@register("src_snapshot", q.with_(q.U, q.C, q.ACC, q.STATE) + " SELECT id, type, delta, value FROM st")
def src_snapshot(spark, sf_dir):
    """SRC-4: the folded state written as files of one JSON array each (the
    interchange form) and scanned back with array positions."""
    path = _scratch(spark, "snapshot_array", sf_dir)
    write_snapshot_array(state(spark, sf_dir), path)
    return read_snapshot(spark, path, whole_array=True).select("id", "type", "delta", "value")


@register("snapshot_roundtrip", q.with_(q.U, q.C, q.ACC, q.STATE) + """
 SELECT type, id, delta, value FROM st WHERE NOT (type = 'counter' AND delta = 0)""")
def snapshot_roundtrip(spark, sf_dir):
    """SNK-1 → SRC-4 → MRG-4: state saved as JSON Lines by all tasks, then
    restored into an empty store (a zero counter is not re-created).
    Non-finite gauges are written as strings, so that they come back too."""
    path = _scratch(spark, "snapshot_lines", sf_dir)
    write_snapshot(state(spark, sf_dir), path, nonfinite="string")
    empty = spark.createDataFrame([], "type string, id string, delta bigint, value double")
    return op.restore_merge(empty, read_snapshot(spark, path)).select("type", "id", "delta", "value")
