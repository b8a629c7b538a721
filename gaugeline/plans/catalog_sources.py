"""Registered plans for sources and scalar functions (SRC-*, VAL-3, FN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeline import functions as fn
from gaugeline import operators as op
from gaugeline.functions.numbers import GAUGE_TEXT_RE
from gaugeline.plans import oracle_sql as q
from gaugeline.plans.catalog import register, state, updates
from gaugeline.session import checkpoint_root
from gaugeline.sources import (batch_bodies, explode_samples, load_table, parse_batch_bodies,
                               parse_single_bodies, parse_update_paths, path_requests,
                               single_bodies, unpivot_samples)
from gaugeline.sources.state import read_state, write_state_version
from gaugeline.sources.updates import SIGNING_KEY

LONG_KEY = "k" * 100  # longer than the 64-byte block: hashed first


@register("src_batch_json", q.with_(q.U) + """
 , hb AS (SELECT batch_id, bool_or(delta IS NOT NULL) AS has_delta FROM u GROUP BY batch_id)
 , badb AS (SELECT batch_id FROM hb WHERE batch_id % 17 = 16 OR (batch_id % 17 = 15 AND has_delta))
 SELECT batch_id, pos, id, type, delta, value, TRUE AS decode_ok FROM u
 WHERE batch_id NOT IN (SELECT batch_id FROM badb)
 UNION ALL
 SELECT batch_id, NULL::INTEGER, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::DOUBLE, FALSE FROM badb""")
def src_batch_json(spark, sf_dir):
    """SRC-1: batch bodies built from the update log, decoded strictly."""
    return parse_batch_bodies(batch_bodies(updates(spark, sf_dir)), keep=["batch_id"])


@register("src_single_json", q.with_(q.U) + """
 SELECT seq, CASE WHEN seq % 17 <> 16 THEN id END AS id, CASE WHEN seq % 17 <> 16 THEN type END AS type,
        CASE WHEN seq % 17 <> 16 THEN delta END AS delta, CASE WHEN seq % 17 <> 16 THEN value END AS value,
        seq % 17 <> 16 AS decode_ok FROM u""")
def src_single_json(spark, sf_dir):
    """SRC-2: one JSON object per update, decoded strictly."""
    return parse_single_bodies(single_bodies(updates(spark, sf_dir)), keep=["seq"])


@register("src_path", q.with_(q.U) + """
 , p AS (SELECT *, (value IS NOT NULL OR delta IS NOT NULL) OR seq % 14 IN (0, 7) AS routed,
                seq % 14 IN (0, 7) AS suffixed FROM u)
 SELECT seq, CASE WHEN routed THEN type END AS type, CASE WHEN routed THEN id END AS id,
        CASE WHEN routed AND type = 'counter' AND NOT suffixed THEN delta END AS delta,
        CASE WHEN routed AND type = 'gauge' AND NOT suffixed THEN value END AS value,
        CASE WHEN NOT routed THEN 404
             WHEN type NOT IN ('gauge', 'counter') OR suffixed THEN 400
             WHEN type = 'gauge' AND value IS NULL THEN 400
             WHEN type = 'counter' AND delta IS NULL THEN 400 ELSE 200 END AS status
 FROM p""")
def src_path(spark, sf_dir):
    """SRC-3 + VAL-3: path-form updates parsed by kind."""
    return parse_update_paths(path_requests(updates(spark, sf_dir))).select(
        "seq", "type", "id", "delta", "value", "status")


_G_CORE = GAUGE_TEXT_RE.removeprefix("(?i)^").removesuffix("$")
_TEXTS = f"""
 t AS (SELECT event_id AS seq, {q.gauge_text('value')} AS g, json_extract_string(props, '$.k') AS k, event_id FROM events),
 x AS (SELECT seq, CASE event_id % 8 WHEN 0 THEN g WHEN 1 THEN '+' || g WHEN 2 THEN ' ' || g
                   WHEN 3 THEN g || 'd' WHEN 4 THEN k WHEN 5 THEN '-' || k WHEN 6 THEN k || '.0'
                   ELSE CASE WHEN event_id % 16 = 7 THEN '-Infinity' ELSE '+nan' END END AS text FROM t)"""


@register("parse_numeric", "WITH" + _TEXTS + f"""
 SELECT seq, text,
        CASE WHEN regexp_full_match(text, '{_G_CORE}', 'i')
              AND (NOT isinf(TRY_CAST(text AS DOUBLE)) OR regexp_full_match(text, '[+-]?inf(inity)?', 'i'))
             THEN TRY_CAST(text AS DOUBLE) END AS gauge_value,
        CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN TRY_CAST(text AS BIGINT) END AS counter_value
 FROM x""")
def parse_numeric(spark, sf_dir):
    """VAL-3: strict gauge and counter parsing of number texts made from events."""
    e = load_table(spark, sf_dir, "events")
    g = fn.format_gauge("value")
    k = F.get_json_object("props", "$.k")
    m = F.col("event_id") % 8
    text = (F.when(m == 0, g).when(m == 1, F.concat(F.lit("+"), g)).when(m == 2, F.concat(F.lit(" "), g))
            .when(m == 3, F.concat(g, F.lit("d"))).when(m == 4, k).when(m == 5, F.concat(F.lit("-"), k))
            .when(m == 6, F.concat(k, F.lit(".0")))
            .otherwise(F.when(F.col("event_id") % 16 == 7, F.lit("-Infinity")).otherwise(F.lit("+nan"))))
    t = e.select(F.col("event_id").alias("seq"), text.alias("text"))
    return t.select("seq", "text", fn.parse_gauge_text("text").alias("gauge_value"),
                    fn.parse_counter_text("text").alias("counter_value"))


_READINGS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("unpivot_sample", "\n UNION ALL ".join(
    [f" SELECT l_orderkey, l_linenumber, 'gauge' AS type, '{c}' AS id, NULL::BIGINT AS delta, {c} AS value FROM lineitem"
     for c in _READINGS]
    + [" SELECT l_orderkey, l_linenumber, 'counter', 'PollCount', 1::BIGINT, NULL::DOUBLE FROM lineitem"]))
def unpivot_sample(spark, sf_dir):
    """SRC-7: each lineitem row read as one wide sample of four readings."""
    li = load_table(spark, sf_dir, "lineitem")
    return unpivot_samples(li, ["l_orderkey", "l_linenumber"], _READINGS)


@register("explode_sample", """
 SELECT vec_id, 'gauge' AS type, 'CPUutilization' || CAST(i AS VARCHAR) AS id, CAST(embedding[i] AS DOUBLE) AS value
 FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)""")
def explode_sample(spark, sf_dir):
    """SRC-8: each embedding read as a per-CPU array sample."""
    return explode_samples(load_table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")


@register("state_scan", q.with_(q.U, q.C, q.ACC, q.STATE) + " SELECT type, id, delta, value FROM st")
def state_scan(spark, sf_dir):
    """SRC-5: the folded state written as a state version, scanned back."""
    root = f"{checkpoint_root(spark)}/state_scan/{sf_dir.rstrip('/').rsplit('/', 1)[-1]}"
    write_state_version(state(spark, sf_dir), root)
    return read_state(spark, root).select("type", "id", "delta", "value")


# -------------------------------------------------------------- scalars --

@register("format_gauge", f"""
 SELECT event_id, value, {q.gauge_text('value')} AS text, {q.gauge_text('-value')} AS neg_text,
        {q.gauge_text('value * 1e15')} AS big_text, {q.gauge_text('value / 1e9')} AS small_text
 FROM events""")
def format_gauge(spark, sf_dir):
    """FN-1: gauge text of every event value, negated and scaled."""
    e = load_table(spark, sf_dir, "events").select("event_id", "value")
    return e.select("event_id", "value", fn.format_gauge("value").alias("text"),
                    fn.format_gauge(-F.col("value")).alias("neg_text"),
                    fn.format_gauge(F.col("value") * 1e15).alias("big_text"),
                    fn.format_gauge(F.col("value") / 1e9).alias("small_text"))


@register("hmac_hex", f"""
 SELECT doc_id, {q.hmac_sql('encode(text)', SIGNING_KEY)} AS mac,
        {q.hmac_sql('encode(text)', LONG_KEY)} AS mac_long_key FROM documents""")
def hmac_hex(spark, sf_dir):
    """FN-3: HMAC-SHA256 of whole document texts, short and long keys."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", fn.hmac_sha256_hex("text", SIGNING_KEY).alias("mac"),
                    fn.hmac_sha256_hex("text", LONG_KEY).alias("mac_long_key"))


@register("truncate_body", """
 SELECT doc_id, CAST(strlen(text) AS BIGINT) AS body_bytes, strlen(text) > 512 AS truncated,
        left(hex(encode(text)), 1024) AS preview_hex FROM documents""")
def truncate_body(spark, sf_dir):
    """FN-6: 512-byte previews of whole documents (multi-byte text)."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.octet_length("text").cast("bigint").alias("body_bytes"),
                    (F.octet_length("text") > 512).alias("truncated"),
                    fn.byte_prefix_hex("text", 512).alias("preview_hex"))


@register("single_update_echo", q.with_(q.U) + """
 , d AS (SELECT seq, CASE WHEN seq % 17 <> 16 THEN id END AS id, CASE WHEN seq % 17 <> 16 THEN type END AS type,
                CASE WHEN seq % 17 <> 16 THEN delta END AS delta, CASE WHEN seq % 17 <> 16 THEN value END AS value,
                seq % 17 <> 16 AS decode_ok FROM u)
 , k AS (SELECT *, CASE WHEN NOT decode_ok THEN 3 WHEN type = 'gauge' AND value IS NULL THEN 1
                        WHEN type = 'counter' AND delta IS NULL THEN 1
                        WHEN type IS NULL OR type NOT IN ('gauge', 'counter') THEN 2 ELSE 0 END AS err_code FROM d)
 , ok AS (SELECT seq, id, type, value,
                 CAST(SUM(delta) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total
          FROM k WHERE err_code = 0 AND type = 'counter')
 SELECT k.seq, CASE WHEN k.err_code = 0 THEN 200 ELSE 400 END AS status,
        CASE k.err_code WHEN 1 THEN 'bad metric value' WHEN 2 THEN 'invalid metric type' WHEN 3 THEN 'decode error' END AS err,
        CASE WHEN k.err_code = 0 THEN k.id END AS id, CASE WHEN k.err_code = 0 THEN k.type END AS type,
        ok.total AS delta, CASE WHEN k.err_code = 0 AND k.type = 'gauge' THEN k.value END AS value
 FROM k LEFT JOIN ok ON k.seq = ok.seq""")
def single_update_echo(spark, sf_dir):
    """SRC-2 + VAL-4 + WIN-1/WIN-2: the response of every single-update
    request: the counter's total after it, or the gauge's stored value;
    400 with the error otherwise."""
    rows = op.classify(parse_single_bodies(single_bodies(updates(spark, sf_dir)), keep=["seq"]),
                       decode_ok="decode_ok")
    return op.update_responses(rows).select("seq", "status", "err", "id", "type", "delta", "value")
