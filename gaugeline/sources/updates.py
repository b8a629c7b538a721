"""Metric-shaped inputs derived from the ``events`` table.

The service receives updates as requests; here the ``events`` table is read
as that request stream.  Every row becomes one update (and one read), so the
work of every plan grows with the table.  The modulo rules below do not pick
subsets: they assign each row a kind, a name and, for a few rows, a defect,
so that validation, gates and lookups meet every outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.signing import hmac_sha256_hex
from gaugeline.functions.text import format_gauge
from gaugeline.schema import (COUNTER, GAUGE, H_CONTENT_TYPE, H_FORWARDED_FOR, H_HASH,
                              H_REAL_IP, H_USER_AGENT)

# Fixed values of the derivation (shared with the DuckDB oracle text).
BATCH_ROWS = 10          # rows per batch: batch_id = event_id div 10
BAD_KIND_EVERY = 101     # event_id % 101 = 100 -> kind 'histogram'
MISSING_EVERY = 103      # event_id % 103 = 102 -> value / delta absent
UNKNOWN_KIND = "histogram"
SIGNING_KEY = "gaugeline-demo-key"


def update_log(events: DataFrame, dirty: bool = True) -> DataFrame:
    """The update log U: one metric update per event with a total order.

    ``seq`` (= event_id, unique and ascending in ``ts``) is the arrival
    order; ``batch_id``/``pos`` place the row in its request body.
    Even events are counter increments of ``hits_<event_type>``, odd events
    gauge readings of ``user_<user_id>``.  Written as one SQL projection
    (the fixture's own form): a single analysis step, fused into the scan.
    """
    bad_kind = f"WHEN event_id % {BAD_KIND_EVERY} = {BAD_KIND_EVERY - 1} THEN '{UNKNOWN_KIND}' " if dirty else ""
    present = f"AND event_id % {MISSING_EVERY} <> {MISSING_EVERY - 1}" if dirty else ""
    return events.selectExpr(
        "event_id AS seq",
        f"event_id div {BATCH_ROWS} AS batch_id",
        f"CAST(event_id % {BATCH_ROWS} AS INT) AS pos",
        f"CASE {bad_kind}WHEN event_id % 2 = 0 THEN '{COUNTER}' ELSE '{GAUGE}' END AS type",
        "CASE WHEN event_id % 2 = 0 THEN concat('hits_', event_type) "
        "ELSE concat('user_', CAST(user_id AS STRING)) END AS id",
        f"CASE WHEN event_id % 2 = 0 {present} THEN CAST(get_json_object(props, '$.k') AS BIGINT) END AS delta",
        f"CASE WHEN event_id % 2 = 1 {present} THEN value END AS value",
        "ts", "user_id", "event_type",
    )


def _metric_struct() -> F.Column:
    return F.struct("id", "type", "delta", "value")


def batch_bodies(updates: DataFrame, corrupt: bool = True) -> DataFrame:
    """One JSON array body per batch, elements in ``pos`` order.

    With ``corrupt``: batches with ``batch_id % 17 = 16`` lose their last
    character (undecodable), and ``% 17 = 15`` carry deltas as strings
    (a type error for a strict decoder).  Batch size is bounded by the
    request size, so the per-batch collect is bounded too.
    """
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), _metric_struct().alias("m")))),
        lambda x: x["m"])
    # Bodies are few bytes but costly per byte downstream (signing,
    # decoding): an explicit hash partitioning on the batch id (reused by
    # the aggregate) keeps one task per shuffle partition instead of letting
    # AQE merge them by size.
    n = int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = updates.repartition(n, "batch_id").groupBy("batch_id").agg(
        F.to_json(ordered).alias("body"),
        F.min("seq").alias("first_seq"),
        F.min("ts").alias("arrival_ts"),
        F.min("user_id").alias("user_id"))
    if corrupt:
        body = F.col("body")
        b = b.withColumn("body", F.when(F.col("batch_id") % 17 == 16, F.expr("substring(body, 1, length(body) - 1)"))
                         .when(F.col("batch_id") % 17 == 15, F.regexp_replace(body, r'"delta":(-?[0-9]+)', '"delta":"$1"'))
                         .otherwise(body))
    return b


def single_bodies(updates: DataFrame, corrupt: bool = True) -> DataFrame:
    """One JSON object body per update (the single-update request)."""
    body = F.to_json(_metric_struct())
    if corrupt:
        body = F.when(F.col("seq") % 17 == 16, F.expr("substring(to_json(struct(id, type, delta, value)), 2)")).otherwise(body)
    return updates.select("seq", "batch_id", "ts", "user_id", body.alias("body"))


def path_requests(updates: DataFrame) -> DataFrame:
    """Path-form update requests ``/update/{type}/{name}/{value}``.

    The value is the text the producer prints; every 7th event gets a
    trailing blank, every 14th (shifted by 7) a trailing ``x``, both of which
    a strict parser must reject.  An absent value leaves the segment empty.
    """
    text = F.coalesce(F.when(F.col("value").isNotNull(), format_gauge("value"))
                      .otherwise(F.col("delta").cast("string")), F.lit(""))
    seq = F.col("seq")
    text = (F.when(seq % 14 == 0, F.concat(text, F.lit(" ")))
            .when(seq % 14 == 7, F.concat(text, F.lit("x")))
            .otherwise(text))
    path = F.concat(F.lit("/update/"), F.col("type"), F.lit("/"), F.col("id"), F.lit("/"), text)
    remote = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1:"),
                      (F.lit(1024) + seq % 1000).cast("string"))
    headers = F.when(seq % 3 == 1, F.create_map(F.lit(H_FORWARDED_FOR), F.concat(
        F.lit("172.16."), (seq % 250).cast("string"), F.lit(".9, 10.9.9.9")))).otherwise(
        F.create_map().cast("map<string,string>"))
    return updates.select("seq", F.col("seq").alias("request_id"), F.col("ts").alias("arrival_ts"),
                          path.alias("path"), headers.alias("headers"), remote.alias("remote_addr"))


def request_envelopes(bodies: DataFrame, key: str = SIGNING_KEY) -> DataFrame:
    """Wrap batch bodies into request rows (REQUEST + outcome inputs).

    Address headers rotate by ``batch_id % 3``; the signature is right when
    ``batch_id % 5 <> 0``, wrong when ``% 10 = 0`` and absent otherwise.
    """
    bid = F.col("batch_id")
    remote = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1:"),
                      (F.lit(1024) + F.col("first_seq") % 1000).cast("string"))
    right = hmac_sha256_hex("body", key)
    wrong = hmac_sha256_hex(F.concat(F.col("body"), F.lit(" ")), key)
    sig = F.when(bid % 5 != 0, right).when(bid % 10 == 0, wrong)
    real_ip = F.when(bid % 3 == 0, F.concat(F.lit("192.168.0."), (bid % 250).cast("string")))
    xff = F.when(bid % 3 == 1, F.concat(F.lit(" 172.16.0."), (bid % 250).cast("string"),
                                        F.lit(", 10.9.9.9")))
    headers = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit(H_CONTENT_TYPE).alias("k"), F.lit("application/json").alias("v")),
        F.struct(F.lit(H_HASH).alias("k"), sig.alias("v")),
        F.struct(F.lit(H_REAL_IP).alias("k"), real_ip.alias("v")),
        F.struct(F.lit(H_FORWARDED_FOR).alias("k"), xff.alias("v")),
        F.struct(F.lit(H_USER_AGENT).alias("k"), F.lit("Go-http-client/1.1").alias("v")),
    ), lambda kv: kv["v"].isNotNull()))
    return bodies.select(
        F.col("batch_id").alias("request_id"), "batch_id", "arrival_ts",
        F.lit("POST").alias("method"), F.lit("/updates/").alias("path"),
        headers.alias("headers"), remote.alias("remote_addr"), "body")


def mixed_requests(updates: DataFrame, key: str = SIGNING_KEY) -> DataFrame:
    """The update log as requests of all three routes, in arrival order.

    Batches with ``batch_id % 3 = 0`` are sent whole (as ``request_envelopes``
    signs them), the rows of ``% 3 = 1`` as single objects (signed rightly
    where ``seq % 5 <> 0``, wrongly where ``% 10 = 0``, else not) and the rows
    of ``% 3 = 2`` in paths.  ``request_id`` is the seq of a request's first row
    or, for a batch, that of its first place.
    """
    kind = F.col("batch_id") % 3
    cols = ("request_id", "arrival_ts", "method", "path", "headers", "remote_addr", "body")
    whole = request_envelopes(batch_bodies(updates.where(kind == 0)), key).withColumns(
        {"request_id": F.col("batch_id") * BATCH_ROWS, "body": F.col("body").cast("binary")})
    one = single_bodies(updates.where(kind == 1))
    seq = F.col("seq")
    sig = F.when(seq % 5 != 0, hmac_sha256_hex("body", key)).when(seq % 10 == 0, hmac_sha256_hex(F.concat("body", F.lit(" ")), key))
    remote = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1:80"))
    single = one.select(
        seq.alias("request_id"), F.col("ts").alias("arrival_ts"), F.lit("POST").alias("method"),
        F.when(seq % 2 == 0, F.lit("/update/")).otherwise(F.lit("/update")).alias("path"),
        F.when(sig.isNotNull(), F.create_map(F.lit(H_HASH), sig)).otherwise(F.create_map().cast("map<string,string>")).alias("headers"),
        remote.alias("remote_addr"), F.col("body").cast("binary").alias("body"))
    path = path_requests(updates.where(kind == 2)).withColumns({"method": F.lit("POST"), "body": F.lit(b"")})
    return whole.select(*cols).unionByName(single).unionByName(path.select(*cols))


def read_requests(events: DataFrame) -> DataFrame:
    """One read request per event: ``(request_id, seq, type, id)``.

    Even events read their counter, odd events their user's gauge; every
    16th event asks for a name that is never written and every 64th uses an
    unknown kind, so lookups meet all outcomes.
    """
    return events.selectExpr(
        "event_id AS request_id", "event_id AS seq",
        f"CASE WHEN event_id % 64 = 63 THEN '{UNKNOWN_KIND}' WHEN event_id % 2 = 0 THEN '{COUNTER}' "
        f"ELSE '{GAUGE}' END AS type",
        "CASE WHEN event_id % 16 = 15 THEN concat('ghost_', CAST(user_id AS STRING)) "
        "WHEN event_id % 2 = 0 THEN concat('hits_', event_type) "
        "ELSE concat('user_', CAST(user_id AS STRING)) END AS id",
    )
