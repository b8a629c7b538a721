"""Reads against state (LKP-1..LKP-4)."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.functions.text import format_metric_value
from gaugeline.operators.echo import DEFAULT_SPAN, running_aggregates
from gaugeline.operators.validate import kind_ok
from gaugeline.schema import COUNTER, ERR_DECODE, ERR_INVALID_TYPE, ERR_NOT_FOUND, GAUGE
from gaugeline.sources.json_body import parse_single_bodies

if TYPE_CHECKING:  # that module folds and merges with this package's operators
    from gaugeline.sources.buckets import KeyedTable


# The read routes.
READ_ROUTES = ("/value", "/value/")
_READ_PATH = r"^/value/([^/]+)/([^/]+)\z"


def _outcome(found) -> tuple:
    """Kind is checked before existence: an unknown kind is 400, never 404."""
    status = F.when(~kind_ok("type"), F.lit(400)).when(~found, F.lit(404)).otherwise(F.lit(200))
    err = F.when(~kind_ok("type"), F.lit(ERR_INVALID_TYPE)).when(~found, F.lit(ERR_NOT_FOUND))
    return status, err


def bulk_lookup(requests: DataFrame, state: DataFrame) -> DataFrame:
    """LKP-2: a table of read requests ``(…, type, id)`` → value and outcome.

    Adds ``status`` (200/400/404), ``err``, ``delta``, ``value`` and the
    response ``text``.  A left join on ``(type, id)``: AQE broadcasts the
    state when it is small at run time and splits a hot requested key.
    """
    # One composite join key: the state side (one row per key) then gets
    # its own exchange even when it comes straight from a fold, so both
    # inputs are plain shuffle stages and AQE can split a hot requested key.
    # The text is made here, once for each stored metric, not for each request.
    s = state.select(_key().alias("_k"), F.col("delta").alias("_sd"), F.col("value").alias("_sv"),
                     format_metric_value("type", "delta", "value").alias("_text"), F.lit(True).alias("_found"))
    j = requests.withColumn("_k", _key()).join(s, "_k", "left").drop("_k")
    found = F.coalesce(F.col("_found"), F.lit(False))
    status, err = _outcome(found)
    return (j.withColumns({"status": status, "err": err, "delta": F.col("_sd"), "value": F.col("_sv"),
                           "text": F.col("_text")})
            .drop("_found", "_sd", "_sv", "_text"))


def _key() -> F.Column:
    # Kinds never contain NUL, so (type, id) <-> key is one-to-one; a null
    # part gives a null key, which matches nothing.
    return F.concat(F.col("type"), F.lit("\u0000"), F.col("id"))


def point_lookup(state: DataFrame, kind: str, name: str) -> DataFrame:
    """LKP-1: one ``(type, id)`` → one row with status/err/value/text.

    The equality filter reaches the state scan (partition pruning on
    ``type``, row-group statistics on ``id``)."""
    spark = state.sparkSession
    req = spark.range(1).select(F.lit(kind).alias("type"), F.lit(name).alias("id"))
    hit = state.filter((F.col("type") == kind) & (F.col("id") == name))
    return bulk_lookup(req, hit)


def stored_lookup(requests: DataFrame, table: KeyedTable, version: int | None = None) -> DataFrame:
    """LKP-2 on a stored state table: as ``bulk_lookup``, reading only the
    buckets that hold a requested key (one small job finds them)."""
    keys = requests.where(kind_ok("type") & F.col("id").isNotNull()).select("type", "id")
    return bulk_lookup(requests, table.read_for(keys, version).select("type", "id", "delta", "value"))


def stored_point(spark: SparkSession, table: KeyedTable, kind: str, name: str, version: int | None = None) -> DataFrame:
    """LKP-1 on a stored state table: the files of one bucket are read, and of
    them the row groups whose statistics and Bloom filter admit the name."""
    key = spark.sql("SELECT CAST(:t AS STRING) AS type, CAST(:i AS STRING) AS id", args={"t": kind, "i": name})
    return point_lookup(table.read_for(key, version).select("type", "id", "delta", "value"), kind, name)


def read_responses(requests: DataFrame, state: DataFrame) -> DataFrame:
    """LKP-2 from requests as they arrive: ``GET /value/{type}/{name}``
    answers with text, ``POST /value`` (or ``/value/``) with a metric object in its body answers
    with the stored metric as JSON.  Adds ``route`` (``path``, ``json`` or null), ``type``,
    ``id``, ``status``, ``err`` and ``response``; an undecodable body is 400, no such route 404,
    another method 405.  ``requests``: REQUEST rows with a text or binary body.
    """
    p = F.col("path")
    route = F.when(p.isin(*READ_ROUTES), F.lit("json")).when(F.regexp_like(p, F.lit(_READ_PATH)), F.lit("path"))
    body = F.make_valid_utf8(F.col("body").cast("string"))
    r = requests.withColumn("route", route).withColumn("_body", F.when(F.col("route") == "json", body))
    r = parse_single_bodies(r, "_body", keep=[*requests.columns, "route"]).drop("delta", "value")
    by_path = F.col("route") == "path"
    r = r.withColumns({"type": F.when(by_path, F.regexp_extract(p, _READ_PATH, 1)).otherwise(F.col("type")),
                       "id": F.when(by_path, F.regexp_extract(p, _READ_PATH, 2)).otherwise(F.col("id"))})
    r = bulk_lookup(r, state)
    wrong = F.upper("method") != F.when(by_path, F.lit("GET")).otherwise(F.lit("POST"))
    bad = (F.col("route") == "json") & ~F.col("decode_ok")
    status = (F.when(F.col("route").isNull(), F.lit(404)).when(wrong, F.lit(405)).when(bad, F.lit(400)).otherwise(F.col("status")))
    err = F.when(F.col("route").isNull() | wrong, F.lit(None)).when(bad, F.lit(ERR_DECODE)).otherwise(F.col("err"))
    kept = F.struct("id", "type", F.when(F.col("type") == COUNTER, F.col("delta")).alias("delta"),
                    F.when(F.col("type") == GAUGE, F.col("value")).alias("value"))
    text = F.when(status == 200, F.when(by_path, F.col("text")).otherwise(F.to_json(kept)))
    return r.select(*requests.columns, "route", "type", "id", status.alias("status"), err.alias("err"), text.alias("response"))


def list_all(state: DataFrame) -> DataFrame:
    """LKP-4: every stored metric with its text: ``(type, id, text)``."""
    return state.select("type", "id", format_metric_value("type", "delta", "value").alias("text"))


def asof_lookup(writes: DataFrame, reads: DataFrame, seq: str = "seq",
                span: int = DEFAULT_SPAN) -> DataFrame:
    """LKP-3: each read sees exactly the writes that arrived before it.

    ``writes``: validated updates ``(seq, type, id, delta, value)``;
    ``reads``: ``(request_id, seq, type, id)``.  A read and a write with the
    same ``seq`` count the write first.  Output per read: ``request_id,
    seq, type, id, status, err, delta, value`` (counter total / gauge value
    as of the read).
    """
    w = writes.select(F.col(seq).alias("seq"), "type", "id", "delta", "value",
                      F.lit(None).cast("bigint").alias("request_id"), F.lit(0).alias("_read"))
    r = reads.select("request_id", F.col(seq).alias("seq"), "type", "id",
                     F.lit(None).cast("bigint").alias("delta"), F.lit(None).cast("double").alias("value"),
                     F.lit(1).alias("_read"))
    log = w.unionByName(r).withColumn("_ord", F.col("seq") * 2 + F.col("_read"))
    run = running_aggregates(log, ["type", "id"], "_ord", sums={"delta": "_total"},
                             lasts={"value": "_last"}, span=span)
    answered = run.filter(F.col("_read") == 1)
    t = F.col("type")
    delta = F.when(t == COUNTER, F.col("_total"))
    value = F.when(t == GAUGE, F.col("_last"))
    found = F.coalesce(delta.isNotNull() | value.isNotNull(), F.lit(False))
    status, err = _outcome(found)
    return answered.select("request_id", "seq", "type", "id", status.alias("status"), err.alias("err"),
                           delta.alias("delta"), value.alias("value"))
