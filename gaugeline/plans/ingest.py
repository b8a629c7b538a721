"""Write path: request rows → verified, decoded, gated updates.

gzip (optional) → signature → decode → all-or-nothing gate → fold → merge,
plus the audit event and request-log row of each request.

One request row carries one whole body (a batch, one object, or an update in
its path), so the signature check, the decode, the gate (first bad element of
the array) and the audit names are all computed inside the row: no shuffle
until the fold, whose hash partitioning on ``(type, id)`` the merge join then
reuses.  The fold's order is the request id alone: a row keeps only the last
write of each gauge of its request, and increments need no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.functions.cache import column_cache
from gaugeline.functions.net import client_ip, header
from gaugeline.functions.text import epoch_seconds
from gaugeline.operators.fold import fold_state
from gaugeline.operators.merge import merge_state
from gaugeline.operators.signature import signature_state
from gaugeline.operators.validate import error_label
from gaugeline.schema import (CODE_BAD_VALUE, CODE_DECODE, CODE_INVALID_TYPE, CODE_OK, COUNTER,
                              GAUGE, H_CONTENT_ENCODING, H_FORWARDED_FOR, H_HASH, H_REAL_IP)
from gaugeline.sources.gzip import inflate, is_gzip
from gaugeline.sources.json_body import parse_single_bodies, with_batch_array
from gaugeline.sources.path import parse_update_paths

# The update routes; a single update may also be in the path.
BATCH_ROUTES = ("/updates", "/updates/")
SINGLE_ROUTES = ("/update", "/update/")


def _element_code(m: Column) -> Column:
    t = m["type"]
    return (F.when((t == GAUGE) & m["value"].isNull(), F.lit(CODE_BAD_VALUE))
            .when((t == COUNTER) & m["delta"].isNull(), F.lit(CODE_BAD_VALUE))
            .when(~F.coalesce(t.isin(GAUGE, COUNTER), F.lit(False)), F.lit(CODE_INVALID_TYPE))
            .otherwise(F.lit(CODE_OK)))


@column_cache
def _outcome_exprs() -> tuple[Column, Column, Column]:
    """Per-element codes, first bad position and the request's code over
    the columns ``rows``, ``_codes``, ``bad_pos`` and ``decode_ok``."""
    codes = F.transform(F.col("rows"), _element_code)
    first_bad = F.array_position(F.transform(F.col("_codes"), lambda c: c != CODE_OK), True)
    bad_pos = F.when(first_bad > 0, first_bad - 1)
    code = (F.when(~F.col("decode_ok"), F.lit(CODE_DECODE))
            .when(F.col("bad_pos").isNotNull(), F.element_at("_codes", (F.col("bad_pos") + 1).cast("int")))
            .otherwise(F.lit(CODE_OK)))
    return codes, bad_pos, code


def inflate_requests(requests: DataFrame) -> DataFrame:
    """Inflate gzip bodies (binary ``body``) whose Content-Encoding says so;
    a body that does not inflate becomes null (answered 400).  The body stays
    binary: signatures are over its bytes."""
    enc = header("headers", H_CONTENT_ENCODING)
    raw = F.col("body").cast("binary")
    return requests.withColumn("body", F.when(is_gzip(enc), inflate(raw)).otherwise(raw))


def _signed(requests: DataFrame, key: str | None) -> DataFrame:
    """Add ``signature_state`` over the body's bytes and make the body text
    (bytes that are no UTF-8 become U+FFFD, as in a Go decoder)."""
    state = signature_state(F.coalesce(F.col("body").cast("binary"), F.lit(b"")), header("headers", H_HASH), key, binary=True)
    out = requests.withColumn("signature_state", state)
    if dict(requests.dtypes)["body"] == "binary":
        out = out.withColumn("body", F.make_valid_utf8(F.col("body").cast("string")))
    return out


def _outcomes(decoded: DataFrame, status=None) -> DataFrame:
    """Outcome columns over ``rows`` and ``decode_ok``.  ``status`` (null where
    the request has a route) overrules the rest."""
    codes, bad_pos, code = _outcome_exprs()
    r = decoded.withColumns({"_codes": codes}).withColumn("bad_pos", bad_pos)
    invalid_sig = F.col("signature_state") == "invalid"
    no_code = invalid_sig if status is None else invalid_sig | status.isNotNull()
    answer = F.when(invalid_sig | (F.col("err_code") != CODE_OK), F.lit(400)).otherwise(F.lit(200))
    err = F.when(invalid_sig, F.lit("invalid hash")).otherwise(error_label("err_code"))
    out = (r.withColumn("err_code", F.when(no_code, F.lit(None).cast("int")).otherwise(code))
           .withColumns({"err": err if status is None else F.when(status.isNull(), err),
                         "status": answer if status is None else F.coalesce(status, answer)})
           .drop("_codes"))
    # Emit through a generator so that filters on the outcome (accepted
    # requests) are not pushed below it with the signature and decode
    # expressions copied in.
    return out.select(F.inline(F.array(F.struct(*[F.col(c) for c in out.columns]))))


def evaluate_requests(requests: DataFrame, key: str | None) -> DataFrame:
    """Outcome of each batch request, row-local.

    Adds ``signature_state``, ``decode_ok``, ``rows`` (decoded array),
    ``err_code``/``err`` (first failing check, in middleware order: bad
    signature → 400 ``invalid hash``; undecodable → 400; first bad element),
    ``bad_pos`` and ``status``.  ``body`` may be text or bytes.
    """
    return _outcomes(with_batch_array(_signed(requests, key), "body"))


def evaluate_routes(requests: DataFrame, key: str | None) -> DataFrame:
    """``evaluate_requests`` for all update routes in one pass: batch arrays,
    single objects and updates in the path, told apart by ``path``.  Adds ``route``
    (``batch``, ``single``, ``path`` or null); ``rows`` holds one element for the
    last two.  No such route is 404, another method than POST 405."""
    cols = requests.columns
    p = F.col("path")
    route = (F.when(p.isin(*BATCH_ROUTES), F.lit("batch")).when(p.isin(*SINGLE_ROUTES), F.lit("single"))
             .when(p.startswith("/update/"), F.lit("path")))
    r = _signed(requests, key).withColumn("route", route)
    metric = lambda: F.struct(*[F.col(c).alias(c) for c in ("id", "type", "delta", "value")])
    kept = [*cols, "signature_state", "route"]
    r = parse_update_paths(r.withColumn("_path", F.when(F.col("route") == "path", p)), "_path")
    r = r.select(*kept, F.when(F.col("err_code").isNotNull(), metric()).alias("_p"))
    r = r.withColumn("_one", F.when(F.col("route") == "single", F.col("body")))
    r = parse_single_bodies(r, "_one", keep=[*kept, "_p"])
    r = r.select(*kept, "_p", F.when(F.col("decode_ok"), metric()).alias("_s"))
    r = with_batch_array(r.withColumn("_all", F.when(F.col("route") == "batch", F.col("body"))), "_all", "_rows", "_ok")
    one = F.when(F.col("route") == "single", F.col("_s")).when(F.col("route") == "path", F.col("_p"))
    rows = F.when(F.col("route") == "batch", F.col("_rows")).when(one.isNotNull(), F.array(one))
    r = r.withColumn("rows", rows).withColumn("decode_ok", F.coalesce(F.when(F.col("route") == "batch", F.col("_ok")), F.col("rows").isNotNull()))
    r = r.select(*kept, "rows", "decode_ok", F.col("_p").isNotNull().alias("_routed"))
    status = (F.when(F.col("route").isNull() | ((F.col("route") == "path") & ~F.col("_routed")), F.lit(404))
              .when(F.upper("method") != "POST", F.lit(405)))
    return _outcomes(r, status).drop("_routed")


def accepted_rows(evaluated: DataFrame) -> DataFrame:
    """Update rows of accepted requests in their order ``(request_id, pos)``:
    ``(request_id, pos, id, type, delta, value)``."""
    e = evaluated.filter(F.col("status") == 200).select("request_id", F.posexplode("rows").alias("pos", "m"))
    return e.select("request_id", "pos", "m.id", "m.type", "m.delta", "m.value")


def folded_rows(evaluated: DataFrame) -> DataFrame:
    """What a fold needs of the accepted requests: ``(request_id, id, type,
    delta, value)`` with every increment, and of each gauge the last write of its
    request.  Folded inside the row by one sort of its gauges, so a batch of any
    length needs no order but the request's."""
    gauges = F.array_sort(F.transform(
        F.filter(F.transform("rows", lambda m, i: F.struct(m["id"].alias("id"), i.alias("pos"), m["type"].alias("type"), m["value"].alias("value"))),
                 lambda g: g["type"] == GAUGE),
        lambda g: F.struct(g["id"].alias("id"), g["pos"].alias("pos"), g["value"].alias("value"))))
    ok = evaluated.filter(F.col("status") == 200).select("request_id", "rows", gauges.alias("_g"))
    last = F.filter("_g", lambda g, i: (i == F.size("_g") - 1) | ~F.get("_g", i + 1)["id"].eqNullSafe(g["id"]))
    none = F.lit(None)
    kept = F.concat(
        F.transform(last, lambda g: F.struct(g["id"].alias("id"), F.lit(GAUGE).alias("type"), none.cast("bigint").alias("delta"),
                                             g["value"].alias("value"))),
        F.transform(F.filter("rows", lambda m: m["type"] == COUNTER),
                    lambda m: F.struct(m["id"].alias("id"), F.lit(COUNTER).alias("type"), m["delta"].alias("delta"),
                                       none.cast("double").alias("value"))))
    return ok.select("request_id", F.inline(kept))


def request_audit(evaluated: DataFrame) -> DataFrame:
    """Audit event per accepted request, built inside the row:
    ``(request_id, ts, metrics, ip_address)``."""
    ip = client_ip(header("headers", H_REAL_IP), header("headers", H_FORWARDED_FOR), "remote_addr")
    ts = epoch_seconds("arrival_ts", dict(evaluated.dtypes)["arrival_ts"])
    return evaluated.filter(F.col("status") == 200).select(
        "request_id", ts.alias("ts"),
        F.transform("rows", lambda m: m["id"]).alias("metrics"), ip.alias("ip_address"))


def first_arrivals(requests: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Drop re-sent copies of a batch, keeping its first arrival (lowest
    ``request_id``).  Only ids are shuffled to find the survivors; the
    request rows (with their bodies) meet them in a semi join, which AQE
    broadcasts or skew-splits."""
    keep = requests.groupBy(batch).agg(F.min("request_id").alias("request_id"))
    return requests.join(keep, [batch, "request_id"], "left_semi")


def ingest(requests: DataFrame, key: str | None, state: DataFrame | None = None,
           dedupe_batches: bool = False, all_routes: bool = False) -> dict[str, DataFrame]:
    """The whole write path.  Returns ``outcomes`` (per request), ``rows``
    (accepted updates), ``state`` (folded, merged into ``state`` if given)
    and ``audit`` frames; nothing runs until a sink acts on them.  Requests are
    batches, or with ``all_routes`` any update route; their ids are the order of arrival.

    The service adds a re-sent batch twice (it has no idempotency key); with
    ``dedupe_batches`` a batch id is applied once (requests need ``batch_id``).
    """
    if dedupe_batches:
        requests = first_arrivals(requests)
    ev = (evaluate_routes if all_routes else evaluate_requests)(requests, key)
    rows = folded_rows(ev)
    new_state = fold_state(rows, seq="request_id") if state is None else merge_state(state, rows, seq="request_id")
    return {"outcomes": ev.drop("rows"), "rows": accepted_rows(ev), "state": new_state, "audit": request_audit(ev)}
