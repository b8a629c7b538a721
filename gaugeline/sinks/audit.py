"""Audit events (SNK-3) and fan-out to several sinks (SNK-4)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.net import client_ip, header
from gaugeline.functions.text import epoch_seconds
from gaugeline.schema import H_FORWARDED_FOR, H_REAL_IP

log = logging.getLogger(__name__)


def audit_events(accepted_requests: DataFrame, names: DataFrame) -> DataFrame:
    """One event per accepted update request: ``(request_id, ts, metrics,
    ip_address)`` with ``ts`` in unix seconds and ``metrics`` the names in
    body order (an empty list for an accepted empty batch).

    ``accepted_requests``: ``(request_id, arrival_ts, headers, remote_addr)``;
    ``names``: ``(request_id, chunk, names)`` from ``batch_names``: one
    event per request, or one per chunk where the caller asked for chunks.
    """
    ip = client_ip(header("headers", H_REAL_IP), header("headers", H_FORWARDED_FOR), "remote_addr")
    ts = epoch_seconds("arrival_ts", dict(accepted_requests.dtypes)["arrival_ts"])
    r = accepted_requests.select("request_id", ts.alias("ts"), ip.alias("ip_address"))
    j = r.join(names, "request_id", "left")
    return j.select("request_id", "ts", F.coalesce("names", F.array().cast("array<string>")).alias("metrics"),
                    "ip_address")


def single_update_audit(outcomes: DataFrame, name: str = "id") -> DataFrame:
    """Audit events of single updates (path or JSON object requests): one
    event with the one name for each request answered 200.  ``outcomes``:
    ``(request_id, arrival_ts, headers, remote_addr, status, <name>)``.
    Row-local: no shuffle."""
    ip = client_ip(header("headers", H_REAL_IP), header("headers", H_FORWARDED_FOR), "remote_addr")
    ts = epoch_seconds("arrival_ts", dict(outcomes.dtypes)["arrival_ts"])
    return outcomes.filter(F.col("status") == 200).select(
        "request_id", ts.alias("ts"), F.array(F.col(name)).alias("metrics"), ip.alias("ip_address"))


def write_audit(events: DataFrame, path: str) -> None:
    """Append events as JSON Lines (``ts, metrics, ip_address``)."""
    events.select("ts", "metrics", "ip_address").write.mode("append").json(path)


def fan_out(df: DataFrame, sinks: Iterable[Callable[[DataFrame], None]]) -> list[Exception]:
    """Write ``df`` to every sink; a failing sink is logged and does not
    stop the others.  ``df`` is persisted once so sinks do not recompute it.
    Returns the errors raised by sinks."""
    errors: list[Exception] = []
    df = df.persist()
    try:
        for sink in sinks:
            try:
                sink(df)
            except Exception as e:  # noqa: BLE001 - one sink must not stop the rest
                log.error("audit sink failed: %s", e)
                errors.append(e)
    finally:
        df.unpersist()
    return errors
