"""Request-log rows (SNK-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.net import header
from gaugeline.functions.text import truncate_bytes
from gaugeline.schema import (H_ACCEPT_ENCODING, H_CONTENT_ENCODING, H_CONTENT_LENGTH, H_CONTENT_TYPE, H_HASH,
                              H_USER_AGENT)

# Fixed value: bytes of body kept in a log row.
MAX_LOGGED_BODY = 512


def request_log(requests: DataFrame, status: str = "status") -> DataFrame:
    """The 16 fields of a request-log record from REQUEST rows plus their
    outcome ``status``.  The body is cut at 512 bytes; ``body_bytes`` is
    the full length, ``content_length`` the one the header declares.  ``host``, ``size`` and ``duration_ms`` are not in the
    request table and stay null."""
    def h(name):
        return header("headers", name)
    n = F.octet_length("body").cast("bigint")
    # The header's length is that of the body as sent (compressed, say); without
    # a usable header it is the body's own.
    declared = F.coalesce(h(H_CONTENT_LENGTH).try_cast("bigint"), n)
    return requests.select(
        "request_id",
        F.col("method"), F.col("path").alias("url"), F.col("path"),
        F.lit(None).cast("string").alias("host"), F.col("remote_addr").alias("remote"),
        h(H_USER_AGENT).alias("user_agent"), h(H_CONTENT_TYPE).alias("content_type"),
        h(H_CONTENT_ENCODING).alias("content_encoding"), h(H_ACCEPT_ENCODING).alias("accept_encoding"),
        h(H_HASH).alias("sha256"), declared.alias("content_length"), n.alias("body_bytes"),
        truncate_bytes("body", MAX_LOGGED_BODY).alias("body"),
        F.col(status).alias("status"), F.lit(None).cast("int").alias("size"),
        F.lit(None).cast("bigint").alias("duration_ms"),
        F.to_date("arrival_ts").alias("log_date"))


def write_request_log(log: DataFrame, path: str) -> None:
    """Append log rows partitioned by day (``log_date``)."""
    log.write.mode("append").partitionBy("log_date").parquet(path)

