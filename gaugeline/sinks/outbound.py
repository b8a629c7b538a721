"""Signed outbound batches (SNK-5): what the producer sends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.signing import hmac_sha256_hex
from gaugeline.sources.gzip import deflate


def signed_batches(updates: DataFrame, key: str | None, batch: str = "batch_id", pos: str = "pos",
                   max_rows: int | None = None) -> DataFrame:
    """Per batch: the JSON array body, its byte length and HMAC over the
    uncompressed JSON (null when no key is set):
    ``(batch, part, body, json_bytes, hash)``.

    A batch is one request (part 0), as in the reference.  Only with
    ``max_rows`` is a longer one sent as several (``part`` = ``pos div max_rows``).
    """
    part = (F.lit(0) if max_rows is None else F.floor(F.col(pos) / max_rows)).cast("bigint").alias("part")
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(pos), F.struct("id", "type", "delta", "value").alias("m")))),
        lambda x: x["m"])
    b = updates.groupBy(batch, part).agg(F.to_json(ordered).alias("body"))
    h = hmac_sha256_hex("body", key) if key else F.lit(None).cast("string")
    return b.select(batch, "part", "body", F.octet_length("body").cast("bigint").alias("json_bytes"), h.alias("hash"))


def write_signed_batches(batches: DataFrame, path: str) -> None:
    """Gzip each body (the request's Content-Encoding) and write rows of
    ``(batch_id, hash, gz)`` as parquet; the JSON files themselves can be
    written gzip-compressed with ``.option('compression', 'gzip')``."""
    batches.select("batch_id", "part", "hash", deflate("body").alias("gz")).write.mode("overwrite").parquet(path)
