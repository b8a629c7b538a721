"""Signature check of request bodies (VAL-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.functions.cache import column_cache
from gaugeline.functions.signing import hmac_sha256_hex


@column_cache
def signature_state(body, presented, key: str | None, binary: bool = False) -> Column:
    """'unsigned' when no key is configured or no hash is presented, else
    'valid' / 'invalid' by exact comparison with the lower-case hex HMAC.
    ``body`` is text, or bytes with ``binary``."""
    p = F.col(presented) if isinstance(presented, str) else presented
    if not key:
        return F.lit("unsigned")
    return (F.when(p.isNull() | (p == ""), F.lit("unsigned"))
            .when(p == hmac_sha256_hex(body, key, binary), F.lit("valid"))
            .otherwise(F.lit("invalid")))


def verify_signatures(requests: DataFrame, key: str | None, body: str = "body",
                      hash_col: str = "hash", keep_invalid: bool = True) -> DataFrame:
    """Add ``signature_state``; with ``keep_invalid=False`` drop invalid rows
    (the service answers them 400 before decoding)."""
    out = requests.withColumn("signature_state", signature_state(body, hash_col, key))
    return out if keep_invalid else out.filter(F.col("signature_state") != "invalid")
