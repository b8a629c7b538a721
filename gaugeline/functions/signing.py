"""HMAC-SHA256 as a native column expression (FN-3).

HMAC(K, m) = H((K' xor opad) || H((K' xor ipad) || m)) with K' the key
padded to the 64-byte block (or hashed first when longer).  The two padded
keys depend only on the key, so they are built once on the driver and enter
the plan as binary literals; the per-row work is two ``sha2`` calls.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from gaugeline.functions.cache import column_cache

_BLOCK = 64  # SHA-256 block size in bytes


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer padded keys for ``key``."""
    k = key.encode("utf-8")
    if len(k) > _BLOCK:
        k = hashlib.sha256(k).digest()
    k = k.ljust(_BLOCK, b"\x00")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


@column_cache
def hmac_sha256_hex(body, key: str, binary: bool = False) -> Column:
    """Lower-case hex HMAC-SHA256 of ``body``.

    ``body`` is text (hashed as UTF-8) unless ``binary=True``.
    """
    b = F.col(body) if isinstance(body, str) else body
    payload = b if binary else F.encode(b, "UTF-8")
    ipad, opad = hmac_pads(key)
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad.hex())), payload), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad.hex())), inner), 256)
