"""Gzip-compressed bodies (SRC-6).

Files: ``*.json.gz`` are inflated by Spark's readers (codec by extension).
Columns: Spark SQL has no gzip expression, so this is the one place an
Arrow-batched pandas UDF is used; it works on whole Arrow batches and
returns null for a body that does not inflate (a rejected request).
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, functions as F


def _inflate_one(b):
    if b is None:
        return None
    try:
        return gzip.decompress(b)
    except (OSError, EOFError, zlib.error):
        return None


def _inflate_batch(s: pd.Series) -> pd.Series:
    return s.map(_inflate_one)


def _deflate_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else gzip.compress(b, mtime=0))


_UDFS: dict = {}


def _udf(name, fn):
    # Built on first use: a pandas UDF needs an active session.
    if name not in _UDFS:
        _UDFS[name] = F.pandas_udf(fn, "binary")
    return _UDFS[name]


def is_gzip(content_encoding) -> Column:
    """The request is compressed when its Content-Encoding contains 'gzip'."""
    c = F.col(content_encoding) if isinstance(content_encoding, str) else content_encoding
    return F.coalesce(F.instr(c, "gzip") > 0, F.lit(False))


def inflate(body) -> Column:
    """Binary body inflated, or null when it is not valid gzip."""
    return _udf("inflate", _inflate_batch)(F.col(body) if isinstance(body, str) else body)


def deflate(body) -> Column:
    """Gzip of a binary (or text, as UTF-8) body."""
    c = F.col(body) if isinstance(body, str) else body
    return _udf("deflate", _deflate_batch)(c.cast("binary"))
