"""Text renderings of metric values and log previews (FN-1, FN-2, FN-5, FN-6)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeline.functions.cache import column_cache
from gaugeline.schema import COUNTER, GAUGE

# Java's shortest-repr text of |v|: integer digits, fraction digits and an
# optional exponent ("123.456", "1.0E-7", "1.0E21").
_JAVA_DOUBLE_RE = r"^([0-9]+)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bind(value: Column, body) -> Column:
    """Evaluate ``body(x)`` with ``x`` bound to ``value`` once (a one-element
    array through ``transform``), instead of repeating ``value``'s tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _exact_batch(s):
    import numpy as np
    import pandas as pd
    out = pd.Series(None, index=s.index, dtype=object)
    need = s.notna()  # nearly all rows arrive null: only the rare ones are formatted
    if need.any():
        out[need] = [np.format_float_positional(x, unique=True, trim="-") for x in s[need]]
    return out


_EXACT = {}


def _exact_udf():
    # Built on first use: a pandas UDF needs an active session.
    if "f" not in _EXACT:
        _EXACT["f"] = F.pandas_udf(_exact_batch, "string")
    return _EXACT["f"]


@column_cache
def format_gauge(c, exact: bool = True) -> Column:
    """Gauge text the way the service prints it (FN-1).

    Shortest round-trip digits in positional notation, never an exponent,
    no trailing ``.0``; ``NaN``, ``+Inf``, ``-Inf`` and ``-0`` spelled out.

    The digits come from Spark's double-to-string (JVM-side string
    expressions, moved to positional form).  Java 17 sometimes prints one
    or two digits more than the shortest form, only when it prints 16 or
    more digits, and for subnormals; with ``exact`` those rare values (and
    only those; all other rows pass a null) go through an Arrow-batched
    shortest-digits routine.
    """
    v = _col(c)
    s = F.abs(v).cast("string")
    exp_text = F.regexp_extract(s, _JAVA_DOUBLE_RE, 3)
    parts = F.struct(
        F.concat(F.regexp_extract(s, _JAVA_DOUBLE_RE, 1), F.regexp_extract(s, _JAVA_DOUBLE_RE, 2)).alias("d"),
        (F.length(F.regexp_extract(s, _JAVA_DOUBLE_RE, 1))
         + F.when(exp_text == "", F.lit(0)).otherwise(exp_text.cast("int"))).alias("p"))

    def positional(x):
        d, p = x["d"], x["p"]
        return (F.when(p <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
                .when(p >= F.length(d), F.rpad(d, p, "0"))
                .otherwise(F.concat(F.substring(d, F.lit(1), p), F.lit("."),
                                    F.substring(d, p + 1, F.length(d)))))

    def trim(t):
        return F.when(F.instr(t, ".") > 0,
                      F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")).otherwise(t)

    body = _bind(parts, lambda x: _bind(positional(x), trim))
    negative = F.startswith(v.cast("string"), F.lit("-"))
    native = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), body)
    if exact:
        # Subnormals too: with so few significant bits Java keeps a second
        # digit ("4.9E-324") where one suffices.
        long_digits = F.length(F.regexp_replace(s, r"[^0-9]|E.*$", "")) >= 16
        subnormal = (F.abs(v) < F.lit(2.2250738585072014e-308)) & (v != 0)
        native = F.coalesce(_exact_udf()(F.when((long_digits | subnormal) & ~F.isnan(v), v)), native)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(v), F.lit("NaN"))
            .when(v == float("inf"), F.lit("+Inf"))
            .when(v == float("-inf"), F.lit("-Inf"))
            .otherwise(native))


@column_cache
def format_counter(c) -> Column:
    """Counter text: base-10 integer (FN-2)."""
    return _col(c).cast("string")


@column_cache
def format_metric_value(kind, delta, value) -> Column:
    """Text of a stored metric: gauge value or counter total by kind."""
    k = _col(kind)
    return (F.when(k == GAUGE, format_gauge(value))
            .when(k == COUNTER, format_counter(delta)))


@column_cache
def byte_prefix_hex(c, n: int) -> Column:
    """Hex of the first ``n`` UTF-8 bytes of a string (exact byte cut)."""
    return F.hex(F.substring(F.encode(_col(c), "UTF-8"), 1, n))


@column_cache
def truncate_bytes(c, n: int, marker: str | None = None) -> Column:
    """First ``n`` bytes of the UTF-8 text (FN-6).

    The cut is by bytes, like slicing a Go string; a character split by the
    cut becomes U+FFFD so the result is valid text.  ``marker`` is appended
    only when something was cut (the producer appends ``...(truncated)``).
    """
    s = _col(c)
    raw = F.encode(s, "UTF-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, n).cast("string"))
    over = F.octet_length(s) > n
    out = F.when(over, cut).otherwise(s)
    if marker:
        out = F.when(over, F.concat(cut, F.lit(marker))).otherwise(s)
    return out


@column_cache
def mask_hash(c) -> Column:
    """Hide a secret: first 10 bytes and an ellipsis when longer (FN-5)."""
    s = _col(c)
    # The cut length and the ellipsis character.
    keep, ellipsis = 10, "…"
    return (F.when(s.isNull() | (s == ""), F.lit(""))
            .when(F.octet_length(s) <= keep, s)
            .otherwise(F.concat(truncate_bytes(s, keep), F.lit(ellipsis))))


@column_cache
def epoch_seconds(name: str, dtype: str) -> Column:
    """Unix seconds of the timestamp column ``name``, independent of the
    session time zone for naive (``timestamp_ntz``) values, read as UTC."""
    if dtype == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_seconds(F.col(name))
