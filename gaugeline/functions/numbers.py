"""Strict number text (VAL-3): what a Go ``ParseFloat`` / ``ParseInt(s, 10, 64)`` accepts.

Spark's cast alone is too lax (it trims blanks, takes ``1.5d`` suffixes and
turns ``1e400`` into Infinity), so an anchored pattern decides the syntax
and ``try_cast`` does the conversion.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeline.functions.cache import column_cache

# Fixed syntax of accepted gauge text, case-insensitive and anchored:
# signed inf/infinity, unsigned nan, signed decimal with optional exponent,
# signed hexadecimal float with a mandatory binary exponent.
GAUGE_TEXT_RE = (
    r"(?i)^(?:[+-]?inf(?:inity)?"
    r"|nan"
    r"|[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"
    r"|[+-]?0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?[0-9]+)\z"
)
# Fixed syntax of accepted counter text: optional sign, base-10 digits.
COUNTER_TEXT_RE = r"^[+-]?[0-9]+\z"
_INF_TEXT_RE = r"(?i)^[+-]?inf(?:inity)?\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@column_cache
def parse_gauge_text(c) -> Column:
    """Double from strict gauge text, or null when the text is rejected.

    Out-of-range decimals (``1e400``) are rejected, as a range error is;
    infinity is accepted only when the text spells it.
    """
    s = _col(c)
    parsed = s.try_cast("double")
    ok_syntax = F.coalesce(F.regexp_like(s, F.lit(GAUGE_TEXT_RE)), F.lit(False))
    spelled_inf = F.coalesce(F.regexp_like(s, F.lit(_INF_TEXT_RE)), F.lit(False))
    infinite = parsed.isin(float("inf"), float("-inf"))
    return F.when(ok_syntax & (~infinite | spelled_inf), parsed)


@column_cache
def parse_counter_text(c) -> Column:
    """Bigint from strict base-10 text, or null (blanks, fractions, overflow)."""
    s = _col(c)
    ok_syntax = F.coalesce(F.regexp_like(s, F.lit(COUNTER_TEXT_RE)), F.lit(False))
    return F.when(ok_syntax, s.try_cast("bigint"))
