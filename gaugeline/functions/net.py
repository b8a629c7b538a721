"""Client address of a request (FN-4)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeline.functions.cache import column_cache

# Go's TrimSpace strips Unicode white space, not only blanks.
_SPACE = r"[\s\x{85}\p{Z}]"


@column_cache
def header(headers, name: str) -> Column:
    """Header value from a ``map<string,string>`` column, '' when absent.

    Names match case-insensitively, as HTTP header names do: the exact key
    is tried first, then any key equal ignoring case.
    """
    h = F.col(headers) if isinstance(headers, str) else headers
    lowered = name.lower()
    any_case = F.try_element_at(F.map_values(F.map_filter(h, lambda k, v: F.lower(k) == lowered)), F.lit(1))
    return F.coalesce(h.getItem(name), any_case, F.lit(""))


@column_cache
def client_ip(real_ip, forwarded_for, remote_addr) -> Column:
    """``X-Real-IP`` as is; else ``X-Forwarded-For`` up to the first comma;
    if that is empty, the remote address without what follows its last
    colon; white space trimmed at both ends."""
    def c(x):
        return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    real, xff, remote = c(real_ip), c(forwarded_for), c(remote_addr)
    first_hop = F.substring_index(xff, ",", 1)
    from_headers = F.when(real != "", real).otherwise(first_hop)
    no_port = F.regexp_replace(remote, ":[^:]*$", "")
    ip = F.when(from_headers != "", from_headers).otherwise(no_port)
    return F.regexp_replace(ip, f"^{_SPACE}+|{_SPACE}+$", "")
