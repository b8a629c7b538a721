"""Path-encoded updates ``/update/{type}/{name}/{value}`` (SRC-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.functions.numbers import parse_counter_text, parse_gauge_text
from gaugeline.schema import CODE_BAD_VALUE, CODE_INVALID_TYPE, CODE_OK, COUNTER, GAUGE

_ROUTE = r"^/update/([^/]+)/([^/]+)/([^/]+)\z"


def parse_update_paths(requests: DataFrame, path: str = "path") -> DataFrame:
    """Typed rows and outcome for path requests.

    Adds ``type, id, delta, value, err_code, status``: 404 when the path
    does not match the route, 400 for an unknown kind or a value the kind's
    strict parser rejects, 200 otherwise.  The kind decides how the value
    text is read; the other field stays null.
    """
    p = F.col(path)
    routed = F.coalesce(F.regexp_like(p, F.lit(_ROUTE)), F.lit(False))
    kind = F.when(routed, F.regexp_extract(p, _ROUTE, 1))
    name = F.when(routed, F.regexp_extract(p, _ROUTE, 2))
    text = F.when(routed, F.regexp_extract(p, _ROUTE, 3))
    out = requests.withColumns({"type": kind, "id": name, "_text": text})
    out = out.withColumns({
        "delta": F.when(F.col("type") == COUNTER, parse_counter_text("_text")),
        "value": F.when(F.col("type") == GAUGE, parse_gauge_text("_text")),
    })
    t = F.col("type")
    code = (F.when(~F.coalesce(t.isin(GAUGE, COUNTER), F.lit(False)), F.lit(CODE_INVALID_TYPE))
            .when((t == GAUGE) & F.col("value").isNull(), F.lit(CODE_BAD_VALUE))
            .when((t == COUNTER) & F.col("delta").isNull(), F.lit(CODE_BAD_VALUE))
            .otherwise(F.lit(CODE_OK)))
    status = F.when(~routed, F.lit(404)).when(code == CODE_OK, F.lit(200)).otherwise(F.lit(400))
    return out.drop("_text").withColumns({"err_code": F.when(routed, code), "status": status})
