"""JSON request bodies → metric rows (SRC-1 batch arrays, SRC-2 single objects).

Decoding is strict, like a typed Go decoder: the body must be JSON, a batch
must be an array (or ``null``, an empty batch) and every element an object
(or ``null``, an empty row) whose fields have the right JSON types: ``id``
and ``type`` strings, ``delta`` an integer that fits 64 bits, ``value`` any
number.  A body failing any of this is rejected whole (``decode_ok`` false).
Lax ``from_json`` would turn a bad field into a silent null, so the body is
parsed once into a VARIANT and types are checked from it.

Key names match case-insensitively, as in a Go decoder: ``"ID"`` fills
``id``.  An exact key wins; the case-folded lookup runs only for objects
whose key list shows a non-lower-case variant of a field name.
Like a Go decoder reading one value from the body, text after the first
JSON value is ignored.  A body nested deeper than the native parser allows
(1000 levels) is rejected like any other broken one.
Documented difference: when one object holds several case variants of a
name, Go keeps the last in document order, which a VARIANT does not record
(here: the exact key, else the greatest variant).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.functions.cache import column_cache
from gaugeline.schema import METRIC


@column_cache
def _first_value(body: str, whole: str) -> Column:
    """VARIANT of the body's first JSON value.  ``whole`` (the native parse)
    already ignores text after an array, object or string; only a ``null`` with
    text glued to it is left, and is a null as well."""
    null = F.regexp_like(F.col(body), F.lit(r"^[ \t\n\r]*null"))
    return F.coalesce(F.col(whole), F.when(null, F.parse_json(F.lit("null"))))


FIELDS = ("id", "type", "delta", "value")
# A key that folds to a field name but is not spelled in lower case, as it
# appears in ``schema_of_variant`` text ("OBJECT<ID: STRING, Type: ...>").
_FOLD_RE = r"(?:<|, )(?!(?:id|type|delta|value):)(?i:id|type|delta|value):"


def _kind_and_fold(e: Column) -> tuple[Column, Column]:
    """JSON type name of an element and whether its keys need case folding."""
    kind = F.coalesce(F.schema_of_variant(e), F.lit("VOID"))
    return kind, F.coalesce(F.regexp_like(kind, F.lit(_FOLD_RE)), F.lit(False))


def _fields_from(e: Column, kind: Column, fold: Column) -> Column:
    """Struct ``(kind, id, type, delta, value)``: the element's JSON type
    name and the four fields as VARIANTs (SQL null when absent).  The map
    of keys is built only for the rare objects that need case folding."""
    m = F.when(fold, F.try_variant_get(e, "$", "map<string,variant>"))

    def pick(name):
        exact = F.try_variant_get(e, f"$.{name}", "variant")
        keys = F.filter(F.map_keys(m), lambda key: F.lower(key) == name)
        folded = F.when(F.size(keys) > 0, F.element_at(m, F.array_max(keys)))
        return F.when(exact.isNotNull() | ~fold, exact).otherwise(folded).alias(name)
    return F.struct(kind.alias("kind"), *[pick(n) for n in FIELDS])


def _array_fields(elems: Column) -> Column:
    """``_fields_from`` for every element of an ``array<variant>``: a first
    pass finds each element's kind and folding need once, a second reads
    the fields."""
    def tag(e):
        kind, fold = _kind_and_fold(e)
        return F.struct(e.alias("e"), kind.alias("k"), fold.alias("f"))
    return F.transform(F.transform(elems, tag), lambda x: _fields_from(x["e"], x["k"], x["f"]))


def _jtype(v: Column) -> Column:
    """JSON type name of a field variant ('' when the field is absent)."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _field_ok(v: Column, allowed: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> Column:
    t = _jtype(v)
    ok = t.isin("", "VOID", *allowed)
    for p in prefixes:
        ok = ok | t.startswith(p)
    return ok


def _object_ok(f: Column) -> Column:
    """An element decodes into a metric row: JSON null or a well-typed object."""
    t = f["kind"]
    well_typed = (_field_ok(f["id"], ("STRING",)) & _field_ok(f["type"], ("STRING",))
                  & _field_ok(f["delta"], ("BIGINT",))
                  & _field_ok(f["value"], ("BIGINT", "DOUBLE", "FLOAT"), ("DECIMAL",)))
    return (t == "VOID") | (t.startswith("OBJECT") & well_typed)


def _metric_of(f: Column) -> Column:
    """Typed metric struct from the field variants; absent names become ''."""
    return F.struct(
        F.coalesce(F.try_variant_get(f["id"], "$", "string"), F.lit("")).alias("id"),
        F.coalesce(F.try_variant_get(f["type"], "$", "string"), F.lit("")).alias("type"),
        F.try_variant_get(f["delta"], "$", "bigint").alias("delta"),
        F.try_variant_get(f["value"], "$", "double").alias("value"),
    )


@column_cache
def _batch_exprs(ok: str) -> tuple[Column, Column, Column]:
    """Expressions of the batch decode over the staged columns ``_v``,
    ``_top`` and ``_elems`` (built once, see ``functions.cache``)."""
    elems = _array_fields(F.try_variant_get("_v", "$", "array<variant>"))
    is_null_doc = F.col("_top") == "VOID"
    decode_ok = F.coalesce(is_null_doc | (F.col("_elems").isNotNull() & F.forall("_elems", _object_ok)),
                           F.lit(False))
    rows = (F.when(is_null_doc, F.array().cast(f"array<{METRIC.simpleString()}>"))
            .when(F.col(ok), F.transform("_elems", _metric_of)))
    return elems, decode_ok, rows


@column_cache
def _single_exprs() -> tuple[Column, Column, Column, Column, Column]:
    kind, fold = _kind_and_fold(F.col("_v"))
    fields = F.when(F.col("_v").isNotNull(), _fields_from(F.col("_v"), F.col("_k"), F.col("_fold")))
    f = F.col("_f")
    ok = F.coalesce(f.isNotNull() & _object_ok(f), F.lit(False))
    m = F.when(F.col("decode_ok"), _metric_of(f))
    return kind, fold, fields, ok, m


def with_batch_array(df: DataFrame, body: str = "body", rows: str = "rows", ok: str = "decode_ok") -> DataFrame:
    """Add ``rows`` (``array<METRIC>``; empty for a ``null`` body, null when
    decoding failed) and ``ok`` (decoded) for a batch body column.

    Staged projections: the body is parsed once into a column and every
    check reads that column (Spark does not merge projections that would
    repeat a non-trivial expression), keeping generated code small.
    """
    keep = [c for c in df.columns if c not in (rows, ok)]
    elems, decode_ok, out = _batch_exprs(ok)
    whole = df.select(*keep, body, F.try_parse_json(F.col(body)).alias("_w"))
    parsed = whole.select(*keep, _first_value(body, "_w").alias("_v"))
    shaped = parsed.select(*keep, F.schema_of_variant("_v").alias("_top"), elems.alias("_elems"))
    checked = shaped.select(*keep, "_top", "_elems", decode_ok.alias(ok))
    return checked.select(*keep, out.alias(rows), ok)


def parse_batch_bodies(bodies: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Explode batch bodies into ``(keep..., pos, id, type, delta, value, decode_ok)``.

    Array order becomes ``pos``.  A body that does not decode, or an empty
    batch, yields one row with null ``pos`` so the request is not lost.
    The work is local to each body row: no shuffle.
    """
    keep = keep if keep is not None else [c for c in bodies.columns if c != body]
    decoded = with_batch_array(bodies.select(*keep, body), body)
    exploded = decoded.select(*keep, "decode_ok", F.posexplode_outer("rows").alias("pos", "m"))
    return exploded.select(*keep, "pos", "m.id", "m.type", "m.delta", "m.value", "decode_ok")


def parse_single_bodies(bodies: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Decode single-object bodies into ``(keep..., id, type, delta, value, decode_ok)``.

    A JSON ``null`` body decodes to an empty metric (invalid kind later);
    an array or a badly typed field is a decode error.
    """
    keep = keep if keep is not None else [c for c in bodies.columns if c != body]
    kind, fold, fields_expr, ok, m = _single_exprs()
    whole = bodies.select(*keep, body, F.try_parse_json(F.col(body)).alias("_w"))
    parsed = whole.select(*keep, _first_value(body, "_w").alias("_v"))
    tagged = parsed.select(*keep, "_v", kind.alias("_k"), fold.alias("_fold"))
    fields = tagged.select(*keep, fields_expr.alias("_f"))
    checked = fields.select(*keep, "_f", ok.alias("decode_ok"))
    # Emitted through a generator: later filters on these columns (for
    # instance on the row's outcome) stay above it instead of being pushed
    # down with the decode expressions copied into every branch.
    row = F.struct(m["id"].alias("id"), m["type"].alias("type"), m["delta"].alias("delta"),
                   m["value"].alias("value"), F.col("decode_ok").alias("decode_ok"))
    return checked.select(*keep, F.inline(F.array(row)))
