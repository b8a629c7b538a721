"""Validation of metric rows and batches (VAL-1, VAL-2, VAL-4..VAL-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.functions.cache import column_cache
from gaugeline.schema import (CODE_BAD_VALUE, CODE_DECODE, CODE_INVALID_TYPE, CODE_OK, COUNTER,
                              ERR_BAD_VALUE, ERR_DECODE, ERR_INVALID_TYPE, GAUGE)


@column_cache
def kind_ok(type_col: str = "type") -> Column:
    """VAL-1: the kind is exactly 'gauge' or 'counter' (null is not)."""
    return F.coalesce(F.col(type_col).isin(GAUGE, COUNTER), F.lit(False))


@column_cache
def value_present(type_col: str = "type", delta: str = "delta", value: str = "value") -> Column:
    """VAL-2: the field the kind needs is present (zero counts as present)."""
    t = F.col(type_col)
    return ~(((t == GAUGE) & F.col(value).isNull()) | ((t == COUNTER) & F.col(delta).isNull()))


@column_cache
def row_error_code(type_col: str = "type", delta: str = "delta", value: str = "value",
                   decode_ok: str | None = None) -> Column:
    """Integer outcome of one row, checked in the service's order: missing
    gauge value, missing counter delta, then unknown kind."""
    t = F.col(type_col)
    code = (F.when((t == GAUGE) & F.col(value).isNull(), F.lit(CODE_BAD_VALUE))
            .when((t == COUNTER) & F.col(delta).isNull(), F.lit(CODE_BAD_VALUE))
            .when(~kind_ok(type_col), F.lit(CODE_INVALID_TYPE))
            .otherwise(F.lit(CODE_OK)))
    if decode_ok:
        code = F.when(~F.col(decode_ok), F.lit(CODE_DECODE)).otherwise(code)
    return code


@column_cache
def error_label(code) -> Column:
    """Message of an outcome code (null for OK)."""
    c = F.col(code) if isinstance(code, str) else code
    return (F.when(c == CODE_BAD_VALUE, F.lit(ERR_BAD_VALUE))
            .when(c == CODE_INVALID_TYPE, F.lit(ERR_INVALID_TYPE))
            .when(c == CODE_DECODE, F.lit(ERR_DECODE)))


def classify(updates: DataFrame, decode_ok: str | None = None) -> DataFrame:
    """VAL-4: add ``err_code`` (int), ``err`` (message or null), ``status``
    (200 or 400).  A narrow projection, fused into the scan's codegen stage."""
    code = row_error_code(decode_ok=decode_ok)
    return (updates.withColumn("err_code", code)
            .withColumns({"err": error_label("err_code"),
                          "status": F.when(F.col("err_code") == CODE_OK, F.lit(200)).otherwise(F.lit(400))}))


def bad_batches(classified: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Ids of batches holding at least one bad row, one row per batch, as
    column ``_bad_batch``.  Only bad rows are shuffled (with a map-side
    partial distinct), so the exchange is as small as the error rate and a
    batch full of bad rows still yields one row."""
    return (classified.filter(F.col("err_code") != CODE_OK)
            .select(F.col(batch).alias("_bad_batch")).distinct())


def _failed(batch: str) -> Column:
    # Join condition against ``bad_batches``.  The ids are compared through
    # their text form (one to one for integers): a join key that is not the
    # distinct's own partitioning column makes Spark add a plain exchange on
    # both sides, the shape AQE needs to split a hot batch (a third of all
    # rows) on the update side.  The de-duplicated side never holds more
    # than one row per batch, so it cannot be skewed itself.
    return F.col(batch).cast("string") == F.col("_bad_batch").cast("string")


def gate_batches(updates: DataFrame, batch: str = "batch_id", decode_ok: str | None = None) -> DataFrame:
    """VAL-5: keep only rows of batches in which every row is valid.

    An anti join against the failing batch ids: AQE turns it into a
    broadcast join when that set is small at run time and otherwise keeps
    a shuffle join whose skewed partitions (a hot batch) it splits.  A row
    without a batch id is a batch of its own.
    """
    c = classify(updates, decode_ok=decode_ok)
    return (c.filter(F.col("err_code") == CODE_OK).join(bad_batches(c, batch), _failed(batch), "left_anti")
            .drop("err_code", "err", "status"))


def batch_outcomes(updates: DataFrame, batch: str = "batch_id", pos: str = "pos",
                   decode_ok: str | None = None) -> DataFrame:
    """VAL-5 report: one row per batch with ``n_rows, n_bad, bad_pos, err, status``.

    ``err`` is the error of the first bad row in array order, found with a
    ``min(pos * 4 + code)`` that stays a partial/final hash aggregate.
    """
    c = classify(updates, decode_ok=decode_ok)
    bad = F.col("err_code") != CODE_OK
    agg = c.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad).alias("n_bad"),
        F.min(F.when(bad, F.coalesce(F.col(pos).cast("bigint"), F.lit(0)) * 4 + F.col("err_code"))).alias("_first"))
    return agg.select(
        batch, "n_rows", "n_bad",
        F.floor(F.col("_first") / 4).cast("bigint").alias("bad_pos"),
        error_label((F.col("_first") % 4).cast("int")).alias("err"),
        F.when(F.col("n_bad") == 0, F.lit(200)).otherwise(F.lit(400)).alias("status"))


def lenient_filter(updates: DataFrame, decode_ok: str | None = None) -> DataFrame:
    """VAL-6: apply what is valid, skip the rest (the store-level rule)."""
    c = classify(updates, decode_ok=decode_ok)
    return c.filter(F.col("err_code") == CODE_OK).drop("err_code", "err", "status")


def rejects(updates: DataFrame, decode_ok: str | None = None) -> DataFrame:
    """VAL-6 reject lane: the skipped rows with their ``err``."""
    c = classify(updates, decode_ok=decode_ok)
    return c.filter(F.col("err_code") != CODE_OK).drop("status")


def batch_lanes(updates: DataFrame, batch: str = "batch_id", decode_ok: str | None = None) -> DataFrame:
    """VAL-7: label every row ``accepted`` (its batch passed), ``salvaged``
    (batch failed, row valid: the producer re-sends it alone) or
    ``quarantined`` (row invalid).  The three lanes partition the input.

    One left join to the failing ids, skew-splittable (see ``gate_batches``).
    A row without a batch id is a batch of its own.
    """
    c = classify(updates, decode_ok=decode_ok)
    lane = (F.when(F.col("err_code") != CODE_OK, F.lit("quarantined"))
            .when(F.col("_bad_batch").isNotNull(), F.lit("salvaged")).otherwise(F.lit("accepted")))
    return c.join(bad_batches(c, batch), _failed(batch), "left").withColumn("lane", lane).drop("status", "_bad_batch")
