"""Running values per key: echoes and as-of state (WIN-1..WIN-3).

A plain ``Window.partitionBy(key).orderBy(seq)`` sends every row of a key
to one task; with one name carrying a third of all updates that task would
hold a third of the data.  The running aggregates here are a prefix scan over
ranges of the order instead:

1. the order of each hot key is cut into ranges of about equal row counts,
   whatever its values look like (packed, clustered, with gaps): the cuts are
   quantiles of a hash sample, found in a scalar subquery of bounded size; every
   other key is one range.  Cuts only decide where rows go, never a result;
2. rows are hash-partitioned by (key, range), the one exchange of whole rows,
   and a window computes the local running value of a range;
3. totals of the hot keys' ranges (a partial/final aggregate) get an exclusive
   prefix per key, at most ``RANGES`` rows each, and are added back by a
   join on (key, range), the partitioning that step 2 already has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeline.schema import COUNTER, GAUGE

# Rows of a key from which its order is cut, and rows a range then has at
# least.
DEFAULT_SPAN = 1 << 20
# Ranges of a hot key, and hot keys that are cut at most: the subquery's
# result is at most RANGES * RANGES numbers.
SIDE = 16
RANGES = SIDE * SIDE


def _rows_at_most(df: DataFrame) -> int:
    """Rows by the optimizer's size estimate, at eight bytes a row or more."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 8


def _cuts(df: DataFrame, keys: list[str], order: str, span: int) -> DataFrame:
    """One row, one column: map from the hash of a hot key to its cuts, SIDE
    lists of SIDE ascending orders."""
    if _rows_at_most(df) < span:
        # No key can be hot: nothing is read to find that out.
        return df.sparkSession.range(1).selectExpr("CAST(map() AS MAP<BIGINT, ARRAY<ARRAY<BIGINT>>>)")
    every = max(1, min(64, span // 1024))
    picked = df if every == 1 else df.where(F.pmod(F.xxhash64(*keys, order), F.lit(every)) == 0)
    hot = (picked.groupBy(F.xxhash64(*keys).alias("k"))
           .agg(F.count(F.lit(1)).alias("n"),
                F.percentile_approx(order, [i / RANGES for i in range(RANGES)], RANGES * 16).alias("q"))
           .where(F.col("n") * every > span).orderBy(F.col("n").desc(), "k").limit(RANGES))
    lists = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.slice("q", i * SIDE + 1, F.lit(SIDE)))
    return hot.agg(F.map_from_entries(F.collect_list(F.struct("k", lists.alias("cuts")))))


def _range_of(cuts: Column, order: Column) -> Column:
    """Number of the range an order falls in, ascending in the order; two
    levels, so 2 * SIDE comparisons."""
    i = F.size(F.filter(cuts, lambda part: part[0] <= order))
    j = F.size(F.filter(F.element_at(cuts, i), lambda cut: cut <= order))
    return F.when(cuts.isNull() | (i == 0), F.lit(0)).otherwise(i * (SIDE + 1) + j)


def running_aggregates(df: DataFrame, keys: list[str], order: str, sums: dict[str, str] | None = None,
                       lasts: dict[str, str] | None = None, span: int = DEFAULT_SPAN) -> DataFrame:
    """Add inclusive running values in ``order`` per ``keys``.

    ``sums``: {input column: output column}, running sum (null until the
    first non-null input).  ``lasts``: {input: output}, last non-null input
    so far.  ``order`` must be a unique bigint within a key.  Rows with a null
    key are a group of their own.
    """
    sums, lasts = sums or {}, lasts or {}
    cut = df.withColumn("_cuts", F.try_element_at(_cuts(df, keys, order, span).scalar(), F.xxhash64(*keys)))
    b = cut.select("*", F.col("_cuts").isNotNull().alias("_hot"),
                   F.struct(*keys, _range_of(F.col("_cuts"), F.col(order)).alias("_range")).alias("_bkt")).drop("_cuts")

    upto = Window.partitionBy("_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = b.drop("_hot").select(
        "*",
        *[F.sum(c).over(upto).alias(f"_ls_{i}") for i, c in enumerate(sums)],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"_ll_{i}") for i, c in enumerate(lasts)])

    # Totals of the hot keys' ranges: one partial row per range and task
    # crosses the network.
    totals = [F.sum(c).alias(f"_bs_{i}") for i, c in enumerate(sums)]
    totals += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_bl_{i}") for i, c in enumerate(lasts)]
    summary = b.where("_hot").groupBy("_bkt").agg(*totals)
    before = (Window.partitionBy(*[F.col("_bkt")[k] for k in keys]).orderBy(F.col("_bkt")["_range"])
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = summary.select(
        "_bkt",
        *[F.sum(f"_bs_{i}").over(before).alias(f"_os_{i}") for i, _ in enumerate(sums)],
        *[F.last(f"_bl_{i}", ignorenulls=True).over(before).alias(f"_ol_{i}") for i, _ in enumerate(lasts)])

    # A struct equals another with nulls at the same places, so a plain
    # equality keeps null keys.
    j = local.join(offsets, "_bkt", "left")
    outs = {}
    for i, out in enumerate(sums.values()):
        ls, os_ = F.col(f"_ls_{i}"), F.col(f"_os_{i}")
        outs[out] = F.when(ls.isNull() & os_.isNull(), F.lit(None)).otherwise(
            F.coalesce(os_, F.lit(0)) + F.coalesce(ls, F.lit(0)))
    for i, out in enumerate(lasts.values()):
        outs[out] = F.coalesce(F.col(f"_ll_{i}"), F.col(f"_ol_{i}"))
    return j.withColumns(outs).select(*df.columns, *[c for c in outs if c not in df.columns])


def running_sum(df: DataFrame, keys: list[str], order: str, col: str, out: str,
                span: int = DEFAULT_SPAN) -> DataFrame:
    return running_aggregates(df, keys, order, sums={col: out}, span=span)


def running_last(df: DataFrame, keys: list[str], order: str, col: str, out: str,
                 span: int = DEFAULT_SPAN) -> DataFrame:
    return running_aggregates(df, keys, order, lasts={col: out}, span=span)


def counter_echo(updates: DataFrame, seq: str = "seq", span: int = DEFAULT_SPAN) -> DataFrame:
    """WIN-1: each accepted counter update with the total right after it:
    ``(seq, id, delta, total)``."""
    c = updates.filter(F.col("type") == COUNTER).select(seq, "id", "delta")
    return running_sum(c, ["id"], seq, "delta", "total", span)


def gauge_echo(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """WIN-2: each accepted gauge update with the value the store answers.

    The store answers with the value just set, so the echo is the update's
    own value: a projection, no window and no shuffle.
    """
    return updates.filter(F.col("type") == GAUGE).select(seq, "id", "value", F.col("value").alias("echo"))


def update_responses(classified: DataFrame, seq: str = "seq", span: int = DEFAULT_SPAN) -> DataFrame:
    """WIN-1 + WIN-2: the response of every single update of a classified log:
    200 with the counter's total after it or the gauge's stored value, else the
    error and nothing more.  The running total goes over all rows, with no
    increment where a row is not an accepted counter, so nothing is joined back."""
    ok = F.col("err_code") == 0
    t = F.col("type")
    rows = classified.withColumn("_inc", F.when(ok & (t == COUNTER), F.col("delta")))
    run = running_sum(rows, ["id"], seq, "_inc", "_total", span)
    return run.select(
        *[c for c in classified.columns if c not in ("id", "type", "delta", "value")],
        F.when(ok, F.col("id")).alias("id"), F.when(ok, t).alias("type"),
        F.when(ok & (t == COUNTER), F.col("_total")).alias("delta"), F.when(ok & (t == GAUGE), F.col("value")).alias("value"))


def counter_increments(snapshots: DataFrame, snapshot_no: str = "snapshot_no") -> DataFrame:
    """WIN-3: absolute counter totals across a sequence of snapshots →
    increments ``want - previous want`` (previous 0 when the counter first
    appears).  The window holds one row per (counter, snapshot)."""
    w = Window.partitionBy("id").orderBy(snapshot_no)
    return snapshots.withColumn(
        "increment", F.col("want") - F.coalesce(F.lag("want").over(w), F.lit(0)))
