"""Query catalog: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the
matching DuckDB text ``ORACLES[name]``.

Every query reads whole tables of the data set (mostly ``events`` through
the update log) so its work grows with them.  Column names and types are
the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gaugeline import operators as op
from gaugeline.operators.validate import kind_ok, value_present
from gaugeline.plans import oracle_sql as q
from gaugeline.sources import load_table, read_requests, update_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed split point of the 30-day event range: state before, updates after.
MID = "2024-01-16 00:00:00"
U_COLS = ["seq", "batch_id", "pos", "type", "id", "delta", "value"]


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def updates(spark: SparkSession, sf_dir: str, dirty: bool = True) -> DataFrame:
    return update_log(load_table(spark, sf_dir, "events"), dirty=dirty)


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.gate_batches(updates(spark, sf_dir))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fold_state(accepted(spark, sf_dir))


def _before(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ts") < F.lit(MID).cast("timestamp_ntz"))


def _after(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ts") >= F.lit(MID).cast("timestamp_ntz"))


# ---------------------------------------------------------------- folds --

@register("metric_state", q.with_(q.U, q.C, q.ACC, q.STATE) + " SELECT type, id, delta, value FROM st")
def metric_state(spark, sf_dir):
    """AGG-3 flagship: validated, gated update log folded into state."""
    return state(spark, sf_dir).select("type", "id", "delta", "value")


@register("counter_total", q.with_(q.U, q.C, q.ACC) + """
 SELECT id, CAST(SUM(delta) AS BIGINT) AS value FROM acc WHERE type = 'counter' GROUP BY id""")
def counter_total(spark, sf_dir):
    return op.counter_totals(accepted(spark, sf_dir))


@register("gauge_latest", q.with_(q.U, q.C, q.ACC) + """
 SELECT id, ARG_MAX(value, seq) AS value FROM acc WHERE type = 'gauge' GROUP BY id""")
def gauge_latest(spark, sf_dir):
    return op.gauge_latest(accepted(spark, sf_dir))


# ----------------------------------------------------------- validation --

@register("val_kind", q.with_(q.U) + """
 SELECT seq, type, COALESCE(type IN ('gauge', 'counter'), FALSE) AS kind_ok FROM u""")
def val_kind(spark, sf_dir):
    return updates(spark, sf_dir).select("seq", "type", kind_ok().alias("kind_ok"))


@register("val_presence", q.with_(q.U) + """
 SELECT seq, type, NOT ((type = 'gauge' AND value IS NULL) OR (type = 'counter' AND delta IS NULL))
        AS present FROM u""")
def val_presence(spark, sf_dir):
    return updates(spark, sf_dir).select("seq", "type", value_present().alias("present"))


@register("classify_updates", q.with_(q.U, q.C) + f"""
 SELECT seq, batch_id, pos, type, id, err_code, {q.ERR_LABEL.format(c='err_code')} AS err,
        CASE WHEN err_code = 0 THEN 200 ELSE 400 END AS status FROM c""")
def classify_updates(spark, sf_dir):
    return op.classify(updates(spark, sf_dir)).select(
        "seq", "batch_id", "pos", "type", "id", "err_code", "err", "status")


@register("batch_gate", q.with_(q.U, q.C, q.ACC) + """
 SELECT seq, batch_id, pos, type, id, delta, value FROM acc""")
def batch_gate(spark, sf_dir):
    """VAL-5: rows of batches in which every row is valid."""
    return accepted(spark, sf_dir).select(*U_COLS)


@register("batch_errors", q.with_(q.U, q.C) + f"""
 , g AS (SELECT batch_id, COUNT(*) AS n_rows, COUNT_IF(err_code <> 0) AS n_bad,
               MIN(CASE WHEN err_code <> 0 THEN CAST(pos AS BIGINT) * 4 + err_code END) AS f
        FROM c GROUP BY batch_id)
 SELECT batch_id, n_rows, n_bad, CAST(f // 4 AS BIGINT) AS bad_pos,
        {q.ERR_LABEL.format(c='CAST(f % 4 AS INTEGER)')} AS err,
        CASE WHEN n_bad = 0 THEN 200 ELSE 400 END AS status FROM g""")
def batch_errors(spark, sf_dir):
    return op.batch_outcomes(updates(spark, sf_dir))


@register("lenient_filter", q.with_(q.U, q.C) + """
 SELECT seq, batch_id, pos, type, id, delta, value FROM c WHERE err_code = 0""")
def lenient_filter(spark, sf_dir):
    return op.lenient_filter(updates(spark, sf_dir)).select(*U_COLS)


@register("rejects", q.with_(q.U, q.C) + f"""
 SELECT seq, batch_id, type, id, err_code, {q.ERR_LABEL.format(c='err_code')} AS err FROM c WHERE err_code <> 0""")
def rejects(spark, sf_dir):
    return op.rejects(updates(spark, sf_dir)).select("seq", "batch_id", "type", "id", "err_code", "err")


@register("batch_lanes", q.with_(q.U, q.C) + f"""
 , bad AS (SELECT DISTINCT batch_id FROM c WHERE err_code <> 0)
 SELECT seq, batch_id, pos, type, id,
        CASE WHEN batch_id NOT IN (SELECT batch_id FROM bad) THEN 'accepted'
             WHEN err_code = 0 THEN 'salvaged' ELSE 'quarantined' END AS lane,
        {q.ERR_LABEL.format(c='err_code')} AS err FROM c""")
def batch_lanes(spark, sf_dir):
    """VAL-7: accepted / salvaged / quarantined lanes."""
    return op.batch_lanes(updates(spark, sf_dir)).select("seq", "batch_id", "pos", "type", "id", "lane", "err")


@register("salvage_state", q.with_(q.U, q.C) + """
 SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
        ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
 FROM c WHERE err_code = 0 GROUP BY type, id""")
def salvage_state(spark, sf_dir):
    """VAL-7 on state: accepted batches, and after each the salvaged rows of failed ones."""
    return op.salvage_fold(op.batch_lanes(updates(spark, sf_dir))).select("type", "id", "delta", "value")


# --------------------------------------------------------------- merges --

_SPLIT = """
 , s0 AS (SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
                 ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
          FROM acc WHERE ts < {mid} GROUP BY type, id)
 , n0 AS (SELECT type, id, CAST(SUM(CASE WHEN type = 'counter' THEN delta END) AS BIGINT) AS delta,
                 ARG_MAX(CASE WHEN type = 'gauge' THEN value END, seq) AS value
          FROM acc WHERE ts >= {mid} GROUP BY type, id)""".format(mid=q.MID)


@register("merge_state", q.with_(q.U, q.C, q.ACC) + _SPLIT + """
 SELECT COALESCE(s0.type, n0.type) AS type, COALESCE(s0.id, n0.id) AS id,
        CASE WHEN COALESCE(s0.type, n0.type) = 'counter'
             THEN COALESCE(s0.delta, 0) + COALESCE(n0.delta, 0) END AS delta,
        CASE WHEN COALESCE(s0.type, n0.type) = 'gauge' THEN COALESCE(n0.value, s0.value) END AS value
 FROM s0 FULL OUTER JOIN n0 ON s0.type = n0.type AND s0.id = n0.id""")
def merge_state(spark, sf_dir):
    """MRG-3: state folded from the first half, updates from the second."""
    acc = accepted(spark, sf_dir)
    return op.merge_state(op.fold_state(_before(acc)), _after(acc)).select("type", "id", "delta", "value")


@register("merge_gauges", q.with_(q.U, q.C, q.ACC) + _SPLIT + """
 SELECT COALESCE(s.id, n.id) AS id, COALESCE(n.value, s.value) AS value
 FROM (SELECT id, value FROM s0 WHERE type = 'gauge') s
 FULL OUTER JOIN (SELECT id, value FROM n0 WHERE type = 'gauge') n ON s.id = n.id""")
def merge_gauges(spark, sf_dir):
    acc = accepted(spark, sf_dir)
    old = op.gauge_latest(_before(acc))
    return op.merge_gauges(old, _after(acc))


@register("merge_counters", q.with_(q.U, q.C, q.ACC) + _SPLIT + """
 SELECT COALESCE(s.id, n.id) AS id, COALESCE(s.delta, 0) + COALESCE(n.delta, 0) AS value
 FROM (SELECT id, delta FROM s0 WHERE type = 'counter') s
 FULL OUTER JOIN (SELECT id, delta FROM n0 WHERE type = 'counter') n ON s.id = n.id""")
def merge_counters(spark, sf_dir):
    acc = accepted(spark, sf_dir)
    old = op.counter_totals(_before(acc))
    return op.merge_counters(old, _after(acc))


# -------------------------------------------------------------- echoes --

@register("counter_echo", q.with_(q.U, q.C, q.ACC) + """
 SELECT seq, id, delta, CAST(SUM(delta) OVER (PARTITION BY id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total
 FROM acc WHERE type = 'counter'""")
def counter_echo(spark, sf_dir):
    """WIN-1: running counter total after each accepted increment."""
    return op.counter_echo(accepted(spark, sf_dir)).select("seq", "id", "delta", "total")


@register("gauge_echo", q.with_(q.U, q.C, q.ACC) + """
 SELECT seq, id, value, value AS echo FROM acc WHERE type = 'gauge'""")
def gauge_echo(spark, sf_dir):
    return op.gauge_echo(accepted(spark, sf_dir))


@register("counter_increments", q.with_(q.U, q.C, q.ACC) + """
 , d AS (SELECT id, CAST(ts AS DATE) AS day, SUM(delta) AS s FROM acc WHERE type = 'counter' GROUP BY id, CAST(ts AS DATE))
 , w AS (SELECT id, day, CAST(SUM(s) OVER (PARTITION BY id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS want FROM d)
 SELECT id, CAST(day AS VARCHAR) AS snapshot_no, want,
        want - COALESCE(LAG(want) OVER (PARTITION BY id ORDER BY day), 0) AS increment FROM w""")
def counter_increments(spark, sf_dir):
    """WIN-3: daily absolute snapshots of each counter → increments."""
    acc = accepted(spark, sf_dir).filter(F.col("type") == "counter")
    daily = acc.groupBy("id", F.to_date("ts").alias("day")).agg(F.sum("delta").alias("s"))
    w = Window.partitionBy("id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    snaps = daily.select("id", F.col("day").cast("string").alias("snapshot_no"), F.sum("s").over(w).alias("want"))
    return op.counter_increments(snaps).select("id", "snapshot_no", "want", "increment")


# ------------------------------------------------------------- lookups --

@register("asof_lookup", q.with_(q.U, q.C, q.ACC, q.READS) + """
 , lg AS (SELECT seq * 2 AS o, type, id, delta, value, NULL::BIGINT AS request_id, seq FROM acc
          UNION ALL SELECT seq * 2 + 1, type, id, NULL, NULL, request_id, seq FROM rq)
 , r AS (SELECT *, SUM(delta) OVER w AS tot, LAST_VALUE(value IGNORE NULLS) OVER w AS lst FROM lg
         WINDOW w AS (PARTITION BY type, id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 , a AS (SELECT request_id, seq, type, id,
                CASE WHEN type = 'counter' THEN CAST(tot AS BIGINT) END AS delta,
                CASE WHEN type = 'gauge' THEN lst END AS value
         FROM r WHERE request_id IS NOT NULL)
 SELECT request_id, seq, type, id,
        CASE WHEN type NOT IN ('gauge', 'counter') THEN 400 WHEN delta IS NULL AND value IS NULL THEN 404 ELSE 200 END AS status,
        CASE WHEN type NOT IN ('gauge', 'counter') THEN 'invalid metric type'
             WHEN delta IS NULL AND value IS NULL THEN 'metric not found' END AS err,
        delta, value FROM a""")
def asof_lookup(spark, sf_dir):
    """LKP-3: every read sees the accepted writes that arrived before it."""
    reads = read_requests(load_table(spark, sf_dir, "events"))
    return op.asof_lookup(accepted(spark, sf_dir), reads)


@register("bulk_lookup", q.with_(q.U, q.C, q.ACC, q.STATE, q.READS) + f"""
 SELECT rq.request_id, rq.type, rq.id,
        CASE WHEN rq.type NOT IN ('gauge', 'counter') THEN 400 WHEN st.id IS NULL THEN 404 ELSE 200 END AS status,
        CASE WHEN rq.type NOT IN ('gauge', 'counter') THEN 'invalid metric type'
             WHEN st.id IS NULL THEN 'metric not found' END AS err,
        CASE WHEN st.id IS NOT NULL THEN {q.metric_text('st.type', 'st.delta', 'st.value')} END AS text
 FROM rq LEFT JOIN st ON rq.type = st.type AND rq.id = st.id""")
def bulk_lookup(spark, sf_dir):
    """LKP-2: a read for every event against the folded state."""
    reads = read_requests(load_table(spark, sf_dir, "events"))
    return op.bulk_lookup(reads, state(spark, sf_dir)).select("request_id", "type", "id", "status", "err", "text")


@register("point_lookup", q.with_(q.U, q.C, q.ACC, q.STATE) + f"""
 , k AS (SELECT 'counter' AS type, 'hits_view' AS id)
 SELECT k.type, k.id, CASE WHEN st.id IS NULL THEN 404 ELSE 200 END AS status,
        CASE WHEN st.id IS NULL THEN 'metric not found' END AS err, st.delta, st.value,
        CASE WHEN st.id IS NOT NULL THEN {q.metric_text('st.type', 'st.delta', 'st.value')} END AS text
 FROM k LEFT JOIN st ON k.type = st.type AND k.id = st.id""")
def point_lookup(spark, sf_dir):
    """LKP-1: one counter's total out of the folded state."""
    return op.point_lookup(state(spark, sf_dir), "counter", "hits_view").select(
        "type", "id", "status", "err", "delta", "value", "text")


@register("list_all", q.with_(q.U, q.C, q.ACC, q.STATE) + f"""
 SELECT type, id, {q.metric_text('type', 'delta', 'value')} AS text FROM st""")
def list_all(spark, sf_dir):
    return op.list_all(state(spark, sf_dir))


# -------------------------------------------------------------- set ops --

@register("union_kinds", q.with_(q.U, q.C, q.ACC, q.STATE) + """
 SELECT id, type, delta, value FROM st""")
def union_kinds(spark, sf_dir):
    """SET-1 over SET-2: split the state into typed tables and tag them back."""
    gauges, counters = op.split_kinds(state(spark, sf_dir))
    return op.union_kinds(counters, gauges).select("id", "type", "delta", "value")


@register("split_kinds", q.with_(q.U, q.C, q.ACC, q.STATE) + """
 SELECT id, value FROM st WHERE type = 'gauge'""")
def split_kinds(spark, sf_dir):
    """SET-2, gauge half."""
    return op.split_kinds(state(spark, sf_dir))[0]


@register("split_kinds_counters", q.with_(q.U, q.C, q.ACC, q.STATE) + """
 SELECT id, delta AS value FROM st WHERE type = 'counter'""")
def split_kinds_counters(spark, sf_dir):
    """SET-2, counter half."""
    return op.split_kinds(state(spark, sf_dir))[1]
