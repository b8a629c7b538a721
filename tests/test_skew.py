"""Hot keys: one name or one batch carrying a third of all rows.

With broadcasts disabled and tiny skew thresholds, AQE must split the hot
partitions of the shuffle joins; results must not change.
"""

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from gaugeline import operators as op
from tests.conftest import metric_rows

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _log(spark, n=6000):
    rnd = random.Random(11)
    rows = []
    for seq in range(n):
        hot = seq % 3 == 0
        name = "hot" if hot else f"k{rnd.randrange(50)}"
        kind = "counter" if seq % 2 == 0 else "gauge"
        batch = 0 if hot else 1 + seq // 10  # one batch holds a third of the rows
        bad = seq % 97 == 5
        rows.append((seq, batch, seq, name, kind if not bad else "bogus",
                     seq % 7 if kind == "counter" else None, float(seq) if kind == "gauge" else None))
    return metric_rows(spark, rows)


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _plan_text(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_skewed_gate_and_lookups(spark):
    log = _log(spark)
    state = op.fold_state(op.gate_batches(log))
    reads = log.select(F.col("seq").alias("request_id"), "seq", "type", "id")
    cols_state = ["type", "id", "delta", "value"]
    cols_read = ["request_id", "status", "delta", "value"]
    expected_state = _rows(state, cols_state)
    expected_lookup = _rows(op.bulk_lookup(reads, state), ["request_id", "status", "text"])
    expected_asof = _rows(op.asof_lookup(op.gate_batches(log), reads, span=64), cols_read)
    with conf(spark, SKEW_CONF):
        gated_state = op.fold_state(op.gate_batches(log))
        assert _rows(gated_state, cols_state) == expected_state
        bl = op.bulk_lookup(reads, op.fold_state(op.gate_batches(log)))
        assert _rows(bl, ["request_id", "status", "text"]) == expected_lookup
        assert "SortMergeJoin(skew=true)" in _plan_text(bl)
        asof = op.asof_lookup(op.gate_batches(log), reads, span=64)
        assert _rows(asof, cols_read) == expected_asof


def test_hot_batch_gate_uses_skew_split(spark):
    log = _log(spark)
    with conf(spark, SKEW_CONF):
        lanes = op.batch_lanes(log)
        plan = _plan_text(lanes)
        assert "SortMergeJoin(skew=true)" in plan
        counts = {r["lane"]: r["count"] for r in lanes.groupBy("lane").count().collect()}
    assert sum(counts.values()) == log.count()
