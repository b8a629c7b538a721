"""Properties of the fold, merge, gate, echo and snapshot operators."""

import random

from pyspark.sql import Window, functions as F

from gaugeline import operators as op
from gaugeline.plans.catalog import updates
from gaugeline.sinks import write_snapshot
from gaugeline.sources import read_snapshot
from gaugeline.operators.echo import running_aggregates
from tests.conftest import SF_SMALL, metric_rows


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _hot_log(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        # a third of all rows hit one counter and one gauge name
        name = "hot" if seq % 3 == 0 else f"k{rnd.randrange(40)}"
        kind = "counter" if rnd.random() < 0.5 else "gauge"
        delta = rnd.randrange(-5, 100) if kind == "counter" and rnd.random() > 0.05 else None
        value = rnd.uniform(0, 10) if kind == "gauge" and rnd.random() > 0.05 else None
        rows.append((seq * 3 + rnd.randrange(3), seq // 7, seq % 7, name, kind, delta, value))
    return metric_rows(spark, rows)


def test_two_level_running_equals_naive(spark):
    log = _hot_log(spark)
    w = Window.partitionBy("type", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    naive = log.select("seq", F.sum("delta").over(w).alias("s"), F.last("value", True).over(w).alias("l"))
    for span in (1, 16, 1000, 1 << 20):
        got = running_aggregates(log, ["type", "id"], "seq", sums={"delta": "s"}, lasts={"value": "l"}, span=span)
        assert _rows(got, ["seq", "s", "l"]) == _rows(naive, ["seq", "s", "l"]), span


def test_counter_echo_matches_window(spark):
    log = op.lenient_filter(_hot_log(spark))
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    naive = log.filter("type = 'counter'").select("seq", F.sum("delta").over(w).alias("total"))
    assert _rows(op.counter_echo(log, span=8), ["seq", "total"]) == _rows(naive, ["seq", "total"])


def test_merge_of_folds_is_fold_of_union(spark):
    u = op.gate_batches(updates(spark, SF_SMALL))
    # merge lets the newer side win, so A must precede B in arrival order
    a, b = u.filter("seq < 400"), u.filter("seq >= 400")
    merged = op.merge_state(op.fold_state(a), b)
    cols = ["type", "id", "delta", "value"]
    assert _rows(merged, cols) == _rows(op.fold_state(u), cols)


def test_batch_resplit_keeps_counter_totals(spark):
    clean = updates(spark, SF_SMALL, dirty=False)
    resplit = clean.withColumn("batch_id", F.col("seq") % 13).withColumn("pos", (F.col("seq") / 13).cast("int"))
    t1 = op.counter_totals(op.gate_batches(clean))
    t2 = op.counter_totals(op.gate_batches(resplit))
    assert _rows(t1, ["id", "value"]) == _rows(t2, ["id", "value"])


def test_lanes_partition_input(spark):
    u = updates(spark, SF_SMALL)
    lanes = op.batch_lanes(u)
    counts = {r["lane"]: r["count"] for r in lanes.groupBy("lane").count().collect()}
    assert sum(counts.values()) == u.count()
    assert counts["accepted"] == op.gate_batches(u).count()
    assert counts["quarantined"] == op.rejects(u).count()


def test_snapshot_restore_round_trip(spark, scratch):
    st = op.fold_state(op.gate_batches(updates(spark, SF_SMALL)))
    write_snapshot(st, f"{scratch}/snap")
    snap = read_snapshot(spark, f"{scratch}/snap")
    empty = spark.createDataFrame([], "type string, id string, delta bigint, value double")
    restored = op.restore_merge(empty, snap)
    cols = ["type", "id", "delta", "value"]
    expected = st.filter("NOT (type = 'counter' AND delta = 0)")
    assert _rows(restored, cols) == _rows(expected, cols)


def test_state_documents_round_trip(spark):
    st = op.fold_state(op.gate_batches(updates(spark, SF_SMALL)))
    docs = op.state_documents(st, buckets=3)
    assert docs.count() <= 3
    cols = ["type", "id", "delta", "value"]
    assert _rows(op.documents_to_rows(docs), cols) == _rows(st, cols)
