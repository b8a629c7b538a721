"""Randomised properties (hypothesis), checked in batches to keep jobs few."""

import math

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gaugeline import functions as fn
from gaugeline import operators as op
from tests.conftest import metric_rows

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=300))
def test_gauge_text_round_trips(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = df.select("v", fn.format_gauge("v").alias("t")).select(
        "v", "t", fn.parse_gauge_text("t").alias("back")).collect()
    for r in out:
        assert "e" not in r["t"].lower() or math.isinf(r["v"])
        assert r["back"] == r["v"] and math.copysign(1, r["back"]) == math.copysign(1, r["v"])


@SETTINGS
@given(st.lists(st.integers(min_value=-(2 ** 63), max_value=2 ** 63 - 1), min_size=1, max_size=300))
def test_counter_text_round_trips(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    out = df.select("v", fn.parse_counter_text(fn.format_counter("v")).alias("back")).collect()
    assert all(r["back"] == r["v"] for r in out)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from(["counter", "gauge", "other"]),
                          st.booleans(), st.integers(-50, 50)), min_size=1, max_size=120),
       st.randoms(use_true_random=False))
def test_gate_is_all_or_nothing(spark, items, rnd):
    rows = []
    for seq, (batch, kind, present, n) in enumerate(items):
        delta = n if kind == "counter" and present else None
        value = float(n) if kind == "gauge" and present else None
        rows.append((seq, batch, seq, f"m{n % 5}", kind, delta, value))
    rnd.shuffle(rows)
    u = metric_rows(spark, rows)
    bad = {b for (_, b, _, _, k, d, v) in rows
           if k not in ("counter", "gauge") or (k == "counter" and d is None) or (k == "gauge" and v is None)}
    kept = {r["seq"] for r in op.gate_batches(u).collect()}
    assert kept == {s for (s, b, *_rest) in rows if b not in bad}
    lanes = {r["lane"] for r in op.batch_lanes(u).collect()}
    assert lanes <= {"accepted", "salvaged", "quarantined"}
    totals = {r["id"]: r["value"] for r in op.counter_totals(op.gate_batches(u)).collect()}
    expect = {}
    for (s, b, _, i, k, d, _v) in rows:
        if b not in bad and k == "counter":
            expect[i] = expect.get(i, 0) + d
    assert totals == expect
