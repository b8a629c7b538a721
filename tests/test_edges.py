"""Edge tables (the reference has no tests for these)."""

import hashlib
import hmac
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline import functions as fn
from gaugeline import operators as op
from gaugeline.operators.fold import sum_deltas
from gaugeline.sources import parse_batch_bodies
from tests.conftest import metric_rows


def _one_col(spark, values, typ, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_gauge_text_parse(spark):
    ok = ["1.5", "NaN", "nan", "inf", "+Inf", "-Infinity", "0x1p-2", "5.", ".5", "-2.5e3", "1e-400"]
    bad = [" 1.5 ", "1.5d", "1.5f", "", "1e400", "+nan", "1_000", "abc", None]
    got = _one_col(spark, ok + bad, "string", fn.parse_gauge_text)
    assert all(g is not None for g in got[:len(ok)]), got
    assert all(g is None for g in got[len(ok):]), got
    assert got[0] == 1.5 and got[6] == 0.25 and got[5] == float("-inf") and got[9] == -2500.0


def test_counter_text_parse(spark):
    ok = ["5", "+5", "-5", "-9223372036854775808", "007"]
    bad = [" 5 ", "5.0", "1e3", "9223372036854775808", "", "0x10", None]
    got = _one_col(spark, ok + bad, "string", fn.parse_counter_text)
    assert got[:len(ok)] == [5, 5, -5, -9223372036854775808, 7]
    assert all(g is None for g in got[len(ok):])


@pytest.mark.parametrize("body,ok,n", [
    ("[]", True, 0), ("null", True, 0), ('{"id":"a","type":"gauge","value":1}', False, None),
    ("not json", False, None), ('[{"id":5,"type":"gauge","value":1}]', False, None),
    ('[{"id":"a","type":"gauge","value":"1"}]', False, None),
    ('[{"id":"a","type":"counter","delta":1.5}]', False, None),
    ('[{"id":"a","type":"counter","delta":9223372036854775808}]', False, None),
    ('[{"id":"a","type":"gauge","value":NaN}]', False, None),
    ("[null]", True, 1),
    ('[{"id":"a","type":"gauge","value":1,"extra":{"x":[1]}}]', True, 1),
    ('[{"id":"a","type":"gauge","value":1e2},{"id":"b","type":"counter","delta":-3}]', True, 2),
    ('[{"id":"a","type":"gauge","value":1}] trailing text', True, 1),
    ('  [{"id":"a","type":"gauge","value":1}][{"id":"b","type":"gauge","value":2}]', True, 1),
    ('[{"id":"a","type":"gauge","value":1}]\n', True, 1),
    ('[{"id":"a","type":"gauge","value":1}', False, None),
    ('[{"id":"a","type":"gauge","value":NaN}] x', False, None),
])
def test_batch_bodies(spark, body, ok, n):
    df = spark.createDataFrame([(1, body)], "batch_id long, body string")
    rows = parse_batch_bodies(df).collect()
    assert all(r["decode_ok"] == ok for r in rows)
    if ok:
        assert len([r for r in rows if r["pos"] is not None]) == n


def test_null_element_is_invalid_kind(spark):
    df = spark.createDataFrame([(1, "[null]")], "batch_id long, body string")
    c = op.classify(parse_batch_bodies(df), decode_ok="decode_ok").first()
    assert c["err"] == "invalid metric type"


def test_decoded_values(spark):
    df = spark.createDataFrame([(1, '[{"id":"a","type":"gauge","value":1e2},{"id":"b","type":"counter","delta":-3}]')],
                               "batch_id long, body string")
    r = {x["pos"]: x for x in parse_batch_bodies(df).collect()}
    assert r[0]["value"] == 100.0 and r[1]["delta"] == -3 and r[1]["type"] == "counter"


def test_gauge_text_format(spark):
    vals = [10.0, 1e7, 1e21, 1e-7, float("nan"), float("inf"), float("-inf"), -0.0, 23.5, 0.1, 123456789.125,
            5e-324, 1.7976931348623157e308, 2.82879384806159e17, 1.9400994884341945e25]
    exp = ["10", "10000000", "1000000000000000000000", "0.0000001", "NaN", "+Inf", "-Inf", "-0", "23.5", "0.1",
           "123456789.125"]
    got = _one_col(spark, vals, "double", fn.format_gauge)
    assert got[:len(exp)] == exp
    for v, g in zip(vals[len(exp):], got[len(exp):]):
        assert g == np.format_float_positional(v, unique=True, trim="-")
        assert float(g) == v


def test_gauge_text_random_doubles(spark):
    rnd = random.Random(7)
    vals = []
    while len(vals) < 3000:
        v = struct.unpack("<d", rnd.getrandbits(64).to_bytes(8, "little"))[0]
        if np.isfinite(v):
            vals.append(v)
    vals += [rnd.uniform(-1e6, 1e6) for _ in range(2000)] + [round(rnd.uniform(0, 600), 2) for _ in range(2000)]
    got = _one_col(spark, vals, "double", fn.format_gauge)
    bad = [(v, g) for v, g in zip(vals, got) if g != np.format_float_positional(v, unique=True, trim="-")]
    assert not bad, bad[:5]


@pytest.mark.parametrize("real,xff,remote,expected", [
    ("1.2.3.4", "5.6.7.8", "9.9.9.9:1", "1.2.3.4"),
    (None, "a, b", "9.9.9.9:1", "a"),
    (None, ",x", "9.9.9.9:1", "9.9.9.9"),
    (None, " ,x", "9.9.9.9:1", ""),
    (None, None, "10.0.0.1:80", "10.0.0.1"),
    (None, None, "[::1]:443", "[::1]"),
    ("", None, "host", "host"),
    ("  1.1.1.1\t", None, "x:1", "1.1.1.1"),
])
def test_client_ip(spark, real, xff, remote, expected):
    df = spark.createDataFrame([(real, xff, remote)], "r string, x string, m string")
    assert df.select(fn.client_ip("r", "x", "m")).first()[0] == expected


def _py_hmac(key, body):
    return hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("key", ["k", "secret-key", "x" * 64, "y" * 65, "ключ" * 30])
def test_hmac_matches_python(spark, key):
    bodies = ["", "abc", '[{"id":"a","type":"gauge","value":1.5}]', "héllo wörld ✓" * 50]
    got = _one_col(spark, bodies, "string", lambda c: fn.hmac_sha256_hex(c, key))
    assert got == [_py_hmac(key, b) for b in bodies]


def test_signature_states(spark):
    key, body = "secret", '[{"id":"a","type":"gauge","value":1}]'
    right = _py_hmac(key, body)
    df = spark.createDataFrame([(1, body, None), (2, body, ""), (3, body, right), (4, body, right.upper()),
                                (5, body + " ", right)], "i int, body string, h string")
    got = {r["i"]: r["signature_state"] for r in op.verify_signatures(df, key, hash_col="h").collect()}
    assert got == {1: "unsigned", 2: "unsigned", 3: "valid", 4: "invalid", 5: "invalid"}
    nokey = op.verify_signatures(df, None, hash_col="h").select("signature_state").distinct().collect()
    assert [r[0] for r in nokey] == ["unsigned"]


def test_truncate_and_mask(spark):
    s = "ab" + "é" * 10  # é is two bytes
    got = _one_col(spark, [s, "short"], "string", lambda c: fn.truncate_bytes(c, 5, "...(truncated)"))
    assert got[0] == "abé�...(truncated)" and got[1] == "short"
    masks = _one_col(spark, ["", "0123456789", "0123456789a"], "string", fn.mask_hash)
    assert masks == ["", "0123456789", "0123456789…"]


def test_restore_edges(spark):
    cur = spark.createDataFrame([
        ("counter", "c_diff", 50, None), ("counter", "c_only_cur", 7, None), ("gauge", "g", None, 1.0),
        ("counter", "c_zero_over_cur", 9, None)], "type string, id string, delta bigint, value double")
    snap = spark.createDataFrame([
        ("c_diff", "counter", 20, None, 0), ("c_only_snap", "counter", 5, None, 1),
        ("c_zero_new", "counter", 0, None, 2), ("g", "gauge", None, 2.0, 3), ("g", "gauge", None, 3.0, 4),
        ("g", "gauge", None, None, 5), ("u", "histogram", 1, 1.0, 6), ("c_zero_over_cur", "counter", 0, None, 7),
        ("c_dup", "counter", 0, None, 8), ("c_dup", "counter", 4, None, 9),
        ("c_dup2", "counter", 4, None, 10), ("c_dup2", "counter", 0, None, 11)],
        "id string, type string, delta bigint, value double, pos bigint")
    got = {(r["type"], r["id"]): (r["delta"] if r["type"] == "counter" else r["value"])
           for r in op.restore_merge(cur, snap).collect()}
    assert got == {("counter", "c_diff"): 20, ("counter", "c_only_cur"): 7, ("counter", "c_only_snap"): 5,
                   ("gauge", "g"): 3.0, ("counter", "c_zero_over_cur"): 0, ("counter", "c_dup"): 4,
                   ("counter", "c_dup2"): 0}
    kept = op.restore_merge(cur, snap, keep_zero_counters=True).filter("id = 'c_zero_new'").count()
    assert kept == 1


def test_gate_edges(spark):
    u = metric_rows(spark, [
        (1, 1, 0, "a", "gauge", None, 1.0), (2, 1, 1, "b", "histogram", None, 1.0), (3, 1, 2, "c", "gauge", None, None),
        (4, 2, 0, "x", "gauge", None, 1.0), (5, 2, 1, "x", "counter", 3, None), (6, 2, 2, "x", "gauge", None, 2.0),
        (7, 3, 0, "d", "counter", None, None), (8, 3, 1, "e", "unknown", None, None)])
    out = {r["batch_id"]: r for r in op.batch_outcomes(u).collect()}
    assert (out[1]["err"], out[1]["bad_pos"]) == ("invalid metric type", 1)
    assert out[2]["status"] == 200 and out[3]["err"] == "bad metric value"
    st = {(r["type"], r["id"]): r for r in op.fold_state(op.gate_batches(u)).collect()}
    assert set(st) == {("gauge", "x"), ("counter", "x")}
    assert st[("gauge", "x")]["value"] == 2.0 and st[("counter", "x")]["delta"] == 3
    lanes = {r["seq"]: r["lane"] for r in op.batch_lanes(u).collect()}
    assert lanes == {1: "salvaged", 2: "quarantined", 3: "quarantined", 4: "accepted", 5: "accepted",
                     6: "accepted", 7: "quarantined", 8: "quarantined"}


def test_overflow_policies(spark):
    big = 9223372036854775807
    u = metric_rows(spark, [(1, 1, 0, "c", "counter", big, None), (2, 1, 1, "c", "counter", 2, None)])
    wrap = u.groupBy("id").agg(sum_deltas(F.col("delta"), "wrap").alias("t")).first()["t"]
    assert wrap == -9223372036854775807
    assert u.groupBy("id").agg(sum_deltas(F.col("delta"), "null").alias("t")).first()["t"] is None
    with pytest.raises(Exception):
        u.groupBy("id").agg(sum_deltas(F.col("delta"), "error").alias("t")).collect()


@pytest.mark.parametrize("body,expected", [
    ('[{"ID":"a","TYPE":"gauge","Value":1.5}]', ("a", "gauge", None, 1.5)),
    ('[{"Id":"c","type":"counter","DELTA":3}]', ("c", "counter", 3, None)),
    ('[{"id":"x","ID":"y","type":"gauge","value":2}]', ("x", "gauge", None, 2.0)),
    ('[{"id":"n","type":"gauge","value":1,"extra":{"ID":5}}]', ("n", "gauge", None, 1.0)),
])
def test_keys_match_case_insensitively(spark, body, expected):
    df = spark.createDataFrame([(1, body)], "batch_id long, body string")
    r = parse_batch_bodies(df).first()
    assert r["decode_ok"] and (r["id"], r["type"], r["delta"], r["value"]) == expected


def test_single_body_case_insensitive(spark):
    from gaugeline.sources import parse_single_bodies
    df = spark.createDataFrame([(1, '{"ID":"m","Type":"counter","Delta":7}'), (2, '{"id":"m","type":"gauge","VALUE":"x"}')],
                               "seq long, body string")
    r = {x["seq"]: x for x in parse_single_bodies(df).collect()}
    assert (r[1]["id"], r[1]["type"], r[1]["delta"]) == ("m", "counter", 7) and not r[2]["decode_ok"]


def test_header_names_ignore_case(spark):
    df = spark.createDataFrame([({"x-real-ip": "1.2.3.4"},), ({"X-Forwarded-For": "5.6.7.8, 9"},), ({},)],
                               "h map<string,string>")
    got = [r[0] for r in df.select(fn.client_ip(fn.header("h", "X-Real-IP"), fn.header("h", "X-Forwarded-For"),
                                                F.lit("7.7.7.7:1"))).collect()]
    assert got == ["1.2.3.4", "5.6.7.8", "7.7.7.7"]


def test_merge_overflow_policies(spark):
    big = 9223372036854775807
    state = spark.createDataFrame([("counter", "c", big, None)], "type string, id string, delta bigint, value double")
    u = metric_rows(spark, [(1, 1, 0, "c", "counter", 2, None)])
    wrap = op.merge_state(state, u, overflow="wrap").first()["delta"]
    assert wrap == -9223372036854775807
    assert op.merge_state(state, u, overflow="null").first()["delta"] is None
    with pytest.raises(Exception):
        op.merge_state(state, u).collect()


def test_line_ends_are_not_numbers(spark):
    rows = spark.createDataFrame([("5",), ("5\n",), ("1.5\n",), ("inf\n",)], "t string").select(
        fn.parse_gauge_text("t").alias("g"), fn.parse_counter_text("t").alias("c")).collect()
    assert [tuple(r) for r in rows] == [(5.0, 5), (None, None), (None, None), (None, None)]


def test_rows_without_a_batch_id_are_judged_alone(spark):
    d = spark.createDataFrame([(None, "ok", "counter", 1, None), (None, "x", "bogus", 1, None), (None, "y", "counter", None, None),
                               (1, "a", "counter", 1, None), (1, "b", "gauge", None, None)],
                              "batch_id long, id string, type string, delta long, value double")
    assert [r.id for r in op.gate_batches(d).collect()] == ["ok"]
    assert {r.id: r.lane for r in op.batch_lanes(d).collect()} == {
        "ok": "accepted", "x": "quarantined", "y": "quarantined", "a": "salvaged", "b": "quarantined"}


def test_broken_bodies_are_rejected_alone(spark):
    good = '[{"id":"a","type":"counter","delta":1}]'
    bodies = [(1, "[" * 200_000), (2, good + " tail"), (3, "null0"), (4, "[{"), (5, "")]
    out = parse_batch_bodies(spark.createDataFrame(bodies, "n int, body string"), keep=["n"])
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    assert {r.n: (r.decode_ok, r.id) for r in out.collect()} == {
        1: (False, None), 2: (True, "a"), 3: (True, None), 4: (False, None), 5: (False, None)}
