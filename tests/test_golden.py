"""Golden cases taken from the reference's handler tests and examples."""

import gzip
import json

from pyspark.sql import functions as F

from gaugeline import operators as op
from gaugeline.functions import format_metric_value
from gaugeline.plans.ingest import evaluate_requests, ingest
from gaugeline.sinks import listing_lines, signed_batches
from gaugeline.sinks.snapshot import write_snapshot_array
from gaugeline.sources import parse_single_bodies, parse_update_paths, read_snapshot
from gaugeline.sources.gzip import deflate, inflate
from tests.conftest import metric_rows


def _state_of(df):
    return {(r["type"], r["id"]): (r["delta"] if r["type"] == "counter" else r["value"])
            for r in df.collect()}


def test_path_updates(spark):
    reqs = spark.createDataFrame([(1, "/update/gauge/temperature/23.5"), (2, "/update/counter/hits/10"),
                                  (3, "/update/unknown/temperature/23.5")], "seq long, path string")
    p = {r["seq"]: r for r in parse_update_paths(reqs).collect()}
    assert p[1]["status"] == 200 and p[1]["value"] == 23.5
    assert p[2]["status"] == 200 and p[2]["delta"] == 10
    assert p[3]["status"] == 400
    ok = parse_update_paths(reqs).filter("status = 200").withColumn("batch_id", F.col("seq"))
    assert _state_of(op.fold_state(ok)) == {("gauge", "temperature"): 23.5, ("counter", "hits"): 10}


def test_text_reads_and_missing(spark):
    state = metric_rows(spark, [(1, 1, 0, "temperature", "gauge", None, 23.5),
                                (2, 2, 0, "hits", "counter", 10, None)])
    st = op.fold_state(state)
    g = op.point_lookup(st, "gauge", "temperature").first()
    c = op.point_lookup(st, "counter", "hits").first()
    m = op.point_lookup(st, "gauge", "unknown").first()
    assert (g["status"], g["text"]) == (200, "23.5")
    assert (c["status"], c["text"]) == (200, "10")
    assert m["status"] == 404
    bad = op.point_lookup(st, "histogram", "hits").first()
    assert bad["status"] == 400


def test_listing(spark):
    st = op.fold_state(metric_rows(spark, [(1, 1, 0, "temperature", "gauge", None, 23.5),
                                           (2, 2, 0, "hits", "counter", 10, None)]))
    lines = [r["line"] for r in listing_lines(st).orderBy("section", F.col("id").asc_nulls_first()).collect()]
    assert lines == ["Gauges", "temperature: 23.5", "Counters", "hits: 10"]


def test_json_single_updates(spark):
    bodies = spark.createDataFrame([
        (1, '{"id":"temperature","type":"gauge","value":23.5}'),
        (2, '{"id":"hits","type":"counter","delta":10}'),
        (3, '{"id":"x","type":"invalid","value":1.0}'),
        (4, '{"id":"g","type":"gauge"}'),
        (5, '{"id":"c","type":"counter"}'),
    ], "seq long, body string")
    rows = op.classify(parse_single_bodies(bodies), decode_ok="decode_ok")
    st = {r["seq"]: r["status"] for r in rows.collect()}
    assert st == {1: 200, 2: 200, 3: 400, 4: 400, 5: 400}
    echo = rows.filter("status = 200").select("seq", format_metric_value("type", "delta", "value").alias("t"))
    assert {r["seq"]: r["t"] for r in echo.collect()} == {1: "23.5", 2: "10"}


def test_batch_of_three(spark):
    body = ('[{"id":"temperature","type":"gauge","value":23.5},{"id":"humidity","type":"gauge","value":56.8},'
            '{"id":"total_requests","type":"counter","delta":100}]')
    req = spark.createDataFrame([(1, body)], "request_id long, body string").select(
        "request_id", F.current_timestamp().alias("arrival_ts"), F.lit("POST").alias("method"),
        F.lit("/updates/").alias("path"), F.create_map().cast("map<string,string>").alias("headers"),
        F.lit("127.0.0.1:5000").alias("remote_addr"), "body")
    out = ingest(req, key=None)
    assert _state_of(out["state"]) == {("gauge", "temperature"): 23.5, ("gauge", "humidity"): 56.8,
                                       ("counter", "total_requests"): 100}
    a = out["audit"].first()
    assert a["metrics"] == ["temperature", "humidity", "total_requests"] and a["ip_address"] == "127.0.0.1"


def test_encode_omits_absent_and_null_vs_zero(spark):
    df = spark.createDataFrame([("a", "gauge", None, 23.5), ("b", "counter", 10, None), ("c", "counter", 0, None),
                                ("", "", None, None)], "id string, type string, delta bigint, value double")
    js = [r[0] for r in df.select(F.to_json(F.struct("id", "type", "delta", "value"))).collect()]
    assert js[0] == '{"id":"a","type":"gauge","value":23.5}'
    assert js[1] == '{"id":"b","type":"counter","delta":10}'
    assert js[2] == '{"id":"c","type":"counter","delta":0}'
    assert js[3] == '{"id":"","type":""}'


def test_decode_round_trip(spark):
    bodies = spark.createDataFrame([(1, '{"id":"memory_usage","type":"gauge","value":75.3}'), (2, "{}")],
                                   "seq long, body string")
    r = {x["seq"]: x for x in parse_single_bodies(bodies).collect()}
    assert r[1]["value"] == 75.3 and r[1]["id"] == "memory_usage"
    assert r[2]["delta"] is None and r[2]["value"] is None and r[2]["decode_ok"]


def test_outbound_batch(spark):
    u = metric_rows(spark, [(1, 7, 0, "Alloc", "gauge", None, 42.5)])
    b = signed_batches(u, key="123").first()
    assert json.loads(b["body"]) == [{"id": "Alloc", "type": "gauge", "value": 42.5}]
    assert b["hash"] and len(b["hash"]) == 64
    z = spark.createDataFrame([(b["body"],)], "body string").select(deflate("body").alias("gz"))
    raw = z.first()["gz"]
    assert json.loads(gzip.decompress(raw)) == [{"id": "Alloc", "type": "gauge", "value": 42.5}]
    back = z.select(inflate("gz").cast("string").alias("b")).first()["b"]
    assert back == b["body"]


def test_empty_snapshot_file(spark, scratch):
    p = f"{scratch}/storage.json"
    with open(p, "w") as f:
        f.write("null\n")
    assert read_snapshot(spark, p, whole_array=True).count() == 0
    assert read_snapshot(spark, p).count() == 0


def test_snapshot_array_round_trip(spark, scratch):
    st = op.fold_state(metric_rows(spark, [(1, 1, 0, "t", "gauge", None, 23.5), (2, 1, 1, "h", "counter", 10, None)]))
    write_snapshot_array(st, f"{scratch}/snap")
    back = read_snapshot(spark, f"{scratch}/snap", whole_array=True)
    assert _state_of(back) == {("gauge", "t"): 23.5, ("counter", "h"): 10}
    # counters first, then gauges, as the service writes them
    assert [r["type"] for r in back.orderBy("pos").collect()] == ["counter", "gauge"]


def test_unsigned_request_passes(spark):
    req = spark.createDataFrame([(1, '[]')], "request_id long, body string").select(
        "request_id", F.current_timestamp().alias("arrival_ts"),
        F.create_map(F.lit("HashSHA256"), F.lit("abc")).alias("headers"),
        F.lit("10.0.0.1:1").alias("remote_addr"), "body")
    ev = evaluate_requests(req, key=None).first()
    assert ev["signature_state"] == "unsigned" and ev["status"] == 200
