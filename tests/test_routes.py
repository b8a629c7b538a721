"""One write path for batch, single and path requests."""

import hashlib
import hmac
import os
import subprocess
import sys

from pyspark.sql import functions as F

from gaugeline import operators as op
from gaugeline.plans.ingest import evaluate_requests, ingest
from gaugeline.sinks import request_log

KEY = "k1"
SCHEMA = "request_id long, arrival_ts timestamp, method string, path string, headers map<string,string>, remote_addr string, body binary"


def _sign(body: bytes) -> str:
    return hmac.new(KEY.encode(), body, hashlib.sha256).hexdigest()


def _requests(spark, rows):
    return spark.createDataFrame([(i, None, m, p, h, "1.2.3.4:5", b) for i, (m, p, h, b) in enumerate(rows)], SCHEMA)


def test_routes_in_order(spark):
    bad = b'{"id":"caf\xff","type":"gauge","value":2}'
    rows = [
        ("POST", "/update/gauge/t/1.5", {}, b""),
        ("POST", "/updates", {}, b'[{"id":"t","type":"gauge","value":9},{"id":"c","type":"counter","delta":2},'
                                 b'{"id":"t","type":"gauge","value":3},{"id":"c","type":"counter","delta":5}]'),
        ("POST", "/update", {"HashSHA256": _sign(bad)}, bad),
        ("POST", "/update/", {}, b'{"id":"t","type":"gauge","value":4}'),
        ("POST", "/update/counter/c/10", {}, None),
        ("POST", "/updates/", {}, b'[{"id":"c","type":"counter","delta":100},{"id":"x","type":"bogus"}]'),
        ("POST", "/update/counter/c/1.5", {}, b""), ("POST", "/update/bogus/c/1", {}, b""), ("POST", "/update/gauge/t", {}, b""),
        ("POST", "/other", {}, b"[]"), ("GET", "/update/gauge/t/8", {}, b""), ("POST", "/updates/", {}, b"null"), ("POST", "/update/", {}, b"null"),
        ("POST", "/updates/", {"hashsha256": _sign(b"[] ")}, b"[]"), ("POST", "/updates/", {"HashSHA256": _sign(b"[]")}, b"[]"),
        ("POST", "/updates/", {}, None), ("POST", None, {}, b"[]"),
    ]
    out = ingest(_requests(spark, rows), KEY, all_routes=True)
    got = {r.request_id: (r.route, r.status, r.signature_state) for r in out["outcomes"].collect()}
    assert [got[i][1] for i in range(len(rows))] == [200, 200, 200, 200, 200, 400, 400, 400, 404, 404, 405, 200, 400, 400, 200, 400, 404]
    assert got[2] == ("single", 200, "valid") and got[13][2] == "invalid" and got[14][2] == "valid" and got[0][2] == "unsigned"
    state = {(r.type, r.id): (r.delta, r.value) for r in out["state"].collect()}
    assert state == {("gauge", "t"): (None, 4.0), ("counter", "c"): (17, None), ("gauge", "caf�"): (None, 2.0)}
    audit = {r.request_id: r.metrics for r in out["audit"].withColumn("ts", F.lit(0)).collect()}
    assert audit[1] == ["t", "c", "t", "c"] and audit[0] == ["t"] and audit[11] == [] and set(audit) == {i for i, g in got.items() if g[1] == 200}


def test_signature_over_bytes_on_the_batch_route(spark):
    body = b'[{"id":"a\xff","type":"counter","delta":1}]'
    other = b'[{"id":"a\xfe","type":"counter","delta":1}]'
    ev = evaluate_requests(_requests(spark, [("POST", "/updates", {"HashSHA256": _sign(body)}, b) for b in (body, other)]), KEY)
    assert [r.status for r in ev.orderBy("request_id").collect()] == [200, 400]


def test_read_requests(spark):
    state = spark.createDataFrame([("gauge", "t", None, 23.5), ("counter", "hits", 10, None), ("gauge", "n", None, float("inf"))],
                                  "type string, id string, delta long, value double")
    rows = [("GET", "/value/gauge/t", {}, b""), ("GET", "/value/counter/hits", {}, None), ("GET", "/value/gauge/no", {}, b""),
            ("GET", "/value/bogus/t", {}, b""), ("POST", "/value", {}, b'{"id":"t","type":"gauge","value":1}'), ("POST", "/value/", {}, b'{"ID":"hits","type":"counter"}'),
            ("POST", "/value", {}, b'{"id":"t"'), ("POST", "/value", {}, b"[]"), ("POST", "/value", {}, b"null"), ("GET", "/value", {}, b"{}"),
            ("POST", "/value/gauge/t", {}, b""), ("GET", "/value/gauge", {}, b""), ("GET", None, {}, None), ("GET", "/value/gauge/n", {}, b"")]
    got = {r.request_id: (r.status, r.response) for r in op.read_responses(_requests(spark, rows), state).collect()}
    assert [got[i] for i in range(len(rows))] == [
        (200, "23.5"), (200, "10"), (404, None), (400, None), (200, '{"id":"t","type":"gauge","value":23.5}'), (200, '{"id":"hits","type":"counter","delta":10}'),
        (400, None), (400, None), (400, None), (405, None), (405, None), (404, None), (404, None), (200, "+Inf")]


def test_logged_content_length_is_the_header(spark):
    rows = [("POST", "/updates", {"content-length": "17"}, b"[]"), ("POST", "/updates", {"Content-Length": "x"}, b"[]"), ("POST", "/updates", {}, b"[]")]
    log = request_log(evaluate_requests(_requests(spark, rows), None)).orderBy("request_id").collect()
    assert [(r.content_length, r.body_bytes) for r in log] == [(17, 2), (2, 2), (2, 2)]


# One body of 40 MB decodes into an array of about 1 GB, more than the heap of
# the test session, so it gets a session of its own.
_BIG = """
from pyspark.sql import SparkSession, functions as F
from gaugeline.plans.ingest import ingest
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "10g")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
n = (1 << 20) + 1
element = F.concat(F.lit('{"id":"'), F.when(F.col("id") % 2 == 0, F.lit("g")).otherwise(F.lit("c")), F.lit('","type":"'),
                   F.when(F.col("id") % 2 == 0, F.concat(F.lit('gauge","value":'), F.col("id").cast("string")))
                   .otherwise(F.lit('counter","delta":1')), F.lit("}"))
body = spark.range(n, numPartitions=1).agg(F.concat(F.lit("["), F.array_join(F.collect_list(element), ","), F.lit("]")).alias("body"))
big = body.select(F.lit(7).cast("long").alias("request_id"), F.lit(None).cast("timestamp").alias("arrival_ts"), F.lit("POST").alias("method"),
                  F.lit("/updates").alias("path"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("h:1").alias("remote_addr"),
                  F.col("body").cast("binary").alias("body"))
state = {(r.type, r.id): (r.delta, r.value) for r in ingest(big, None, all_routes=True)["state"].collect()}
assert state == {("gauge", "g"): (None, float(n - 1)), ("counter", "c"): (n // 2, None)}, state
spark.stop()
"""


def test_batch_above_a_million_rows():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", _BIG], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, timeout=600)
    assert done.returncode == 0, done.stderr.decode()[-2000:]
