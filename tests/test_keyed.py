"""Keyed tables in buckets, streams into them, audit delivery, bucketed catalog tables."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from gaugeline import operators as op
from gaugeline.plans.catalog_requests import envelopes
from gaugeline.plans.ingest import evaluate_requests, request_audit
from gaugeline.sinks import write_state_tables
from gaugeline.sources import update_log
from gaugeline.sources.buckets import ordered_fold, state_table
from gaugeline.sources.updates import SIGNING_KEY
from gaugeline.streaming import deliver, json_sink, poll_windows, start_audit_delivery, start_state_apply, start_state_fold, start_window_table
from gaugeline.streaming.keyed import window_table
from tests.conftest import SF_SMALL
from tests.test_skew import conf

COLS = ["type", "id", "delta", "value"]


def _rows(df, cols=COLS):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def _updates(spark, rows):
    return spark.createDataFrame(rows, "seq long, type string, id string, delta long, value double")


def _many(spark, n):
    return spark.range(n).selectExpr("id AS seq", "'counter' AS type", "concat('c', id) AS id", "1L AS delta", "CAST(NULL AS DOUBLE) AS value")


def _files(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/data") for f in fs if f.endswith(".parquet")}


def test_a_commit_rewrites_touched_buckets_only(spark, scratch):
    table = state_table(f"{scratch}/s", buckets=16)
    assert table.read(spark).count() == 0 and table.version(spark) is None
    assert table.commit(ordered_fold(_many(spark, 20_000))) == 0
    before = _files(f"{scratch}/s")
    assert len(before) == 16
    assert table.commit(ordered_fold(_updates(spark, [(30_000, "counter", "c5", 4, None), (30_001, "gauge", None, None, 1.5)]))) == 1
    new = {k: v for k, v in _files(f"{scratch}/s").items() if k not in before}
    assert len(new) <= 2 and sum(new.values()) < sum(before.values()) / 4
    now = {(r.type, r.id): (r.delta, r.value) for r in table.read(spark).where("id is null or id in ('c5', 'c6')").collect()}
    assert now == {("counter", "c5"): (5, None), ("counter", "c6"): (1, None), ("gauge", None): (None, 1.5)}
    # The version before is still read as it was; an epoch without rows changes nothing.
    assert table.read(spark, 0).agg(F.sum("delta")).first()[0] == 20_000
    assert table.commit(ordered_fold(_many(spark, 0))) == 2 and table.read(spark).count() == 20_001


def test_commits_in_any_order_and_once(spark, scratch):
    a = _updates(spark, [(1, "gauge", "g", None, 1.0), (2, "counter", "g", 2, None), (9, "gauge", "h", None, 9.0)])
    b = _updates(spark, [(5, "gauge", "g", None, 5.0), (6, "counter", "g", 3, None), (7, "gauge", "h", None, 7.0)])
    want = _rows(op.fold_state(a.union(b)))
    for i, order in enumerate(((a, b), (b, a))):
        table = state_table(f"{scratch}/{i}", buckets=4)
        for epoch, part in enumerate(order):
            assert table.commit(ordered_fold(part), "w", epoch) == epoch
            assert table.commit(ordered_fold(part), "w", epoch) is None
        assert _rows(table.read(spark)) == want
    # A commit that failed before its marker leaves files that the next one replaces.
    os.makedirs(f"{scratch}/0/data/v=2/bucket=3")
    assert table.version(spark) == 1 and state_table(f"{scratch}/0", 4).commit(ordered_fold(a)) == 2


def test_retention_keeps_what_versions_reach(spark, scratch):
    table = state_table(f"{scratch}/s", buckets=8)
    for i in range(10):
        table.commit(ordered_fold(_updates(spark, [(i, "counter", f"c{i % 5}", 1, None), (i, "counter", "all", 1, None)])), "w", i)
        old = table.read(spark, max(0, i - 1))
        table.retain(spark, 2)
        assert old.where("id = 'all'").first().delta == max(1, i)       # a reader of the version before
    kept = {(v, b) for n in (8, 9) for b, v in table.manifest(spark, n).items()}
    held = {(int(v[2:]), int(b[7:])) for v in os.listdir(f"{scratch}/s/data") for b in os.listdir(f"{scratch}/s/data/{v}") if b.startswith("bucket=")}
    assert held == kept
    assert sorted(x for x in os.listdir(f"{scratch}/s/manifests") if "=" in x) == ["version=8", "version=9"]
    assert table.commit(ordered_fold(_updates(spark, [(1, "counter", "all", 1, None)])), "w", 9) is None
    table.retain(spark, 5)
    assert table.read(spark).where("id = 'all'").first().delta == 10


def _stream(spark, df, root, files, at_once=1):
    df.repartition(files).write.parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", at_once).parquet(f"{root}/in")


def test_streams_equal_batch_and_restart(spark, scratch):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    stream = _stream(spark, events, scratch, 3)
    for _ in range(2):          # the second run finds nothing new
        start_state_fold(update_log(stream), f"{scratch}/s", "keyed_fold", f"{scratch}/ck", keep=1).awaitTermination()
    table = state_table(f"{scratch}/s")
    assert table.version(spark) == 2
    assert _rows(table.read(spark)) == _rows(op.fold_state(op.lenient_filter(update_log(events))))


def test_windows_lose_no_late_poll(spark, scratch):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    # Newest first: all but the first epoch are late.
    events.where("ts >= '2024-01-20'").coalesce(1).write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{scratch}/in")
    args = (stream, f"{scratch}/w", "user_id", "ts", "value", "event_id", "1 hour", "keyed_windows", f"{scratch}/ck")
    start_window_table(*args).awaitTermination()
    events.where("ts < '2024-01-20'").coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    start_window_table(*args).awaitTermination()
    cols = ["user_id", "window_start", "poll_count", "last_value"]
    got = window_table(f"{scratch}/w", "user_id", dict(events.dtypes)["user_id"]).read(spark)
    want = poll_windows(events, "user_id", "ts", "value", "event_id", "1 hour")
    assert _rows(got.withColumn("window_start", F.col("window_start").cast("string")), cols) == \
        _rows(want.withColumn("window_start", F.col("window_start").cast("string")), cols)


def test_audit_reaches_each_sink_once(spark, scratch):
    requests = envelopes(spark, SF_SMALL)
    stream = _stream(spark, requests, scratch, 3)
    calls, broken = [], {"on": True}

    def flaky(events, epoch):
        calls.append(epoch)
        if broken["on"] and epoch == 1:
            json_sink(f"{scratch}/flaky")(events.limit(1), epoch)      # part of it, then a failure
            raise OSError("sink is down")
        json_sink(f"{scratch}/flaky")(events, epoch)
    sinks = {"flaky": flaky, "file": json_sink(f"{scratch}/file")}
    start_audit_delivery(stream, SIGNING_KEY, f"{scratch}/outbox", sinks, "audit_once", f"{scratch}/ck").awaitTermination()
    want = _rows(request_audit(evaluate_requests(requests, SIGNING_KEY)), ["ts", "metrics", "ip_address"])
    read = lambda name: _rows(spark.read.schema("ts long, metrics array<string>, ip_address string").json(f"{scratch}/{name}"), ["ts", "metrics", "ip_address"])
    assert read("file") == want and len(read("flaky")) < len(want) and calls == [0, 1, 1]
    assert list(deliver(spark, f"{scratch}/outbox", sinks)) == ["flaky"]
    broken["on"] = False
    assert deliver(spark, f"{scratch}/outbox", sinks) == {} and calls == [0, 1, 1, 1, 1, 2]
    assert read("flaky") == want and read("file") == want
    assert deliver(spark, f"{scratch}/outbox", sinks) == {} and len(calls) == 6


@pytest.mark.parametrize("routes", [False, True])
def test_apply_stream(spark, scratch, routes):
    requests = envelopes(spark, SF_SMALL)
    stream = _stream(spark, requests, scratch, 2)
    start_state_apply(stream, f"{scratch}/s", SIGNING_KEY, f"apply_{uuid.uuid4().hex}", f"{scratch}/ck", all_routes=routes).awaitTermination()
    from gaugeline.plans.ingest import ingest
    assert _rows(state_table(f"{scratch}/s").read(spark)) == _rows(ingest(requests, SIGNING_KEY)["state"])


def test_merges_do_not_exchange_bucketed_tables(spark, scratch):
    prefix = f"t{uuid.uuid4().hex}_"
    state = op.fold_state(_many(spark, 1000))
    write_state_tables(state, scratch, prefix, buckets=4)
    more = _many(spark, 10)
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        merged = op.merge_counters(spark.table(f"{prefix}counter"), more)
        todo, paths = [(merged._jdf.queryExecution().executedPlan(), ())], []
        while todo:
            node, above = todo.pop()
            above = (*above, node.nodeName())
            if node.nodeName().startswith("Scan parquet"):
                paths.append(above)
            kids = node.children()
            todo += [(kids.apply(i), above) for i in range(kids.size())]
        assert len(paths) == 1 and "SortMergeJoin" in paths[0] and "Exchange" not in paths[0]
        assert merged.agg(F.sum("value")).first()[0] == 1010


def _scanned(df):
    """Files and rows read by the parquet scan of an executed plan."""
    df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan parquet"):
            return int(node.metrics().apply("numFiles").value()), int(node.metrics().apply("numOutputRows").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]


def test_lookups_read_few_buckets_and_row_groups(spark, scratch):
    table = state_table(f"{scratch}/s", buckets=8, row_group_bytes=64 << 10)
    n = 200_000
    table.commit(ordered_fold(_many(spark, n).coalesce(1)))
    hit = op.stored_point(spark, table, "counter", "c777")
    assert [(r.status, r.delta, r.text) for r in hit.collect()] == [(200, 1, "1")]
    files, rows = _scanned(hit)
    assert files == 1 and rows < n / 8 / 2
    # Inside the range of many groups' statistics, in no group's Bloom filter.
    miss = op.stored_point(spark, table, "counter", "c500x")
    assert [r.status for r in miss.collect()] == [404] and (_scanned(miss) or (0, 0))[1] == 0
    requests = spark.createDataFrame([(1, "counter", "c5"), (2, "counter", "c5"), (3, "bogus", "c5"), (4, "gauge", None)], "r long, type string, id string")
    bulk = op.stored_lookup(requests, table)
    assert sorted((r.r, r.status, r.text) for r in bulk.collect()) == [(1, 200, "1"), (2, 200, "1"), (3, 400, None), (4, 404, None)]
    assert _scanned(bulk)[0] == 1


def test_salvaged_rows_land_after_their_batch(spark):
    log = spark.createDataFrame(
        [(1, 0, "gauge", "g", None, 1.0), (1, 1, "counter", "c", 1, None), (2, 0, "gauge", "g", None, 2.0), (2, 1, "bogus", "x", 1, None),
         (2, 2, "gauge", "g", None, 2.5), (2, 3, "counter", "c", 10, None), (2, 4, "gauge", "g", None, None), (3, 0, "gauge", "h", None, 3.0)],
        "batch_id long, pos int, type string, id string, delta long, value double")
    got = op.salvage_fold(op.batch_lanes(log))
    assert _rows(got) == _rows(spark.createDataFrame([("gauge", "g", None, 2.5), ("counter", "c", 11, None), ("gauge", "h", None, 3.0)],
                                                     "type string, id string, delta long, value double"))
