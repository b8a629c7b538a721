"""Sinks, the versioned state store and plan shapes that matter at scale."""

import gzip
import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from gaugeline import operators as op
from gaugeline.plans import QUERIES
from gaugeline.plans.ingest import evaluate_requests, inflate_requests
from gaugeline.sinks import create_state_tables, drop_state_tables, write_listing
from gaugeline.sources import read_typed_state
from gaugeline.sources.state import current_version, read_state, write_state_version
from tests.conftest import SF_SMALL


def _plan(df, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_state_tables(spark, scratch):
    create_state_tables(spark, location=scratch, prefix="t_")
    create_state_tables(spark, location=scratch, prefix="t_")  # if not exists
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} >= {"t_gauge", "t_counter"}
    spark.sql("INSERT INTO t_counter VALUES ('hits', 10)")
    assert spark.table("t_counter").first()["value"] == 10
    drop_state_tables(spark, prefix="t_")
    assert not {r.tableName for r in spark.sql("SHOW TABLES").collect()} & {"t_gauge", "t_counter"}


def test_versioned_state_and_pruning(spark, scratch):
    st = QUERIES["metric_state"](spark, SF_SMALL)
    root = f"{scratch}/state"
    assert write_state_version(st, root) == 0
    assert write_state_version(st, root) == 1
    assert current_version(spark, root) == 1
    g = read_typed_state(spark, root, "gauge")
    assert g.columns == ["id", "value"] and g.count() == 15
    plan = _plan(g.filter(F.col("id") == "user_1"))
    assert "PartitionFilters: [isnotnull(type" in plan and "EqualTo(id,user_1)" in plan
    assert read_state(spark, root, 0).count() == 20


def test_listing_file(spark, scratch):
    st = QUERIES["metric_state"](spark, SF_SMALL)
    write_listing(st, f"{scratch}/listing")
    lines = [r[0] for r in spark.read.text(f"{scratch}/listing").collect()]
    assert lines[0] == "Gauges" and "Counters" in lines and len(lines) == 22


def test_gzip_requests(spark):
    body = '[{"id":"a","type":"counter","delta":2}]'
    rows = [(1, gzip.compress(body.encode()), {"Content-Encoding": "gzip"}),
            (2, b"not gzip", {"Content-Encoding": "gzip, br"}),
            (3, body.encode(), {})]
    df = spark.createDataFrame(rows, "request_id long, body binary, headers map<string,string>").select(
        "request_id", F.current_timestamp().alias("arrival_ts"), "headers",
        F.lit("1.1.1.1:1").alias("remote_addr"), "body")
    ev = {r["request_id"]: r for r in evaluate_requests(inflate_requests(df), None).collect()}
    assert ev[1]["status"] == 200 and ev[3]["status"] == 200
    assert ev[2]["status"] == 400 and ev[2]["err"] == "decode error"


def test_fold_stays_on_hash_aggregate(spark):
    plan = _plan(QUERIES["metric_state"](spark, SF_SMALL), "simple")
    assert "partial_sum" in plan and "partial_max_by" in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_gate_is_anti_join_on_failing_batches(spark):
    plan = _plan(QUERIES["batch_gate"](spark, SF_SMALL), "simple")
    assert "LeftAnti" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(QUERIES["counter_total"](spark, SF_SMALL), "simple")
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("ts:" not in s and "lineitem" not in s for s in scans)


def test_point_lookup_pushes_down(spark, scratch):
    root = f"{scratch}/pl"
    write_state_version(QUERIES["metric_state"](spark, SF_SMALL), root)
    plan = _plan(op.point_lookup(read_state(spark, root), "counter", "hits_view"))
    assert "PartitionFilters" in plan and "EqualTo(id,hits_view)" in plan


def test_sink_writers(spark, scratch):
    from gaugeline.plans.catalog_requests import envelopes
    from gaugeline.sinks import request_log, write_request_log, signed_batches, write_signed_batches
    from gaugeline.sinks.snapshot import write_snapshot
    from gaugeline.plans.catalog import updates
    from gaugeline.sources.updates import SIGNING_KEY
    ev = evaluate_requests(envelopes(spark, SF_SMALL), SIGNING_KEY)
    write_request_log(request_log(ev), f"{scratch}/log")
    back = spark.read.parquet(f"{scratch}/log")
    assert back.count() == 100 and "log_date" in back.columns
    write_signed_batches(signed_batches(updates(spark, SF_SMALL), SIGNING_KEY), f"{scratch}/out")
    gz = spark.read.parquet(f"{scratch}/out").orderBy("batch_id").first()
    assert gzip.decompress(gz["gz"]).startswith(b"[{")
    nan_state = spark.createDataFrame([("gauge", "g", None, float("nan")), ("gauge", "h", None, 1.5),
                                       ("counter", "c", 3, None)], "type string, id string, delta bigint, value double")
    import pytest
    write_snapshot(nan_state, f"{scratch}/snap_nan", reject_path=f"{scratch}/snap_rejects")
    from gaugeline.sources import read_snapshot
    assert sorted(r["id"] for r in read_snapshot(spark, f"{scratch}/snap_nan").collect()) == ["c", "h"]
    assert write_snapshot(nan_state.filter("id = 'c'"), f"{scratch}/snap_nan") == 1  # next version
    assert [r["id"] for r in read_snapshot(spark, f"{scratch}/snap_nan").collect()] == ["c"]
    assert [r["id"] for r in spark.read.json(f"{scratch}/snap_rejects").collect()] == ["g"]
    with pytest.raises(Exception):
        write_snapshot(nan_state, f"{scratch}/snap_nan_err", nonfinite="error")
    write_snapshot(nan_state, f"{scratch}/snap_nan_str", nonfinite="string")
    assert read_snapshot(spark, f"{scratch}/snap_nan_str").count() == 3


def test_dedupe_resent_batches(spark):
    from gaugeline.plans.catalog_requests import envelopes
    from gaugeline.plans.ingest import ingest
    from gaugeline.sources.updates import SIGNING_KEY
    req = envelopes(spark, SF_SMALL)
    twice = req.unionByName(req.withColumn("request_id", F.col("request_id") + 1_000_000))
    cols = ["type", "id", "delta", "value"]
    once = sorted(tuple(r) for r in ingest(req, SIGNING_KEY)["state"].select(*cols).collect())
    deduped = sorted(tuple(r) for r in ingest(twice, SIGNING_KEY, dedupe_batches=True)["state"].select(*cols).collect())
    doubled = {r["id"]: r["delta"] for r in ingest(twice, SIGNING_KEY)["state"].filter("type = 'counter'").collect()}
    assert deduped == once
    assert all(doubled[r[1]] == 2 * r[2] for r in once if r[0] == "counter")


def test_running_windows_never_partition_rows_by_key_alone(spark):
    """The row-level windows of echoes and as-of lookups are partitioned by
    (key, bucket); a window by key alone only runs over bucket summaries."""
    import re
    for name in ("counter_echo", "asof_lookup"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
        row_level = [w for w in windows if "_ls_" in w or "_ll_" in w]
        assert len(windows) == 2 and row_level, name
        for w in row_level:
            spec = w.split("windowspecdefinition(", 1)[1]
            partition_part = spec.split(" ASC", 1)[0]  # partition keys come before the ordering
            assert "_bkt" in partition_part, (name, w)


def test_large_batches_and_states_are_whole(spark, scratch):
    from gaugeline.operators import batch_names
    from gaugeline.sinks import signed_batches, write_snapshot, write_snapshot_array
    from gaugeline.sources import read_snapshot
    n = 10_500
    u = spark.range(n).selectExpr("1L AS batch_id", "CAST(id AS INT) AS pos", "CONCAT('m', id) AS id", "'counter' AS type",
                                  "id AS delta", "CAST(NULL AS DOUBLE) AS value")
    names = batch_names(u).collect()
    assert [(r["chunk"], len(r["names"]), r["names"][-1]) for r in names] == [(0, n, f"m{n - 1}")]
    sent = signed_batches(u, "k").collect()
    assert len(sent) == 1 and sent[0]["part"] == 0 and sent[0]["body"].count('"id"') == n
    state = u.select("type", "id", "delta", "value").unionByName(
        u.where("pos < 300").selectExpr("'gauge' AS type", "id", "CAST(NULL AS BIGINT) AS delta", "1.5D AS value"))
    write_snapshot_array(state, f"{scratch}/many", max_rows=1000)
    back = read_snapshot(spark, f"{scratch}/many", whole_array=True)
    files = back.groupBy("file").count().collect()
    assert len(files) > 5 and max(r["count"] for r in files) < 4000
    assert back.select(*state.columns).exceptAll(state).isEmpty() and back.count() == state.count()
    odd = spark.createDataFrame([("gauge", "g", None, float("nan")), ("counter", "c", 3, None)],
                                "type string, id string, delta bigint, value double")
    write_snapshot(odd, f"{scratch}/lane")
    assert [r["id"] for r in spark.read.json(f"{scratch}/lane/_rejects/v=0").collect()] == ["g"]
    assert [r["id"] for r in read_snapshot(spark, f"{scratch}/lane").collect()] == ["c"]
