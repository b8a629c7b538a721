"""Structured Streaming forms: equal to their batch forms, restartable."""

import os

from pyspark.sql import functions as F

from gaugeline import operators as op
from gaugeline.plans.ingest import ingest
from gaugeline.sinks import write_audit
from gaugeline.sources import batch_bodies, request_envelopes, update_log
from gaugeline.sources.state import current_version, read_state, write_state_version
from gaugeline.sources.updates import SIGNING_KEY
from gaugeline.streaming import (apply_epoch, start_batch_apply, start_continuous_fold, start_periodic_snapshot,
                                 start_poll_windows)
from gaugeline.streaming.ticks import poll_windows
from tests.conftest import SF_SMALL

COLS = ["type", "id", "delta", "value"]


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet")


def _event_files(spark, scratch, n=10):
    ev = _events(spark)
    path = f"{scratch}/events_json"
    ev.repartitionByRange(n, "event_id").sortWithinPartitions("event_id").write.json(path)
    return path, ev.schema


def test_continuous_fold_equals_batch(spark, scratch):
    path, schema = _event_files(spark, scratch)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    q = start_continuous_fold(update_log(stream), "fold_stream", checkpoint=f"{scratch}/ck", output_mode="complete")
    q.awaitTermination()
    expected = op.fold_state(op.lenient_filter(update_log(_events(spark))))
    assert _rows(spark.table("fold_stream"), COLS) == _rows(expected, COLS)


def test_periodic_snapshot(spark, scratch):
    path, schema = _event_files(spark, scratch, n=4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    root = f"{scratch}/state"
    q = start_periodic_snapshot(update_log(stream), root, checkpoint=f"{scratch}/ck", interval=None)
    q.awaitTermination()
    assert current_version(spark, root) == 3
    expected = op.fold_state(op.lenient_filter(update_log(_events(spark))))
    assert _rows(read_state(spark, root).select(*COLS), COLS) == _rows(expected, COLS)


def _request_files(spark, scratch, parts=6):
    req = request_envelopes(batch_bodies(update_log(_events(spark))))
    path = f"{scratch}/requests"
    req.repartitionByRange(parts, "request_id").sortWithinPartitions("request_id").write.parquet(path)
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    # Arrival order is file order: a stream applies later files later, and
    # the last write in arrival order wins, as in the service.
    for i, f in enumerate(files):
        os.utime(f"{path}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    return req, path, files


def test_batch_apply_stream_with_restart(spark, scratch):
    req, path, files = _request_files(spark, scratch)
    schema = spark.read.parquet(path).schema
    first, rest = f"{scratch}/in", files[3:]
    os.makedirs(first)
    for f in files[:3]:
        os.link(f"{path}/{f}", f"{first}/{f}")
    root, ck, audit_dir = f"{scratch}/state", f"{scratch}/ck", f"{scratch}/audit"
    failures = []

    def bad_sink(df):
        failures.append(1)
        raise RuntimeError("sink down")

    sinks = [lambda df: write_audit(df, audit_dir), bad_sink]

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(first)
        start_batch_apply(s, root, SIGNING_KEY, sinks, checkpoint=ck).awaitTermination()

    run()
    v1 = current_version(spark, root)
    for f in rest:  # more requests arrive; the query restarts from its checkpoint
        os.link(f"{path}/{f}", f"{first}/{f}")
    run()
    assert current_version(spark, root) > v1
    expected = ingest(spark.read.parquet(path), SIGNING_KEY)
    assert _rows(read_state(spark, root).select(*COLS), COLS) == _rows(expected["state"], COLS)
    assert spark.read.json(audit_dir).count() == expected["audit"].count()
    assert failures  # the failing sink was called and did not stop the others


def _stored(spark, root, versions=3):
    """A store whose newest version is the third one."""
    for n in range(versions):
        write_state_version(spark.createDataFrame(
            [("counter", "hits_view", 100 * (n + 1), None), ("counter", "only_stored", 7, None), ("gauge", "kept", None, 1.5)],
            "type string, id string, delta bigint, value double"), root)
    return read_state(spark, root).select(*COLS)


def test_batch_apply_on_existing_store(spark, scratch):
    req, path, files = _request_files(spark, scratch)
    schema = spark.read.parquet(path).schema
    root = f"{scratch}/state"
    base = _stored(spark, root)
    once = ingest(spark.read.parquet(path), SIGNING_KEY)["state"]

    def run(ck):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(path)
        start_batch_apply(s, root, SIGNING_KEY, checkpoint=f"{scratch}/{ck}").awaitTermination()
        return _rows(read_state(spark, root).select(*COLS), COLS)

    with_base = op.merge_state(base, once.withColumn("seq", F.lit(0)))
    expected = _rows(with_base, COLS)
    assert run("ck1") == expected
    assert current_version(spark, root) == 4
    assert run("ck1") == expected                      # restart: nothing new
    assert run("ck2") == _rows(op.merge_state(with_base, once.withColumn("seq", F.lit(1))), COLS)  # fresh checkpoint
    before = current_version(spark, root)
    batch = spark.read.parquet(f"{path}/{files[0]}")
    for _ in range(2):                                 # a replayed epoch is applied once
        apply_epoch(batch, 9, root, SIGNING_KEY, writer="w")
    assert current_version(spark, root) == before + 1


def test_periodic_snapshot_on_existing_store(spark, scratch):
    path, schema = _event_files(spark, scratch, n=2)
    root = f"{scratch}/state"
    base = _stored(spark, root)
    once = op.fold_state(op.lenient_filter(update_log(_events(spark))))

    def run(ck):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
        start_periodic_snapshot(update_log(stream), root, checkpoint=f"{scratch}/{ck}", interval=None).awaitTermination()
        return _rows(read_state(spark, root).select(*COLS), COLS)

    with_base = op.merge_state(base, once.withColumn("seq", F.lit(0)))
    assert run("ck1") == _rows(with_base, COLS)
    assert current_version(spark, root) == 4
    assert run("ck1") == _rows(with_base, COLS)
    assert run("ck2") == _rows(op.merge_state(with_base, once.withColumn("seq", F.lit(1))), COLS)


def test_empty_version_and_unreadable_store(spark, scratch):
    root = f"{scratch}/state"
    write_state_version(_stored(spark, root).limit(0), root)
    assert current_version(spark, root) == 3 and read_state(spark, root).count() == 0
    assert current_version(spark, f"{scratch}/none") is None


def test_poll_windows_stream(spark, scratch):
    path, schema = _event_files(spark, scratch, n=5)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
    q = start_poll_windows(stream, "user_id", "ts", "value", "event_id", "1 hour", "0 seconds",
                           "polls", checkpoint=f"{scratch}/ck")
    q.awaitTermination()
    got = spark.table("polls")
    batch = poll_windows(_events(spark), "user_id", "ts", "value", "event_id", "1 hour")
    cols = ["user_id", "window_start", "poll_count", "last_value"]
    emitted = _rows(got, cols)
    assert emitted and set(emitted) <= set(_rows(batch, cols))


def test_incremental_apply_with_restart_and_compaction(spark, scratch):
    from gaugeline.streaming import compact, read_current, start_audit_stream, start_incremental_apply
    req, path, files = _request_files(spark, scratch)
    schema = spark.read.parquet(path).schema
    inbox = f"{scratch}/in"
    os.makedirs(inbox)
    for f in files[:3]:
        os.link(f"{path}/{f}", f"{inbox}/{f}")
    root, audit_dir = f"{scratch}/inc", f"{scratch}/audit"

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(inbox)
        start_incremental_apply(s, root, SIGNING_KEY, checkpoint=f"{scratch}/ck1").awaitTermination()
        s2 = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(inbox)
        start_audit_stream(s2, SIGNING_KEY, [lambda df: write_audit(df, audit_dir)],
                           checkpoint=f"{scratch}/ck2").awaitTermination()

    run()
    compact(spark, root)
    for f in files[3:]:
        os.link(f"{path}/{f}", f"{inbox}/{f}")
    run()
    expected = ingest(spark.read.parquet(path), SIGNING_KEY)
    assert _rows(read_current(spark, root), COLS) == _rows(expected["state"], COLS)
    assert spark.read.json(audit_dir).count() == expected["audit"].count()
    # each epoch wrote only the keys it changed, not the whole state
    per_epoch = spark.read.parquet(f"{root}/changes").groupBy("epoch").count().collect()
    assert len(per_epoch) >= 2
