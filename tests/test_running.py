"""Running aggregates of hot keys: ranges of the order, one exchange of whole rows."""

import pytest
from pyspark.sql import Window, functions as F

from gaugeline import operators as op
from gaugeline.operators.echo import RANGES, running_aggregates
from tests.test_skew import conf


def _packed(spark, n=60_000):
    """Updates whose order is request << 20 | position; a third are one name's.
    Requests come in two clusters far apart, and one request is very long."""
    s = spark.range(n)
    request = "CASE WHEN id < 20000 THEN id WHEN id < 40000 THEN 4000000 + id ELSE 9000000 END"
    return s.selectExpr(
        f"({request}) * (1L << 20) + CASE WHEN id < 40000 THEN id % 3 ELSE id END AS seq",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('m', id % 500) END AS id",
        "CASE WHEN id % 7 = 0 THEN 'gauge' ELSE 'counter' END AS type",
        "CASE WHEN id % 7 > 0 THEN id % 11 - 5 END AS delta", "CASE WHEN id % 7 = 0 THEN id * 0.5D END AS value")


def _naive(df):
    w = Window.partitionBy("type", "id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"s": F.sum("delta").over(w), "l": F.last("value", ignorenulls=True).over(w)})


def _exchanged(df):
    """Rows written by each exchange of the executed plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append(int(node.metrics().apply("shuffleRecordsWritten").value()))
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return sorted(found)


@pytest.mark.parametrize("span", [8, 1000, 1 << 20])
def test_ranges_equal_one_window(spark, span):
    log = _packed(spark)
    got = running_aggregates(log, ["type", "id"], "seq", sums={"delta": "s"}, lasts={"value": "l"}, span=span)
    assert got.columns == log.columns + ["s", "l"]
    assert got.exceptAll(_naive(log)).isEmpty() and got.count() == log.count()


def test_one_exchange_of_whole_rows(spark):
    log = _packed(spark)
    n = log.count()
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        got = running_aggregates(log, ["type", "id"], "seq", sums={"delta": "s"}, lasts={"value": "l"}, span=1000)
        assert len(got.collect()) == n
        rows = _exchanged(got)
    # Partial totals of the hot ranges are all that is exchanged besides.
    assert rows[-1] == n and sum(rows[:-1]) < n / 10


def test_a_hot_name_is_dealt_over_tasks(spark):
    log = _packed(spark).where("type = 'counter'")
    hot = log.where("id = 'hot'").count()
    with conf(spark, {"spark.sql.shuffle.partitions": "199", "spark.sql.adaptive.enabled": "false"}):
        run = running_aggregates(log, ["id"], "seq", sums={"delta": "s"}, span=1000)
        tasks = run.where("id = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("s").alias("n")).agg(F.max("n"), F.count("*")).first()
    # A few ranges may meet in one task by their hash.
    assert tasks[0] < 8 * hot / RANGES and tasks[1] > 80


def test_responses_of_single_updates(spark):
    log = _packed(spark, 3000).selectExpr("*", "CASE WHEN seq % 5 = 0 THEN 2 ELSE 0 END AS err_code", "'x' AS _total", "1 AS status")
    got = op.update_responses(log, span=50)
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("err_code") == 0
    want = log.withColumn("t", F.sum(F.when(ok & (F.col("type") == "counter"), F.col("delta"))).over(w)).select(
        "seq", "err_code", "status", F.when(ok, F.col("id")).alias("id"), F.when(ok, F.col("type")).alias("type"),
        F.when(ok & (F.col("type") == "counter"), F.col("t")).alias("delta"), F.when(ok & (F.col("type") == "gauge"), F.col("value")).alias("value"))
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == log.count()
