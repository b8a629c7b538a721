import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    ck = tempfile.mkdtemp(prefix="gaugeline-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("gaugeline-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", ck)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="gaugeline-test-")


def metric_rows(spark, rows, extra="seq bigint, batch_id bigint, pos int"):
    """Small DataFrame of update rows: (seq, batch_id, pos, id, type, delta, value)."""
    return spark.createDataFrame(rows, f"{extra}, id string, type string, delta bigint, value double")
