"""Poll ticks per report window (STR-4), batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.session import checkpoint_root


def poll_windows(samples: DataFrame, producer: str, ts: str, value: str, seq: str,
                 width: str = "10 seconds", watermark: str | None = None) -> DataFrame:
    """Per producer and tumbling window: ``poll_count`` (polls since the
    last report) and ``last_value`` (reading at report time, by ``seq``).

    On a stream, pass ``watermark`` so windows close and append mode can
    emit them; late rows beyond it are dropped by Spark.
    """
    # Naive timestamps window by wall clock, whatever the session zone.  A
    # watermark needs a zoned TIMESTAMP, so the stream form casts (the
    # session zone then decides where hours start).
    df = samples
    if watermark:
        df = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return (df.groupBy(producer, F.window(ts, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("poll_count"), F.max_by(value, seq).alias("last_value"))
            .select(producer, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "poll_count", "last_value"))


def start_poll_windows(samples: DataFrame, producer: str, ts: str, value: str, seq: str,
                       width: str, watermark: str, query_name: str, checkpoint: str | None = None,
                       sink: str = "memory", trigger: dict | None = None):
    """STR-4 on a stream: append mode emits each window once the watermark
    passes its end."""
    ck = checkpoint or f"{checkpoint_root(samples.sparkSession)}/streams/{query_name}"
    out = poll_windows(samples, producer, ts, value, seq, width, watermark)
    return (out.writeStream.outputMode("append").format(sink).queryName(query_name)
            .option("checkpointLocation", ck).trigger(**(trigger or {"availableNow": True})).start())
