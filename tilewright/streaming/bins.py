"""Incremental binning of an event stream with watermarks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.runtime import shared_folder


def tumbling_bins(events: DataFrame, time: str, group: list[str], value: str, width: str, late: str) -> DataFrame:
    """(group, bin_start, n, total, least, most) per tumbling bin; rows that come ``late`` or more behind the newest of an earlier batch are ignored in a stream.

    Works on a batch as well, where no row is late. Null times fall into no bin.
    """
    seen = events.where(F.col(time).isNotNull()).withWatermark(time, late)
    bins = seen.groupBy(*group, F.window(time, width).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return bins.select(*group, F.col("_w.start").alias("bin_start"), "n", "total", "least", "most")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Appends a stream to the Parquet folder ``sink`` until its present input is used up; a restart goes on from ``checkpoint``.

    A bin is written once, when the watermark has passed its end, and its state is dropped then. Bins that are still open stay in the
    state until later rows close them. The file sink commits each batch once, whatever fails in between.
    """
    query = stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def closing_row(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """One row of ``events`` that is null but for ``time``, which lies so far behind the newest event that it closes every bin."""
    newest = events.agg(F.max(time).alias("t")).where("t is not null")
    after = F.col("t") + F.expr(f"interval {width}") + F.expr(f"interval {width}") + F.expr(f"interval {late}")
    return newest.select(*[(after if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])


def tumbling_bins_once(spark: SparkSession, path: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The bins of a Parquet file or folder of events (ts, event_type, value), read as a stream to its end.

    What is there is one batch, within which no row is late; a closing row follows from a second folder, so that all bins are written.
    """
    held = spark.read.parquet(path)
    base = f"{shared_folder(spark)}/stream-{os.urandom(8).hex()}"
    folder, name = path.rstrip("/").rsplit("/", 1)
    if not name.endswith(".parquet") or _is_folder(spark, path):
        folder, name = path, "*.parquet"
    held.limit(0).write.parquet(f"{base}/closing")

    def run() -> None:
        parts = [spark.readStream.schema(held.schema).option("pathGlobFilter", n).parquet(f) for f, n in ((folder, name), (f"{base}/closing", "*.parquet"))]
        events = parts[0].unionByName(parts[1]).withColumn("ts", F.col("ts").cast("timestamp"))
        run_to_end(tumbling_bins(events, "ts", ["event_type"], "value", width, late), f"{base}/out", f"{base}/checkpoint")

    run()
    closing_row(held, "ts", width, late).write.mode("append").parquet(f"{base}/closing")
    run()
    return spark.read.parquet(f"{base}/out").withColumn("bin_start", F.col("bin_start").cast("timestamp_ntz"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    """By the file system of the path, which may be any that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
