"""Request counters over a stream, per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators.jobs import path_template


def windowed_metrics(requests: DataFrame, at: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests and summed durations per window, method, path template and status.

    The watermark bounds the state; counts combine before the shuffle.
    """
    timed = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(
        F.window(at, width).alias("window"), F.upper("method").alias("method"), path_template(F.col("path")).alias("path"),
        F.col("status").cast("string").alias("status"),
    ).agg(F.count(F.lit(1)).alias("requests"), F.sum("duration_s").alias("duration_s"))
