"""The heat trend over a stream of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heatloom.operators.feeds import TREND_STEP, heat_trend
from heatloom.session import scratch_path


def stream_trend(rows: DataFrame, time: str, key: str, value: str, step: str = TREND_STEP,
                 lateness: str = "1 day") -> DataFrame:
    """The trend of a streaming table; a step is final once ``lateness`` has passed behind it."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return heat_trend(timed, time, key, value, step)


def write_available(trend: DataFrame, path: str, state_path: str | None = None) -> StreamingQuery:
    """Append the finished steps of everything available now to a parquet table, then stop."""
    spark: SparkSession = trend.sparkSession
    state_path = state_path or scratch_path(spark, "trend-state")
    return (
        trend.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", state_path)
        .trigger(availableNow=True).start()
    )
