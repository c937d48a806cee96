"""Weekly rollup over a stream of daily observations.

The first-Sunday weeks are exactly Spark's 7-day tumbling windows started
3 days after the epoch (1970-01-04 was a Sunday), with the session time zone
at UTC.  So a stream of ``(variable, station, date, value)`` rolls up with a
plain ``window`` aggregate; ``(year, week)`` comes from the window start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.functions.calendar import week_number, week_year
from weekpanel.functions.numeric import stable_mean, stable_sum
from weekpanel.schemas import WEEKLY_AGG
from weekpanel.session import scratch_path

WEEK_WINDOW = ("7 days", "7 days", "3 days")


def weekly_window_agg(stream: DataFrame, agg: dict[str, str] | None = None, watermark: str | None = None) -> DataFrame:
    """Streaming ``(variable, station, year, week, value)``: mean, or sum with
    all-missing -> 0.0, per variable.  With ``watermark`` the aggregate can
    run in append mode and drop state of closed weeks."""
    agg = agg or WEEKLY_AGG
    sums = [v for v, a in agg.items() if a == "sum"]
    if watermark:  # watermarks need TIMESTAMP (session time zone UTC keeps the wall clock)
        src = stream.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", watermark)
    else:
        src = stream
    w = F.window("date", *WEEK_WINDOW)
    grouped = src.groupBy("variable", "station", w.alias("w")).agg(stable_sum("value").alias("s"), stable_mean("value").alias("a"))
    start = F.col("w.start")
    value = F.when(F.col("variable").isin(sums), F.coalesce("s", F.lit(0.0))).otherwise(F.col("a"))
    return grouped.select("variable", "station", week_year(start).alias("year"), week_number(start).alias("week"), value.alias("value"))


def weekly_rollup_stream(spark: SparkSession, obs: DataFrame, agg: dict[str, str] | None = None) -> DataFrame:
    """Land ``obs`` as files, roll them up with a streaming query, return the result table.

    The stream runs with ``availableNow`` (all landed files, then stop) in
    complete mode; every micro-batch overwrites the result folder through
    ``foreachBatch``.  Checkpoint and output live under the shared scratch root.
    """
    landing = scratch_path(spark, "obs-landing")
    obs.write.mode("overwrite").parquet(landing)
    stream = spark.readStream.schema(obs.schema).parquet(landing)
    out = scratch_path(spark, "weekly-stream")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (
        weekly_window_agg(stream, agg)
        .writeStream.outputMode("complete")
        .foreachBatch(write_batch)
        .option("checkpointLocation", scratch_path(spark, "weekly-stream-ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)
