"""A snapshot of measured sites kept up to date from a stream of site records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.state import last_written, reuse_plan
from ..sources.scans import optional

COLUMNS = ["site_id", "lon", "lat", "elevation_m", "river_distance_m", "river_name", "river_note"]


def version(spark: SparkSession, folder: str, epoch: int, like: DataFrame) -> DataFrame:
    """The snapshot that an epoch left, empty before the first."""
    return optional(spark, f"{folder}/v{epoch}", like.schema)


def update(folder: str, measure: Callable[[DataFrame], DataFrame], like: DataFrame) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: measures only sites that are new or have moved.

    Each epoch writes its own version from the one before, so an epoch that
    runs twice gives the same files.  ``measure`` adds the measured columns to
    (site_id, lon, lat).
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = version(spark, folder, epoch - 1, like)
        sites = last_written(batch, "site_id", "ordinal").select("site_id", "lon", "lat")
        plan = reuse_plan(sites, old)
        todo = F.col("todo_elevation") | F.col("todo_river")
        fresh = measure(plan.where(todo).select("site_id", "lon", "lat")).select(*COLUMNS)
        rest = old.join(sites, "site_id", "left_anti").select(*COLUMNS)
        rest.unionByName(plan.where(~todo).select(*COLUMNS)).unionByName(fresh).write.mode("overwrite").parquet(f"{folder}/v{epoch}")

    return run


def maintain(stream: DataFrame, folder: str, checkpoint: str, measure: Callable[[DataFrame], DataFrame], like: DataFrame) -> StreamingQuery:
    """Starts the stream of (site_id, lon, lat, ordinal); one version of the snapshot for each micro-batch."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(update(folder, measure, like)).start()


def strikes(stream: DataFrame, ts: str, code: str, late: str, window: str) -> DataFrame:
    """Streaming counts of failures by code in windows, with a watermark; codes that fail twice in a window need a rule."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, window), code).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), code, "n", (F.col("n") >= 2).alias("needs_rule"))
