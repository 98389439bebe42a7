"""Count maps over arriving points. Counts add up, so the stream's result equals the batch's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.coordinates import map_between_grids, zero_based_xyz
from ..model import SpaceDefinition, in_grid


def streaming_count_map(points: DataFrame, source: SpaceDefinition, target: SpaceDefinition) -> DataFrame:
    """(vx, vy, vz, value) of a stream of points; for complete or update mode."""
    placed = map_between_grids(points.select(*zero_based_xyz(source)), source, target).where(in_grid(target))
    return placed.groupBy("vx", "vy", "vz").agg(F.count("*").alias("value"))


def windowed_count_map(points: DataFrame, source: SpaceDefinition, target: SpaceDefinition, *, time_column: str, window: str, delay: str) -> DataFrame:
    """The same per event-time window, for append mode: a window's counts come when the watermark has passed it."""
    placed = points.withWatermark(time_column, delay).select(F.window(time_column, window).alias("window"), *zero_based_xyz(source))
    placed = map_between_grids(placed, source, target).where(in_grid(target))
    return placed.groupBy("window", "vx", "vy", "vz").agg(F.count("*").alias("value"))


def start_count_map(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest complete map as Parquet under ``path``; each batch replaces it."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).start()
