"""Features of tiles as they arrive: a stream of tile files to a growing feature table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from stainloom.operators import features

TILES = "image string, height int, width int, rgb binary, labels binary"


def stream_features(spark: SparkSession, source: str, sink: str, checkpoint: str, stain: features.Normaliser | None = None, families=features.FAMILIES, files: int = 64) -> StreamingQuery:
    """Reads the tile files below ``source`` that its checkpoint hasn't seen, at most ``files`` at a time, and adds their feature rows to ``sink``.

    Each tile is done exactly once, however often the query is started: the checkpoint stands for
    the table of what exists already. Rows need no state, so there is neither a watermark nor a shuffle.
    """
    tiles = spark.readStream.schema(TILES).option("maxFilesPerTrigger", files).parquet(source)
    rows = features.full_features(tiles, "image", stain, families)
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
