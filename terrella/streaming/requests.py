"""Tile requests as a stream: an extension, as the map itself has no streams.

Each micro-batch renders the tiles asked for that the store lacks and appends them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.render import render
from ..sources.sinks import missing_tiles, write_tiles
from ..sources.tables import optional

REQUEST = "z int, x long, y long, at timestamp"


def serve(spark: SparkSession, source: str, chunks: DataFrame, store: str, checkpoint: str, layer: str = "elevation", trigger: dict | None = None) -> StreamingQuery:
    """Watch a folder of Parquet requests; a tile rendered once is not rendered again, also after a restart."""

    def batch(asked: DataFrame, _: int) -> None:
        have = optional(spark, f"{store}/layer={layer}", "x long, y long, png binary, z int")
        fresh = missing_tiles(asked, have)
        write_tiles(render(fresh, chunks, layer), store, layer)

    requests = spark.readStream.schema(REQUEST).parquet(source)
    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def demand(requests: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Requests for each zoom and window of time; rows later than the watermark are left out."""
    return requests.withWatermark("at", late).groupBy(F.window("at", window), "z").agg(F.count(F.lit(1)).alias("n")).select("window.start", "z", "n")
