"""Sinks: tiles, pyramids, tables by tier, colour tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar


def write_tiles(tiles: DataFrame, path: str, layer: str) -> None:
    """Append tiles to the store: Parquet by layer and zoom, one row for each tile."""
    tiles.withColumn("layer", F.lit(layer)).write.mode("append").partitionBy("layer", "z").parquet(path)


def missing_tiles(requests: DataFrame, store: DataFrame, since=None) -> DataFrame:
    """Tiles asked for that the store lacks or has only from before ``since`` (column ``made``)."""
    have = store if since is None else store.filter(F.col("made") >= since)
    return requests.select("z", "x", "y").distinct().join(have.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_anti")


def pyramid_level(tiles: DataFrame, value: str, classes: bool = False) -> DataFrame:
    """The level above: the mean of each two by two, or for classes the upper left one."""
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    best = F.min_by(value, F.struct("y", "x")) if classes else F.avg(value)
    return tiles.groupBy((F.col("z") - 1).alias("z"), half("x"), half("y")).agg(best.alias(value))


def write_by_tier(df: DataFrame, path: str, tier: str = "tier") -> None:
    df.write.mode("overwrite").partitionBy(tier).json(path)


def color_table(stops: DataFrame) -> DataFrame:
    """Lines ``stop r g b a`` (columns stop, color), opaque unless the colour ends in 00, after the line for no data."""
    alpha = F.when(F.length("color") == 9, scalar.channel(F.col("color"), 3)).otherwise(255)
    line = F.concat_ws(" ", F.col("stop").cast("string"), *[scalar.channel(F.col("color"), i).cast("string") for i in range(3)], alpha.cast("string"))
    head = stops.sparkSession.createDataFrame([(None, "nv 0 0 0 0")], "stop double, value string")
    return head.unionByName(stops.select(F.col("stop").cast("double").alias("stop"), line.alias("value"))).orderBy(F.col("stop").asc_nulls_first()).select("value")


def write_features(df: DataFrame, props: list[str], path: str) -> bool:
    """Drawn features as GeoJSON lines; with none the old file goes.  Whether anything was written."""
    from .geojson import write_features as write

    if df.isEmpty():
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return False
    write(df, props, path)
    return True
