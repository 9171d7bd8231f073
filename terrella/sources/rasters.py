"""Coarse world layers stored as chunks, read by window."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import from_chunks

RESOLUTIONS = {"01": 0.1, "05": 0.05, "025": 0.025}


def read_window(spark: SparkSession, path: str, layers: list[str], rows: tuple[int, int], cols: tuple[int, int], side: int) -> DataFrame:
    """Long cells (layer, row, col, value) of some layers within a window.

    Chunks are stored by layer and sorted by number, so the layer list prunes folders and the
    bounds prune row groups; a layer that is absent gives no rows.
    """
    chunks = spark.read.parquet(path).filter(F.col("layer").isin(layers))
    chunks = chunks.filter(F.col("chunk_row").between(rows[0] // side, rows[1] // side) & F.col("chunk_col").between(cols[0] // side, cols[1] // side))
    out = None
    for name in layers:
        cells = from_chunks(chunks.filter(F.col("layer") == name), side).withColumn("layer", F.lit(name))
        out = cells if out is None else out.unionByName(cells)
    return out.filter(F.col("row").between(*rows) & F.col("col").between(*cols)).select("layer", "row", "col", "value")


def write_chunks(chunks: DataFrame, path: str, layer: str) -> None:
    chunks.withColumn("layer", F.lit(layer)).sortWithinPartitions("chunk_row", "chunk_col").write.mode("append").partitionBy("layer").parquet(path)


def water_path(root: str, resolution: str = "01") -> str:
    """The canonical water layer's place at a resolution."""
    if resolution not in RESOLUTIONS:
        raise ValueError(f"no water layer at resolution {resolution!r}")
    return f"{root}/water_class_{resolution}"


def map_root(default: str | None = None, must_exist: bool = True) -> str:
    """The map's folder: the environment's, else the one named in a file ``.map-root`` here, else the default."""
    root = os.environ.get("TERRELLA_MAP_ROOT")
    if not root and os.path.exists(".map-root"):
        with open(".map-root") as f:
            root = f.read().strip()
    root = root or default
    if not root:
        raise FileNotFoundError("no map root: set TERRELLA_MAP_ROOT or write .map-root")
    if must_exist and "://" not in root and not os.path.isdir(root):
        raise FileNotFoundError(f"the map root {root} does not exist")
    return root
