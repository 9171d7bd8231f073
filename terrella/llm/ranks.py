"""Gapless numbers in groups of any size, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gapless(df: DataFrame, group: str, spread: Column, order: list[Column | str], name: str, buckets: int | None = None) -> DataFrame:
    """Add ``name``: 0, 1, ... in each ``group``, in order of (bucket of ``spread``, ``order``).

    Rows are numbered within (group, bucket); a small table of counts, one row for each
    pair, gives where each bucket begins.  A group that holds all rows is still dealt over all buckets.
    ``df`` must not change between reads, so pass a materialised table.
    """
    n = buckets or 2 * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    counts = b.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = b.withColumn("_k", F.row_number().over(inner) - 1)
    on = ranked[group].eqNullSafe(bases["_g"]) & (ranked["_bucket"] == bases["_b"])
    return ranked.join(bases, on, "left").withColumn(name, (F.col("_base") + F.col("_k")).cast("long")).drop("_bucket", "_k", "_g", "_b", "_base")
