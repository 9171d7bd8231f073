"""Ranks in groups of any size: no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a bucket for each doubling of the value.
STEPS = 8


def ranked(df: DataFrame, group: str, value: str, tie: str, name: str, total: str | None = None) -> DataFrame:
    """Add ``name``: 1, 2, ... in each ``group`` by ``value`` (descending, nulls last), then ``tie``; and ``total``, the group's rows.

    A bucket is a step of the value's logarithm, so buckets are in the values' order.  Rows are ranked within (group, bucket); a small table of counts, one row for
    each pair, gives where a bucket begins.  Only rows of nearly equal values meet in one task.
    """
    v = F.col(value).cast("double")
    step = F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * STEPS).cast("int")
    rows = df.withColumn("_bucket", F.coalesce(step, F.lit(-(1 << 30))))
    counts = rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy(F.desc("_bucket"))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_total"))
    inner = Window.partitionBy(group, "_bucket").orderBy(F.col(value).desc_nulls_last(), tie)
    out = rows.withColumn("_k", F.row_number().over(inner)).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    out = out.withColumn(name, (F.col("_before") + F.col("_k")).cast("int"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_k", "_g", "_b", "_before", "_total")
