"""Rows of a large table: for a set of ids, by a hash sample, beside a side table with hot keys; none brings a group into one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 4 MB whatever the input, so that it can be broadcast.  With more ids it only lets more rows through.
BITS = 1 << 25


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BITS)) + 1


def _as_words(batches):
    """Bitmaps as arrays of 64-bit words, which are quicker to look up in."""
    for batch in batches:
        maps = batch.column("_bits").to_pylist()
        words = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(m, "<i8") for m in maps)])
        ends = np.cumsum([0, *(len(m) // 8 for m in maps)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("_bucket"), pa.ListArray.from_arrays(pa.array(ends), pa.array(words))], ["_bucket", "_words"])


def sift(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The ``table`` rows whose ``key`` is among the ``id`` of ``ids``, and some others.

    A bitmap of hashed ids, built by a combined aggregate (BITS / 32768 rows of 4 KB), drops most
    other rows where they are read.
    """
    bits = ids.select(_slot(F.col("id")).alias("s"))
    maps = bits.groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    maps = maps.mapInArrow(_as_words, "_bucket long, _words array<long>")
    slot = _slot(F.col(key))
    at = F.bitmap_bit_position(slot)
    near = table.withColumn("_to", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), F.col("_to") == F.col("_bucket"))
    return near.filter(F.getbit(F.col("_words")[F.shiftright(at, 6).cast("int")], (at % 64).cast("int")) == 1).drop("_to", "_bucket", "_words")


def rows_of(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``table`` rows whose ``key`` is among the ``id`` of ``ids``: those that ``sift`` lets through, less the others by an exact join."""
    near = sift(table, key, ids)
    return near.join(ids.hint("merge"), near[key] == ids["id"], "left_semi")


def sample_by_hash(rows: DataFrame, size: int, *key: str) -> DataFrame:
    """About ``size`` of the distinct ``key`` there are (all, if fewer), with all their rows: those with the least hash.

    The number of keys is estimated, so ``size`` is met within some 5 % (and chance); a filter where rows are read, nothing is sorted.
    """
    h = F.xxhash64(*key)
    n = rows.agg(F.approx_count_distinct(h)).first()[0]
    return rows if n <= size else rows.filter(below(h, size / n))


def below(h: Column, share: float) -> Column:
    """Whether a 64-bit hash is among the least ``share`` of all, as unsigned."""
    return F.shiftrightunsigned(h, 1) < F.lit(min(int(share * 2**63), 2**63 - 1))


#: A key with more than this share of the rows is hot; there are at most as many hot keys.  They are looked for in a sample of so many rows' share.
HOT, SAMPLED = 1000, 64


def hot_keys(rows: DataFrame, keys: list[str], spread: list[str]) -> DataFrame | None:
    """The ``keys`` of a materialised table that many rows bear, at most ``HOT``, from a hash sample of the rows by ``spread``; null if there are none.

    The sample only decides by which join a row meets its side.
    """
    counts = rows.filter(below(F.xxhash64(*spread), 1 / SAMPLED)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    least = max(16.0, rows.count() / SAMPLED / HOT)
    got = counts.filter(F.col("n") > least).orderBy(F.desc("n"), *keys).limit(HOT).collect()
    return rows.sparkSession.createDataFrame([tuple(r)[: len(keys)] for r in got], rows.select(*keys).schema) if got else None


def join_split(rows: DataFrame, side: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """``rows`` joined to ``side``, which has at most one row for each key: rows of ``hot`` keys by a broadcast of those keys' sides, the others by a shuffle.

    So no task gets all rows of a hot key.
    """
    if hot is None:
        return rows.join(side, keys)
    hot = F.broadcast(hot)
    few = F.broadcast(side.join(hot, keys, "left_semi"))
    return rows.join(hot, keys, "left_anti").join(side, keys).unionByName(rows.join(few, keys))
