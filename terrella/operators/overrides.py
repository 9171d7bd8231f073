"""Author overrides on canonical tables: resolve, apply, upsert, delete."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .joins import first_per, near_join

MAX_KM, WARN_KM = 75.0, 15.0


def resolve(overrides: DataFrame, canon: DataFrame) -> DataFrame:
    """``key``, ``match_id``, ``how`` (id, coords, none), ``km`` and ``warn`` of each override.

    An id stands if it is one canon row's and that row is no farther than 75 km from the anchor (or there is no
    anchor); else the nearest row within 75 km of the anchor; else none.  Between 15 and 75 km there is a warning.
    """
    c = canon.select(F.col("id").alias("c_id"), F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    unique = c.groupBy("c_id").agg(F.count(F.lit(1)).alias("n"), F.min("c_lon").alias("c_lon"), F.min("c_lat").alias("c_lat")).filter("n = 1")
    by_id = overrides.join(unique, F.col("settlement_id") == F.col("c_id"), "left")
    km = F.round(geo.haversine_km(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat")), 6)
    anchored = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    by_id = by_id.withColumn("km", F.when(anchored, km))
    good = F.col("c_id").isNotNull() & (~anchored | (F.col("km") <= MAX_KM))
    firm = by_id.filter(good).select("key", F.col("c_id").alias("match_id"), F.lit("id").alias("how"), "km")
    rest = overrides.join(firm.select("key"), "key", "left_anti")
    close = near_join(rest.filter(anchored).select("key", "lon", "lat"), c, MAX_KM, ("lon", "lat"), ("c_lon", "c_lat"))
    close = first_per(close, ["key"], [F.col("km"), F.col("c_id")]).select("key", F.col("c_id").alias("match_id"), F.lit("coords").alias("how"), "km")
    found = firm.unionByName(close)
    out = overrides.select("key").join(found, "key", "left").withColumn("how", F.coalesce("how", F.lit("none")))
    return out.withColumn("warn", F.coalesce(F.col("km") > WARN_KM, F.lit(False)))


def normalise(raw: DataFrame) -> DataFrame:
    """Blank text is no override; numbers that cannot be read are none."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return raw.select("settlement_id", blank("name").alias("name"), F.expr("try_cast(population AS DOUBLE)").alias("population"))


def _last(part: str) -> Column:
    """The part that the last row by key gives; rows without it do not count."""
    return F.max_by(F.col(part), F.when(F.col(part).isNotNull(), F.col("key")))


def apply(canon: DataFrame, resolved: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """Canon rows with what their overrides give; blank or missing parts leave canon as it is.

    ``resolved``: match_id, key and of name, inkarnate and population those there are; ``moved``: match_id, key, new_lon, new_lat.
    Both are resolved against canon as it stood.  Where several rows resolve to one, the last by key that gives a part gives it.
    """
    parts = {"name": "name", "inkarnate": "inkarnate", "population": "pop"}
    given = {o: c for o, c in parts.items() if o in resolved.columns and c in canon.columns}
    o = resolved.filter(F.col("match_id").isNotNull()).groupBy(F.col("match_id").alias("id")).agg(*[_last(g).alias(f"_{g}") for g in given])
    out = canon.join(o, "id", "left")
    out = out.withColumns({c: F.coalesce(F.col(f"_{g}").cast(canon.schema[c].dataType), F.col(c)) for g, c in given.items()})
    if moved is not None:
        m = moved.filter("match_id is not null and new_lon is not null and new_lat is not null").groupBy(F.col("match_id").alias("id"))
        out = out.join(m.agg(_last("new_lon").alias("_lon"), _last("new_lat").alias("_lat")), "id", "left")
        out = out.withColumns({"lon": F.coalesce("_lon", "lon"), "lat": F.coalesce("_lat", "lat")})
    return out.select(*canon.columns)


def applied(resolved: DataFrame, moved: DataFrame) -> DataFrame:
    """One row: how many names, links, populations and moves found their row."""
    n = lambda c: F.count_if(F.col("match_id").isNotNull() & F.col(c).isNotNull())
    return resolved.agg(n("name").alias("names"), n("inkarnate").alias("links"), n("population").alias("populations")).crossJoin(moved.agg(n("new_lon").alias("moves")))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` with those of ``changes`` in their place or added; columns of the former.

    A change that gives nothing but its key takes the row away.
    """
    kept = changes.select(*table.columns)
    parts = [F.col(c).isNotNull() for c in table.columns if c != key]
    if parts:
        kept = kept.filter(reduce(or_, parts))
    return table.join(changes.select(key), key, "left_anti").unionByName(kept)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``table`` without the keys; unknown keys change nothing."""
    return table.join(keys.select(key), key, "left_anti")


def free_numbers(table: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` lowest numbers from 1 that no row has, as ``free``.

    Each of them is one of the first ``n`` or at most ``n`` above a number used: so candidates follow the rows, however high their numbers are.
    """
    used = table.select(F.col(key).cast("long").alias("free")).filter("free > 0").distinct()
    after = used.select(F.explode(F.sequence(F.col("free") + 1, F.col("free") + n)).alias("free"))
    first = table.sparkSession.range(1, n + 1).toDF("free")
    return after.unionByName(first).distinct().join(used, "free", "left_anti").orderBy("free").limit(n)


def next_id(table: DataFrame, key: str) -> DataFrame:
    return table.agg(F.coalesce(F.max(key) + 1, F.lit(1).cast("long")).alias("next_id"))
