"""Where a derived table came from, and when it must be made again."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(*cols: Column | str) -> Column:
    """A digest of texts in order."""
    return F.md5(F.concat_ws("|", *cols))


def combined(group_cols: list[str], df: DataFrame, name: str, value: str) -> DataFrame:
    """One digest for each group, of its components sorted by name: the order they came in cannot show."""
    parts = F.array_sort(F.collect_list(F.concat_ws("=", name, value)))
    return df.groupBy(*group_cols).agg(F.md5(F.concat_ws("|", parts)).alias("combined"))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``change``: moved, added or gone components (columns keys and digest)."""
    a, b = old.withColumnRenamed("digest", "_old"), new.withColumnRenamed("digest", "_new")
    c = F.when(F.col("_new").isNull(), "gone").when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col("_new"), "moved")
    return a.join(b, keys, "full").withColumn("change", c).filter("change is not null").drop("_old", "_new")


def why(old: dict[str, str] | None, new: dict[str, str]) -> str:
    """What moved, came and went, in that order; empty if nothing."""
    if old is None:
        return "no stamp"
    parts = [
        ("moved", sorted(k for k in old.keys() & new.keys() if old[k] != new[k])),
        ("added", sorted(new.keys() - old.keys())),
        ("gone", sorted(old.keys() - new.keys())),
    ]
    return "; ".join(f"{what}: {', '.join(names)}" for what, names in parts if names)


def code_digest(source: str) -> str:
    """A digest of Python code as parsed: comments and white space do not count."""
    return hashlib.md5(ast.dump(ast.parse(source)).encode()).hexdigest()


def constant_digest(value) -> str:
    return hashlib.md5(json.dumps(value, sort_keys=True, default=repr).encode()).hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name and digest of files by their content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("digest"))


def stamp(components: dict[str, str]) -> dict:
    items = sorted(components.items())
    return {"components": dict(items), "combined": hashlib.md5("|".join(f"{k}={v}" for k, v in items).encode()).hexdigest()}


class DerivedTable:
    """A Parquet table with a stamp beside it: read while the stamp holds, else made again.

    The table is written beside its place and renamed, so a failed build leaves the old one. A missing or unreadable stamp is a miss, never an error.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def stamp(self) -> dict | None:
        try:
            rows = self.spark.read.text(f"{self.path}.stamp").collect()
            return json.loads(rows[0]["value"])
        except (AnalysisException, ValueError, LookupError):  # absent or corrupt: the table is made again
            return None

    def explain(self, components: dict[str, str]) -> str:
        old = self.stamp()
        return why(old["components"] if old else None, components)

    def get(self, components: dict[str, str], build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        if force or self.explain(components):
            fresh = f"{self.path}.new"
            build().write.mode("overwrite").parquet(fresh)
            old = self._path(f"{self.path}.old")
            self._fs.delete(old, True)
            self._fs.delete(self._path(f"{self.path}.stamp"), True)  # without a stamp a half-done change is a miss
            there = self._fs.exists(self._path(self.path))
            if there and not self._fs.rename(self._path(self.path), old):
                raise OSError(f"cannot rename {self.path}")
            if not self._fs.rename(self._path(fresh), self._path(self.path)):
                if there:
                    self._fs.rename(old, self._path(self.path))
                raise OSError(f"cannot rename {fresh}")
            self._fs.delete(old, True)
            self.spark.createDataFrame([(json.dumps(stamp(components)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}.stamp")
        return self.spark.read.parquet(self.path)


#: The boundary of a cache taken as current: no tile is older.
ADOPTED = 0.0


def stale(tiles: DataFrame, boundary: float | None, made: str = "made") -> DataFrame:
    """Tiles made before the boundary; without one, or where the time is unknown, none: doubt never holds up a request."""
    return tiles.filter(F.col(made) < F.lit(boundary)) if boundary is not None else tiles.filter(F.lit(False))


class RenderStamp:
    """What tiles were rendered by, in a small file, and the time before which a tile is stale.  Nothing is deleted by it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, components: dict[str, str], boundary: float) -> float:
        self.spark.createDataFrame([(json.dumps(stamp(components) | {"boundary": boundary}),)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
        return boundary

    def read(self) -> dict | None:
        """The stamp; none if the file is absent or cannot be understood."""
        try:
            found = json.loads(self.spark.read.text(self.path).collect()[0]["value"])
            return found if isinstance(found["components"], dict) and isinstance(found["boundary"], (int, float)) else None
        except (AnalysisException, ValueError, LookupError, TypeError):
            return None

    def sync(self, components: dict[str, str], now: float, adopt: bool = True) -> tuple[float, str]:
        """The boundary and what happened to it.

        An equal stamp keeps it.  The first stamp ever takes the tiles there are as current, or with ``adopt`` false as stale; a stamp that
        cannot be read or differs makes them stale.
        """
        had, old = self._fs.exists(self._path), self.read()
        if not had:
            return self._write(components, ADOPTED if adopt else now), "adopted" if adopt else "condemned"
        if old is None:
            return self._write(components, now), "unreadable"
        moved = why(old["components"], components)
        return (self._write(components, now), moved) if moved else (old["boundary"], "")

    def invalidate(self, components: dict[str, str], now: float) -> float:
        """Every tile is made again when next asked for; a stamp that is there keeps its components."""
        old = self.read()
        return self._write(old["components"] if old else components, now)

    def adopt(self, components: dict[str, str]) -> float:
        """The tiles count as made by these components: only right where that has been shown."""
        return self._write(components, ADOPTED)
