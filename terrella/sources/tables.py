"""Table sources: required columns are asserted, missing optional ones are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERRIDE_SCHEMA = "settlement_id string, name string, inkarnate string, notes string, population string, lon string, lat string, phonology_seed string"


def backfill(df: DataFrame, schema: dict[str, str], required: list[str]) -> DataFrame:
    """The columns of ``schema`` with its types; those absent are null, but the required must be there."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def settlements(spark: SparkSession, path: str) -> DataFrame:
    """Settlements need an id; images may be unset."""
    df = spark.read.parquet(path)
    if "settlement_id" not in df.columns:
        raise ValueError("settlements have no settlement_id")
    return df if "inkarnate" in df.columns else df.withColumn("inkarnate", F.lit(None).cast("string"))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may be absent: then it is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def hex_tiers(tiers: list[DataFrame]) -> DataFrame:
    """One table from a list of tiers, numbered from 1."""
    out = tiers[0].withColumn("tier", F.lit(1))
    for i, t in enumerate(tiers[1:], 2):
        out = out.unionByName(t.withColumn("tier", F.lit(i)), allowMissingColumns=True)
    return out


def overrides_csv(spark: SparkSession, path: str) -> DataFrame:
    """The author's overrides: schema fixed, blank text and unreadable numbers are none."""
    raw = spark.read.csv(path, header=True, schema=OVERRIDE_SCHEMA, mode="PERMISSIVE", enforceSchema=False)
    text = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("name", "inkarnate", "notes")}
    number = {c: F.expr(f"try_cast({c} AS {t})") for c, t in (("settlement_id", "INT"), ("population", "DOUBLE"), ("lon", "DOUBLE"), ("lat", "DOUBLE"), ("phonology_seed", "INT"))}
    return raw.withColumns(text | number)


def relocations(spark: SparkSession, path: str) -> DataFrame:
    """id, lon, lat, original_lon, original_lat of moved features; a file that is absent or no JSON gives none."""
    kind = "id string, kind string, lon double, lat double, original_lon double, original_lat double"
    try:
        return spark.read.schema(kind + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt is null and id is not null").drop("_corrupt")
    except Exception as e:  # an absent path is an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)
