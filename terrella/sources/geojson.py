"""GeoJSON as tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Point coordinates are one pair, lines a list of pairs, polygons a list of rings; read as text and parsed by type.
_FEATURE = "array<struct<type: string, properties: struct<{props}>, geometry: struct<type: string, coordinates: string>>>"
PROPERTIES = (
    "feature_id int, name string, feature_type string, description string, inkarnate_path string, style_color string, style_weight double, label_offset_x double, label_offset_y double, hidden boolean"
)


def read_features(spark: SparkSession, path: str, properties: str = PROPERTIES) -> DataFrame:
    """Properties, ``geom_type`` and ``points`` (array of x, y; a polygon's outer ring) of each feature; hidden defaults to false."""
    props = ", ".join(p.strip().replace(" ", ": ", 1) for p in properties.split(","))
    raw = spark.read.text(path, wholetext=True)
    f = raw.select(F.explode(F.from_json("value", f"struct<features: {_FEATURE.format(props=props)}>")["features"]).alias("f"))
    c = F.col("f.geometry.coordinates")
    line, rings, pair = F.from_json(c, "array<array<double>>"), F.from_json(c, "array<array<array<double>>>"), F.from_json(c, "array<double>")
    kind = F.upper(F.col("f.geometry.type"))
    points = F.when(kind == "POINT", F.array(pair)).when(kind == "LINESTRING", line).when(kind == "POLYGON", rings[0])
    out = f.select("f.properties.*", kind.alias("geom_type"), F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))
    return out.withColumn("hidden", F.coalesce("hidden", F.lit(False))) if "hidden" in out.columns else out


def split_points(features: DataFrame, kind: str = "type") -> tuple[DataFrame, DataFrame]:
    """Points of interest and labels, and what is drawn."""
    point = F.col(kind).isin("poi", "label")
    return features.filter(point), features.filter(~point)


def geometry_json(kind: Column, points: Column) -> Column:
    """A GeoJSON geometry as text."""
    pairs = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    one = F.to_json(F.struct(F.lit("Point").alias("type"), pairs[0].alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates")))
    ring = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")))
    return F.when(kind == "POINT", one).when(kind == "LINESTRING", line).when(kind == "POLYGON", ring)


def collection_rows(df: DataFrame, props: list[str]) -> DataFrame:
    """One GeoJSON feature as text for each row."""
    p = F.to_json(F.struct(*props), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), p, F.lit(',"geometry":'), geometry_json(F.col("geom_type"), F.col("points")), F.lit("}")).alias("value"))


def write_features(df: DataFrame, props: list[str], path: str) -> None:
    """Newline-delimited features, in parallel; nothing is gathered into one document."""
    collection_rows(df, props).write.mode("overwrite").text(path)
