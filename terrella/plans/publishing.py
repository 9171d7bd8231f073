"""Payloads, pages and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import publish
from .registry import query
from .scalars import _TILE, tile_requests


@query("settlement", """SELECT id, name, round(lon, 5) AS lon, round(lat, 5) AS lat, pop,
  CAST(CASE WHEN pop >= 10000 THEN 5 WHEN pop >= 5000 THEN 4 WHEN pop >= 2000 THEN 3 WHEN pop >= 200 THEN 2 ELSE 1 END AS INTEGER) AS tier,
  CAST(row_number() OVER (PARTITION BY continent ORDER BY pop DESC, id) AS INTEGER) AS continent_rank, coalesce(is_port, false) AS is_port FROM settlement""")
def settlement_records(p):
    from pyspark.sql import Window

    w = Window.partitionBy("continent").orderBy(F.desc("pop"), "id")
    return p.settlement.select(
        "id", "name", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "pop", scalar.settlement_tier(F.col("pop")).alias("tier"),
        F.row_number().over(w).alias("continent_rank"), F.coalesce("is_port", F.lit(False)).alias("is_port"),
    )


@query("sacred", "SELECT site_id, tier, CASE WHEN destroyed THEN 'destroyed' ELSE 'standing' END AS status, round(lon, 5) AS lon, round(lat, 5) AS lat FROM sacred")
def sacred_records(p):
    return p.sacred.select("site_id", "tier", F.when(F.col("destroyed"), "destroyed").otherwise("standing").alias("status"), F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


@query("feature", "SELECT feature_id, name, type FROM feature WHERE type IN ('poi', 'label') AND NOT coalesce(hidden, false)")
def poi_records(p):
    return publish.visible(p.feature.filter(F.col("type").isin("poi", "label"))).select("feature_id", "name", "type")


@query("feature", "SELECT feature_id, json_extract_string(j, '$.properties.type') AS type, CAST(json_extract_string(j, '$.geometry.coordinates[0]') AS DOUBLE) AS x FROM (SELECT feature_id, to_json({'type': 'Feature', 'properties': {'type': type}, 'geometry': {'type': 'Point', 'coordinates': [CAST(feature_id AS DOUBLE), 0.5]}}) AS j FROM feature)")
def geojson_encode(p):
    """Encoded as GeoJSON and read back: texts differ between engines in spacing only."""
    from ..sources.geojson import collection_rows

    f = p.feature.select("feature_id", "type", F.lit("POINT").alias("geom_type"), F.array(F.struct(F.col("feature_id").cast("double").alias("x"), F.lit(0.5).alias("y"))).alias("points"))
    j = collection_rows(f, ["feature_id", "type"]).select(F.from_json("value", "type string, properties struct<feature_id: long, type: string>, geometry struct<type: string, coordinates: array<double>>").alias("f"))
    return j.select("f.properties.feature_id", "f.properties.type", F.col("f.geometry.coordinates")[0].alias("x"))


@query("sacred", "SELECT tier, count(*) AS n, min(site_id) AS first_id, concat('hex_tier_', tier, '.json') AS file FROM sacred GROUP BY tier")
def hex_manifest(p):
    """One file for each tier, and the manifest that names them."""
    m = p.sacred.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("site_id").alias("first_id"))
    return m.withColumn("file", F.concat(F.lit("hex_tier_"), F.col("tier").cast("string"), F.lit(".json")))


@query("node_edge", "SELECT t.tier, t.n, CAST(CASE t.tier WHEN 'big' THEN 0 WHEN 'med' THEN 6 ELSE 8 END AS INTEGER) AS min_zoom FROM (SELECT CASE WHEN flow >= 500000 THEN 'big' WHEN flow >= 50000 THEN 'med' ELSE 'small' END AS tier, count(*) AS n FROM node_edge WHERE flow >= 25000 GROUP BY 1) t WHERE t.tier <> 'small'")
def tier_manifest_prune(p):
    """River tiers with the zoom that loads them, without those past the deepest zoom published."""
    from ..model import lookup

    t = p.node_edge.withColumn("tier", scalar.flow_tier(F.col("flow"))).filter("tier <> 'dropped'").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("min_zoom", lookup(publish.TIER_MIN_ZOOM, F.col("tier")).cast("int")).filter(F.col("min_zoom") <= publish.MAX_ZOOM)


@query("page", "SELECT page_id, md5(replace(replace(html, '<html', concat('<html data-page=\"', page_id, '\"')), '</body>', concat(url, '</body>'))) AS digest FROM page")
def template_fill(p):
    """Placeholders (here tags) filled as fixed strings."""
    values = {"<html": F.concat(F.lit('<html data-page="'), F.col("page_id").cast("string"), F.lit('"')), "</body>": F.concat(F.col("url"), F.lit("</body>"))}
    return p.page.select("page_id", F.md5(publish.fill(F.col("html"), values)).alias("digest"))


@query("feature", "SELECT type, count(*) AS n, min(feature_id) AS first_id FROM feature WHERE NOT coalesce(hidden, false) GROUP BY type")
def strip_hidden(p):
    """Hidden features leave the payload; done on rows, so no payload is held whole."""
    return publish.visible(p.feature).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("feature_id").alias("first_id"))


@query("page", "SELECT page_id, md5(replace(html, 'https://', 'assets/')) AS digest, CAST(length(replace(html, 'https://', 'assets/')) AS BIGINT) AS n FROM page")
def path_rewrite(p):
    h = publish.relative_paths(F.col("html"), "https://", "assets/")
    return p.page.select("page_id", F.md5(h).alias("digest"), F.length(h).cast("long").alias("n"))


@query("page", """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1))) AS asset FROM page""")
def asset_extract(p):
    return p.page.select("page_id", F.explode(publish.assets(F.col("html"))).alias("asset"))


@query("page", """WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS asset FROM page) SELECT count(*) AS files, count(*) > 20000 AS too_many FROM a""")
def bundle_cap(p):
    a = p.page.select(F.explode(publish.assets(F.col("html"))).alias("asset")).distinct()
    return a.agg(F.count(F.lit(1)).alias("files"), (F.count(F.lit(1)) > publish.MAX_FILES).alias("too_many"))


@query("settlement", _TILE + ", asked AS (SELECT DISTINCT z, x, y FROM tile_req), have AS (SELECT DISTINCT z, x, y FROM tile_req WHERE id % 3 = 0) SELECT z, x, y FROM asked EXCEPT SELECT z, x, y FROM have")
def cache_dispatch(p):
    """Tiles asked for that are not in the cache: what is to be rendered."""
    t = tile_requests(p)
    return t.select("z", "x", "y").distinct().join(t.filter("id % 3 = 0").select("z", "x", "y").distinct(), ["z", "x", "y"], "left_anti")
