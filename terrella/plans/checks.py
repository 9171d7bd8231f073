"""Provenance, caches and the reports that compare two renders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import places, provenance
from .registry import query
from .scalars import _TILE, tile_requests


@query("", "SELECT p_partkey, md5(concat_ws('|', p_name, p_brand, p_type, CAST(p_size AS VARCHAR))) AS digest FROM part")
def component_digest(p):
    return p.part.select("p_partkey", provenance.digest("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("digest"))


@query("", "SELECT p_brand, md5(string_agg(concat(p_partkey, '=', md5(p_name)), '|' ORDER BY concat(p_partkey, '=', md5(p_name)))) AS combined FROM part GROUP BY p_brand")
def stamp_combine(p):
    return provenance.combined(["p_brand"], p.part.select("p_brand", F.col("p_partkey").cast("string").alias("name"), F.md5("p_name").alias("digest")), "name", "digest")


_TWO = "WITH o AS (SELECT p_partkey AS id, md5(p_name) AS d FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_partkey AS id, md5(CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_name END) AS d FROM part WHERE p_partkey % 11 <> 0)"


@query("", _TWO + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'gone' WHEN o.id IS NULL THEN 'added' ELSE 'moved' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.d <> n.d")
def stamp_diff(p):
    k = F.col("p_partkey")
    old = p.part.filter(k % 7 != 0).select(k.alias("id"), F.md5("p_name").alias("digest"))
    new = p.part.filter(k % 11 != 0).select(k.alias("id"), F.md5(F.when(k % 5 == 0, F.col("p_type")).otherwise(F.col("p_name"))).alias("digest"))
    return provenance.changes(old, new, ["id"])


@query("", "SELECT event_id, date_diff('second', TIMESTAMP '1970-01-01', ts) AS mtime, md5(concat(event_type, ':', length(props), ':', strftime(ts, '%Y%m%d_%H%M%S'))) AS digest FROM events")
def mtime_digest(p):
    """Name, size and time of a file as its digest, where content is not read."""
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return p.events.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("mtime"), F.md5(F.concat_ws(":", "event_type", F.length("props").cast("string"), stamp)).alias("digest"))


_SEEN = _TILE + ", c AS (SELECT z, x, y, max(id) AS made FROM tile_req GROUP BY z, x, y)"


@query("settlement", _SEEN + " SELECT z, x, y FROM c WHERE made < 75")
def stale_tiles(p):
    """Tiles made before the stamp."""
    return provenance.stale(tile_requests(p).groupBy("z", "x", "y").agg(F.max("id").alias("made")), 75).drop("made")


@query("settlement", _SEEN + " SELECT z, count(*) AS tiles, CAST(sum(CASE WHEN made < 75 THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM c GROUP BY z")
def cache_status(p):
    c = tile_requests(p).groupBy("z", "x", "y").agg(F.max("id").alias("made"))
    return c.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("made") < 75).alias("stale"))


_AB = "WITH j AS (SELECT a.id, a.seconds AS sa, b.seconds AS sb, a.status AS st_a, b.status AS st_b, abs(a.px - b.px) AS diff FROM manifest_a a JOIN manifest_b b ON a.id = b.id)"


def joined(p):
    a = p.manifest_a.select("id", F.col("seconds").alias("sa"), F.col("status").alias("st_a"), F.col("px").alias("pa"))
    b = p.manifest_b.select("id", F.col("seconds").alias("sb"), F.col("status").alias("st_b"), F.col("px").alias("pb"))
    return a.join(b, "id").withColumn("diff", F.abs(F.col("pa") - F.col("pb")))


@query("manifest_a manifest_b", _AB + " SELECT st_a, st_b, count(*) AS n, round(100 * avg(CASE WHEN diff > 6 THEN 1.0 ELSE 0.0 END), 4) AS changed_share, max(diff) AS worst FROM j GROUP BY st_a, st_b")
def render_diff_stats(p):
    share = F.round(100 * F.avg((F.col("diff") > 6).cast("double")), 4)
    return joined(p).groupBy("st_a", "st_b").agg(F.count(F.lit(1)).alias("n"), share.alias("changed_share"), F.max("diff").alias("worst"))


@query("manifest_a manifest_b", _AB + " SELECT round(quantile_cont(sb / nullif(sa, 0), 0.5), 6) AS ratio FROM j")
def perf_ratio_median(p):
    """The median of time ratios."""
    return joined(p).agg(F.round(F.percentile(F.try_divide("sb", "sa"), 0.5), 6).alias("ratio"))


_TAGS = "t AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'rivers' ELSE 'roads' END AS tag, diff > 6 AS changed FROM j)"


@query("manifest_a manifest_b", _AB + f", {_TAGS} SELECT id, changed AND tag NOT IN ('rivers') AS collateral FROM t")
def collateral_flag(p):
    """Changed tiles with nothing in frame of what was expected to change."""
    tag = F.when(F.col("id") % 2 == 0, "rivers").otherwise("roads")
    return joined(p).select("id", ((F.col("diff") > 6) & ~tag.isin("rivers")).alias("collateral"))


@query("manifest_a manifest_b", _AB + f""", {_TAGS}, s AS (SELECT max(CASE WHEN st_b = 'broken' THEN 1 ELSE 0 END) AS broken, quantile_cont(sb / nullif(sa, 0), 0.5) AS ratio FROM j), c AS (SELECT count(*) AS n FROM t WHERE changed AND tag <> 'rivers')
SELECT CASE WHEN broken = 1 OR ratio > 2 THEN 'FAIL' WHEN n > 0 OR ratio > 1.5 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM s, c""")
def verdict(p):
    """Broken tiles or double the time fail; collateral changes or half more time want a look."""
    ratio = F.percentile(F.try_divide("sb", "sa"), 0.5)
    collateral = F.count_if((F.col("diff") > 6) & (F.col("id") % 2 != 0))
    v = F.when(F.bool_or(F.col("st_b") == "broken") | (ratio > 2), "FAIL").when((collateral > 0) | (ratio > 1.5), "REVIEW").otherwise("PASS")
    return joined(p).agg(v.alias("verdict"))


_BOX = """, t AS (SELECT DISTINCT z, x, y, pow(2, z) AS n FROM tile_req),
b AS (SELECT z, x, y, x / n * 360 - 180 - 0.02 AS w, (x + 1) / n * 360 - 180 + 0.02 AS e, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / n)))) - 0.02 AS s, degrees(atan(sinh(pi() * (1 - 2 * y / n)))) + 0.02 AS n FROM t)"""
_KINDS = ["settlements", "walls", "piers", "sacred"]


@query("settlement sacred", _TILE + _BOX + """, f AS (SELECT 1 AS o, 'settlements' AS tag, lon, lat FROM settlement UNION ALL SELECT 2, 'walls', lon, lat FROM settlement WHERE pop >= 8000
  UNION ALL SELECT 3, 'piers', lon, lat FROM settlement WHERE is_port UNION ALL SELECT 4, 'sacred', lon, lat FROM sacred), seen AS (SELECT DISTINCT z, x, y, o, tag FROM b JOIN f ON lon BETWEEN w AND e AND lat BETWEEN s AND n)
SELECT z, x, y, string_agg(tag, ',' ORDER BY o) AS tags FROM seen GROUP BY z, x, y""")
def tile_tags(p):
    """What is in frame of each tile."""
    s = p.settlement
    kinds = F.array_compact(F.array(F.lit("settlements"), F.when(F.col("pop") >= places.WALL_POP, "walls"), F.when(F.col("is_port"), "piers")))
    points = s.select("lon", "lat", F.explode(kinds).alias("tag")).unionByName(p.sacred.select("lon", "lat", F.lit("sacred").alias("tag")))
    return places.in_frame(tile_requests(p), points, _KINDS).withColumn("tags", F.array_join("tags", ","))
