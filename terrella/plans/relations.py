"""Relational queries: windows, joins, sets, overrides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import joins, overrides, ranks
from .registry import query
from .scalars import _TILE, tile_requests

_KM = "round(2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - o.lon) / 2), 2)))), 6)"


@query("settlement", """SELECT id, continent, CAST(row_number() OVER (PARTITION BY coalesce(nullif(continent, ''), '_unassigned') ORDER BY pop DESC NULLS LAST, id) AS INTEGER) AS continent_rank FROM settlement""")
def continent_rank(p):
    """Rank by population within the continent, ids deciding ties."""
    home = F.coalesce(F.nullif("continent", F.lit("")), F.lit("_unassigned"))
    s = p.settlement.select("id", "continent", "pop", home.alias("home"))
    return ranks.ranked(s, "home", "pop", "id", "continent_rank").select("id", "continent", "continent_rank")


@query("manifest_a manifest_b", """SELECT coalesce(a.id, b.id) AS id, a.seconds AS seconds_a, b.seconds AS seconds_b, a.status AS status_a, b.status AS status_b,
  CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'both' END AS side FROM manifest_a a FULL JOIN manifest_b b ON a.id = b.id""")
def manifest_full_join(p):
    a, b = (d.select("id", F.col("seconds").alias(f"seconds_{n}"), F.col("status").alias(f"status_{n}")) for n, d in (("a", p.manifest_a), ("b", p.manifest_b)))
    side = F.when(F.col("seconds_a").isNull(), "added").when(F.col("seconds_b").isNull(), "removed").otherwise("both")
    return a.join(b, "id", "full").withColumn("side", side)


@query("settlement", "SELECT min(id) AS id, lon, lat FROM settlement GROUP BY lon, lat")
def dedup_first(p):
    """The first row (by id) of each place."""
    return p.settlement.groupBy("lon", "lat").agg(F.min("id").alias("id"))


@query("settlement", "SELECT continent, name, pop FROM (SELECT *, row_number() OVER (PARTITION BY continent ORDER BY pop DESC, id) AS n FROM settlement) WHERE n = 1")
def top_city(p):
    best = F.max_by(F.struct("name", "pop"), F.struct("pop", -F.col("id"))).alias("t")
    return p.settlement.groupBy("continent").agg(best).select("continent", "t.name", "t.pop")


@query("settlement", """SELECT continent, id, pop FROM (
  SELECT *, row_number() OVER (PARTITION BY continent ORDER BY pop DESC, id) AS n, count(*) OVER (PARTITION BY continent) AS c FROM settlement WHERE pop > 0)
WHERE n = CAST(ceil(CAST(c AS DOUBLE) / 2) AS BIGINT)""")
def median_pick(p):
    """The row in the middle of each continent's order."""
    s = ranks.ranked(p.settlement.filter("pop > 0").select("continent", "id", "pop"), "continent", "pop", "id", "n", total="c")
    return s.filter(F.col("n") == F.ceil(F.col("c") / 2)).select("continent", "id", "pop")


@query("settlement", _TILE + """, places AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY continent ORDER BY pop DESC, id) AS n FROM settlement) WHERE n <= 3)
SELECT t.id, t.z, t.x, t.y FROM tile_req t JOIN places USING (id)""")
def ref_tiles_cross(p):
    """The three largest places of each continent at every reference zoom."""
    w = Window.partitionBy("continent").orderBy(F.desc("pop"), "id")
    places = p.settlement.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("id")
    return tile_requests(p).join(places, "id", "left_semi")


_RESOLVED = f"""
WITH d AS (SELECT o.key, o.settlement_id, c.id, CASE WHEN o.lon IS NOT NULL AND o.lat IS NOT NULL THEN {_KM} END AS km FROM override o CROSS JOIN settlement c),
firm AS (SELECT key, id AS match_id, 'id' AS how, km FROM d WHERE settlement_id = id AND (km IS NULL OR km <= 75)),
near AS (SELECT key, id AS match_id, 'coords' AS how, km FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY km, id) AS n FROM d WHERE km <= 75 AND key NOT IN (SELECT key FROM firm)) WHERE n = 1),
found AS (SELECT * FROM firm UNION ALL SELECT * FROM near),
resolved AS (SELECT o.key, f.match_id, coalesce(f.how, 'none') AS how, f.km, coalesce(f.km > 15, false) AS warn FROM override o LEFT JOIN found f USING (key)),
gave AS (SELECT r.match_id, r.key, o.name, o.population, CASE WHEN o.key % 7 = 0 THEN concat('map', o.key, '.jpg') END AS link FROM resolved r JOIN override o USING (key) WHERE r.match_id IS NOT NULL),
move AS (SELECT r.match_id, r.key, o.lon + 0.5 AS lon, o.lat + 0.25 AS lat FROM resolved r JOIN override o USING (key) WHERE r.match_id IS NOT NULL AND o.key % 3 = 1 AND o.lon IS NOT NULL),
applied AS (SELECT match_id, arg_max(name, key) FILTER (name IS NOT NULL) AS name, arg_max(population, key) FILTER (population IS NOT NULL) AS population, arg_max(link, key) FILTER (link IS NOT NULL) AS link FROM gave GROUP BY match_id),
moved AS (SELECT match_id, arg_max(lon, key) AS lon, arg_max(lat, key) AS lat FROM move GROUP BY match_id)
"""


@query("settlement override", _RESOLVED + "SELECT key, match_id, how, round(km, 4) AS km, warn FROM resolved")
def resolve_override(p):
    return overrides.resolve(p.override, p.settlement).withColumn("km", F.round("km", 4))


def found_overrides(p):
    """The overrides with the rows they resolve to, and those of them that move their row."""
    o = p.override.withColumn("inkarnate", F.when(F.col("key") % 7 == 0, F.concat(F.lit("map"), F.col("key").cast("string"), F.lit(".jpg"))))
    found = overrides.resolve(o, p.settlement).select("key", "match_id").join(o, "key")
    moves = found.filter((F.col("key") % 3 == 1) & F.col("lon").isNotNull())
    return found, moves.select("key", "match_id", (F.col("lon") + 0.5).alias("new_lon"), (F.col("lat") + 0.25).alias("new_lat"))


@query("settlement override", _RESOLVED + """SELECT s.id, coalesce(a.name, s.name) AS name, coalesce(CAST(a.population AS BIGINT), s.pop) AS pop, s.continent, coalesce(a.link, s.inkarnate) AS inkarnate,
round(coalesce(m.lon, s.lon), 6) AS lon, round(coalesce(m.lat, s.lat), 6) AS lat FROM settlement s LEFT JOIN applied a ON s.id = a.match_id LEFT JOIN moved m ON s.id = m.match_id""")
def apply_overrides(p):
    """Names, links, populations and moves on canon."""
    out = overrides.apply(p.settlement.select("id", "name", "pop", "continent", "inkarnate", "lon", "lat"), *found_overrides(p))
    return out.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})


@query("settlement override", _RESOLVED + "SELECT count(name) AS names, count(link) AS links, count(population) AS populations, (SELECT count(*) FROM move) AS moves FROM gave")
def override_applied(p):
    return overrides.applied(*found_overrides(p))


@query("settlement override", _RESOLVED + "SELECT how, count(*) AS n, CAST(sum(CASE WHEN warn THEN 1 ELSE 0 END) AS BIGINT) AS warned FROM resolved GROUP BY how")
def override_counts(p):
    r = overrides.resolve(p.override, p.settlement)
    return r.groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("warn").cast("long")).alias("warned"))


@query("override", """SELECT settlement_id, nullif(trim(p_name), '') AS name, TRY_CAST(p_type AS DOUBLE) AS population FROM override JOIN part ON key = p_partkey""")
def override_normalise(p):
    raw = p.override.select("settlement_id", "key").join(p.part, F.col("key") == F.col("p_partkey")).select("settlement_id", F.col("p_name").alias("name"), F.col("p_type").alias("population"))
    return overrides.normalise(raw)


_UPSERT = """WITH base AS (SELECT key, name, population FROM override WHERE name IS NOT NULL), changed AS (SELECT key, CASE WHEN key % 8 <> 0 THEN coalesce(name, 'renamed') END AS name, CASE WHEN key % 8 <> 0 THEN population * 2 END AS population FROM override WHERE population IS NOT NULL)"""


@query("override", _UPSERT + " SELECT * FROM base WHERE key NOT IN (SELECT key FROM changed) UNION ALL SELECT * FROM changed WHERE name IS NOT NULL OR population IS NOT NULL")
def override_upsert(p):
    """Named overrides, with those that give a population changed or added; every eighth change is empty and deletes."""
    base = p.override.filter("name is not null").select("key", "name", "population")
    full = F.col("key") % 8 != 0
    changed = p.override.filter("population is not null").select("key", F.when(full, F.coalesce("name", F.lit("renamed"))).alias("name"), F.when(full, F.col("population") * 2).alias("population"))
    return overrides.upsert(base, changed, "key")


@query("override", "SELECT key, name, population FROM override WHERE key NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def override_delete(p):
    return overrides.delete(p.override.select("key", "name", "population"), p.part.filter("p_size > 40").select(F.col("p_partkey").alias("key")), "key")


@query("settlement override", """SELECT s.id, coalesce(o.name, s.name) AS name, o.settlement_id IS NOT NULL AS has_override, coalesce(o.lon IS NOT NULL AND o.lon <> s.lon, false) AS is_relocated
FROM settlement s LEFT JOIN override o ON s.id = o.settlement_id""")
def overlay_flags(p):
    """The editor's preview: by id alone."""
    o = p.override.select(F.col("settlement_id").alias("id"), F.col("name").alias("new"), F.col("lon").alias("new_lon"), F.lit(True).alias("hit"))
    return p.settlement.join(o, "id", "left").select(
        "id", F.coalesce("new", "name").alias("name"), F.coalesce("hit", F.lit(False)).alias("has_override"), F.coalesce(F.col("new_lon") != F.col("lon"), F.lit(False)).alias("is_relocated")
    )


@query("feature", "SELECT coalesce(max(feature_id) + 1, 1) AS next_id FROM feature")
def next_id(p):
    return overrides.next_id(p.feature, "feature_id")


@query("override settlement", "SELECT settlement_id, name FROM override WHERE settlement_id NOT IN (SELECT id FROM settlement)")
def ghost_overrides(p):
    return p.override.join(p.settlement.select(F.col("id").alias("settlement_id")), "settlement_id", "left_anti").select("settlement_id", "name")


_DIFF = """WITH old AS (SELECT feature_id, type, name FROM feature WHERE feature_id % 7 <> 0),
new AS (SELECT feature_id, CASE WHEN feature_id % 11 = 0 THEN 'poi' ELSE type END AS type, name FROM feature WHERE feature_id % 5 <> 0)"""


@query("feature", _DIFF + """ SELECT coalesce(o.feature_id, n.feature_id) AS feature_id, CASE WHEN o.feature_id IS NULL THEN 'added' WHEN n.feature_id IS NULL THEN 'removed' ELSE 'edited' END AS change
FROM old o FULL JOIN new n ON o.feature_id = n.feature_id WHERE o.feature_id IS NULL OR n.feature_id IS NULL OR o.type IS DISTINCT FROM n.type OR o.name IS DISTINCT FROM n.name""")
def feature_diff(p):
    old = p.feature.filter("feature_id % 7 <> 0").select("feature_id", F.struct("type", "name").alias("old"))
    new = p.feature.filter("feature_id % 5 <> 0").withColumn("type", F.when(F.col("feature_id") % 11 == 0, "poi").otherwise(F.col("type"))).select("feature_id", F.struct("type", "name").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "edited")
    return old.join(new, "feature_id", "full").select("feature_id", change.alias("change")).filter("change is not null")


@query("feature settlement", "SELECT id, inkarnate FROM settlement WHERE inkarnate IS NOT NULL AND id IN (SELECT feature_id FROM feature WHERE NOT coalesce(hidden, false))")
def linked_semi(p):
    shown = p.feature.filter(~F.coalesce("hidden", F.lit(False))).select(F.col("feature_id").alias("id"))
    return p.settlement.filter("inkarnate is not null").join(shown, "id", "left_semi").select("id", "inkarnate")


@query("feature settlement", "SELECT id, inkarnate FROM settlement WHERE inkarnate IS NOT NULL AND id NOT IN (SELECT feature_id FROM feature WHERE type = 'poi')")
def withheld_anti(p):
    linked = p.feature.filter("type = 'poi'").select(F.col("feature_id").alias("id"))
    return p.settlement.filter("inkarnate is not null").join(linked, "id", "left_anti").select("id", "inkarnate")


@query("override", "SELECT CAST(g AS BIGINT) AS free FROM range(1, 13 + (SELECT max(settlement_id) FROM override)) t(g) WHERE g NOT IN (SELECT settlement_id FROM override) ORDER BY g LIMIT 12")
def free_ids(p):
    """The twelve lowest free numbers, from 1."""
    return overrides.free_numbers(p.override, "settlement_id", 12)


@query("settlement", "SELECT id, name, CAST(NULL AS VARCHAR) AS notes, coalesce(inkarnate, '') AS inkarnate FROM settlement")
def scan_backfill(p):
    from ..sources.tables import backfill

    s = backfill(p.settlement.select("id", "name", "inkarnate"), {"id": "long", "name": "string", "notes": "string", "inkarnate": "string"}, required=["id"])
    return s.withColumn("inkarnate", F.coalesce("inkarnate", F.lit(""))).select("id", "name", "notes", "inkarnate")


@query("feature", "SELECT feature_id, type, coalesce(hidden, false) AS hidden, coalesce(name, '') AS name, CAST(NULL AS DOUBLE) AS style_weight FROM feature")
def schema_backfill(p):
    from ..sources.tables import backfill

    f = backfill(p.feature, {"feature_id": "long", "type": "string", "hidden": "boolean", "name": "string", "style_weight": "double"}, required=["feature_id"])
    return f.select("feature_id", "type", F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("name", F.lit("")).alias("name"), "style_weight")


@query("feature", "SELECT feature_id, type, CASE WHEN type IN ('poi', 'label') THEN 'point' ELSE 'drawn' END AS branch FROM feature WHERE NOT coalesce(hidden, false)")
def split_poi_features(p):
    from ..sources.geojson import split_points

    points, drawn = split_points(p.feature.withColumn("hidden", F.coalesce("hidden", F.lit(False))))
    cols = lambda d, b: d.filter(~F.col("hidden")).select("feature_id", "type", F.lit(b).alias("branch"))
    return cols(points, "point").unionByName(cols(drawn, "drawn"))


@query("cell", "SELECT row, col, elev FROM cell WHERE row % 4 = 1 AND col % 4 = 1")
def regular_sample(p):
    """Every fourth cell both ways: a grid sample, the same each time."""
    return p.cell.filter((F.col("row") % 4 == 1) & (F.col("col") % 4 == 1)).select("row", "col", "elev")


@query("settlement sacred", """WITH q AS (SELECT id, is_port, pop FROM settlement WHERE coalesce(is_port, false) AND pop >= 2000)
SELECT count(*) AS settlements, (SELECT count(*) FROM sacred) AS sacred_sites, (SELECT count(*) FROM q) AS large_ports FROM settlement""")
def payload_counts(p):
    """The counts that the map's build returns."""
    s = p.settlement.agg(F.count(F.lit(1)).alias("settlements"), F.count_if(F.coalesce("is_port", F.lit(False)) & (F.col("pop") >= 2000)).alias("large_ports"))
    return s.crossJoin(p.sacred.agg(F.count(F.lit(1)).alias("sacred_sites"))).select("settlements", "sacred_sites", "large_ports")


@query("settlement", "SELECT continent, count(*) AS n, CAST(sum(CASE WHEN pop >= 10000 THEN 1 ELSE 0 END) AS BIGINT) AS cities FROM settlement GROUP BY continent")
def tier_population(p):
    return p.settlement.groupBy("continent").agg(F.count(F.lit(1)).alias("n"), F.count_if(scalar.settlement_tier(F.col("pop")) == 5).alias("cities"))
