"""Views of the driver's tables that stand for map data, each as one text that Spark and DuckDB both run.

All derive from integers, so both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

_LON = "CAST(({k} * 7919) % 36000 AS DOUBLE) / 100 - 180"
_LAT = "CAST(({k} * 104729) % 12000 AS DOUBLE) / 100 - 60"

TEXT: dict[str, tuple[list[str], str]] = {
    "settlement": (["customer", "nation", "region"], f"""
SELECT c_custkey AS id, c_name AS name, CAST(floor(abs(c_acctbal) * CAST(1.5 AS DOUBLE)) AS BIGINT) AS pop, r_name AS continent,
  {_LON.format(k='c_custkey')} AS lon, {_LAT.format(k='c_custkey')} AS lat,
  c_custkey % 7 = 0 AS is_port, c_custkey % 3 = 0 AS coastal, c_custkey % 5 = 0 AS on_river,
  CASE WHEN c_custkey % 11 = 0 THEN concat(c_name, '.jpg') END AS inkarnate
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "sacred": (["supplier"], f"""
SELECT concat('S', CAST(s_suppkey AS VARCHAR(20))) AS site_id, CAST(s_suppkey % 9 + 1 AS INT) AS tier, s_suppkey % 11 = 0 AS destroyed,
  {_LON.format(k='(s_suppkey * 37 + 5)')} AS lon, {_LAT.format(k='(s_suppkey * 41 + 7)')} AS lat
FROM supplier"""),
    "cell": (["orders"], """
SELECT CAST(floor(CAST(o_orderkey AS DOUBLE) / 128) AS BIGINT) AS row, o_orderkey % 128 AS col,
  CAST(floor(o_totalprice) AS BIGINT) % 7500 - 1000 AS elev, CAST(o_orderkey * 31 % 5 AS INT) AS water,
  CAST(o_orderkey * 17 % 13 AS INT) AS biome, CAST(floor(o_totalprice * 3) AS BIGINT) AS fa
FROM orders"""),
    "vertex": (["events"], """
SELECT user_id AS line, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
  CAST(event_id * 37 AS DOUBLE) AS x, value * 100 AS y, event_type = 'error' OR event_type = 'click' AS wet
FROM events"""),
    "override": (["part"], f"""
SELECT CASE WHEN p_partkey % 10 >= 8 THEN p_partkey + 1000000 ELSE p_partkey END AS settlement_id,
  nullif(trim(CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_name END), '') AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 100 AS DOUBLE) END AS population,
  CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE {_LON.format(k='p_partkey')} + CASE p_partkey % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST('0.3' AS DOUBLE) WHEN 2 THEN CAST(9 AS DOUBLE) ELSE CAST('0.05' AS DOUBLE) END END AS lon,
  CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE {_LAT.format(k='p_partkey')} END AS lat,
  p_partkey AS key
FROM part"""),
    "feature": (["documents", "labels"], """
SELECT d.doc_id AS feature_id,
  CASE d.doc_id % 9 WHEN 0 THEN 'road' WHEN 1 THEN 'trail' WHEN 2 THEN 'river' WHEN 3 THEN 'forest' WHEN 4 THEN 'lake' WHEN 5 THEN 'mountain' WHEN 6 THEN 'region' WHEN 7 THEN 'label' ELSE 'poi' END AS type,
  CASE WHEN l.quality IS NULL THEN NULL ELSE d.doc_id % 10 = 0 END AS hidden, substr(d.text, 1, 12) AS name, l.quality AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "page": (["pages"], "SELECT page_id, url, html FROM pages"),
    "manifest_a": (["lineitem"], """
SELECT l_orderkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 10 AS seconds, max(CASE WHEN l_returnflag = 'R' THEN 'broken' ELSE 'ok' END) AS status, max(CAST(floor(l_tax * 100) AS INT)) AS px
FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey"""),
    "manifest_b": (["lineitem"], """
SELECT l_orderkey AS id, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS DOUBLE) / 10 AS seconds, min(CASE WHEN l_returnflag = 'A' THEN 'broken' ELSE 'ok' END) AS status, max(CAST(floor(l_discount * 100) AS INT)) AS px
FROM lineitem WHERE l_orderkey % 3 <> 1 GROUP BY l_orderkey"""),
    "node_edge": (["lineitem"], """
SELECT l_orderkey AS src, l_partkey + 10000000 AS dst, max(CAST(floor(l_extendedprice * 10) AS BIGINT)) AS flow FROM lineitem GROUP BY l_orderkey, l_partkey"""),
}

#: Views that Spark gets in another form with the same rows.  A window's key beside an alias of it is two columns to Spark: both were shuffled, with x and y beside
#: what they come from, and windows over lines shuffled the vertices once more.  Here the events are shuffled once, by ``line``, and x and y made after.
SPARK: dict[str, str] = {
    "vertex": """
SELECT line, CAST(n AS BIGINT) AS seq, CAST(event_id * 37 AS DOUBLE) AS x, value * 100 AS y, wet
FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY ts, event_id) AS n
  FROM (SELECT user_id AS line, ts, event_id, value, event_type = 'error' OR event_type = 'click' AS wet FROM events))""",
}


def oracle(needs: list[str], body: str) -> str:
    """A DuckDB text with the proxies it needs in front."""
    parts = [f"{n} AS ({TEXT[n][1]}\n)" for n in needs]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + (",\n" + body.lstrip()[5:] if body.lstrip().upper().startswith("WITH ") else "\n" + body)


class Proxies:
    """``p.settlement`` and the like as DataFrames; driver tables by their own names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TEXT:
            return table(self.spark, self.sf_dir, name)
        needs, text = TEXT[name]
        for t in needs:
            table(self.spark, self.sf_dir, t).createOrReplaceTempView(t)
        return self.spark.sql(SPARK.get(name, text).replace("VARCHAR(20)", "STRING"))
