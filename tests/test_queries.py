"""Every query with SQL gives the SQL's rows, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from terrella.plans import registry

from .oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    assert differences(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name], con) == ""


def test_luminance_equals_its_sql_to_the_last_digit(spark, sf, con):
    want = dict(((r, c), lum) for r, c, lum in con.sql(registry.ORACLE_SQL["luminance"]).fetchall())
    got = {(r["row"], r["col"]): r["lum"] for r in registry.QUERIES["luminance"](spark, sf).collect()}
    assert got == want


def test_densify_equals_its_sql_at_ties_to_the_last_digit(spark, tmp_path):
    con = duckdb.connect()
    con.sql("CREATE TABLE events AS SELECT k AS event_id, TIMESTAMP '2024-01-01' AS ts, k % 9 AS user_id, 'view' AS event_type, (k + 0.5) / 100000e0 AS value FROM range(9000) t(k)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = sorted(con.sql(f"SELECT line, seq, part, x, y FROM ({registry.ORACLE_SQL['densify']})").fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES["densify"](spark, str(tmp_path)).select("line", "seq", "part", "x", "y").collect())
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b] == []


def unknown_places(con, folder):
    """Events of which some lack a value, orders for the ground."""
    con.sql("CREATE TABLE events AS SELECT k AS event_id, TIMESTAMP '2024-01-01' AS ts, k % 9 AS user_id, 'view' AS event_type, CASE WHEN k % 7 <> 3 THEN (k * 7919 % 1000 + 0.5) / 2e0 END AS value FROM range(3000) t(k)")
    con.sql("CREATE TABLE orders AS SELECT k AS o_orderkey, CAST(k * 7919 % 5000 AS DOUBLE) AS o_totalprice FROM range(900) t(k)")
    for t in ("events", "orders"):
        con.sql(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")


def test_densify_equals_its_sql_where_a_place_is_unknown(spark, tmp_path):
    con = duckdb.connect()
    unknown_places(con, tmp_path)
    assert differences(spark, str(tmp_path), registry.QUERIES["densify"], registry.ORACLE_SQL["densify"], con) == ""


def test_rounding_is_to_the_nearest_with_halves_away_from_zero(spark):
    from pyspark.sql import functions as F

    from terrella.functions.scalar import rounded

    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 4503599627370497.0, 9007199254740993.0, 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 0)).collect()]
    assert got == [1.0, -1.0, 2.0, 3.0, -3.0, 0.0, 0.0, 4503599627370497.0, 9007199254740993.0, 1e300, None]


def test_rounding_makes_no_decimals(spark, sf):
    assert "round(" not in registry.QUERIES["densify"](spark, sf)._jdf.queryExecution().executedPlan().toString().lower()


def test_every_query_without_sql_has_rows(spark, sf):
    for name in registry.QUERIES.keys() - registry.ORACLE_SQL.keys() - {"render_tiles", "render_biome_tiles"}:
        assert registry.QUERIES[name](spark, sf).count() > 0, name


def test_the_entry_runs_without_the_corpus_subpackage(spark):
    import subprocess
    import sys

    from terrella.session import ROOT

    code = (
        "import sys, builtins\n"
        "real = builtins.__import__\n"
        "def hide(name, g=None, l=None, f=(), level=0):\n"
        "    if name.startswith('terrella.llm') or name == 'corpus_pipeline' or (name == 'terrella' and 'llm' in (f or ())):\n"
        "        raise ImportError(name)\n"
        "    return real(name, g, l, f, level)\n"
        "builtins.__import__ = hide\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
