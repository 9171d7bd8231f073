"""Cut lines are streamed: no vertex that shaping inserts is shuffled, sorted or spilled."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from terrella.operators import noise, shaping
from terrella.plans import registry

from .oracle import connect, differences


def above_the_cut(df) -> str:
    """The plan's operators through which inserted vertices go."""
    plan = df._jdf.queryExecution().sparkPlan().toString() + "\n" + df._jdf.queryExecution().executedPlan().toString()
    return "\n".join(part.split("Generate")[0] for part in plan.split("AdaptiveSparkPlan"))


def test_roads_move_no_inserted_vertex(spark, sf):
    plan = above_the_cut(registry.QUERIES["shape_roads"](spark, sf))
    assert not any(w in plan for w in ("Exchange", "Sort", "Window")), plan


def test_densify_shuffles_the_events_once(spark, sf):
    df = registry.QUERIES["densify"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    moved = plan.split("Exchange")[1].split("Project [")[1].split("]")[0].split(", ")
    assert len(moved) == 4, moved  # the line, the two keys of its order (x comes of one) and what y comes of


def test_means_over_batches_equal_plain_ones():
    rng, rows = np.random.default_rng(5), []
    for n in (1, 2, 6, 7, 8, 40):
        rows += [(k + 1, n, float(v)) for k, v in enumerate(rng.normal(size=n))]
    want = [sum(rows[i + d][2] for d in range(-3, 4)) / 7 if 3 < k <= n - 3 else 0.0 for i, (k, n, _) in enumerate(rows)]
    schema = pa.schema([("seq", pa.int64()), ("_all", pa.int64()), ("v", pa.float64())])
    whole = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for size in (1, 2, 3, 5, 64):
        got = pa.Table.from_batches(shaping._rolling("v", 3)(iter(whole.to_batches(max_chunksize=size))), schema)
        assert got.column("seq").equals(whole.column("seq")) and np.allclose(got.column("v").to_numpy(), want, rtol=1e-14, atol=0)


def test_rivers_move_no_inserted_vertex_to_the_ground(spark, sf, monkeypatch):
    plan = above_the_cut(registry.QUERIES["shape_rivers"](spark, sf))
    assert not any(w in plan for w in ("Exchange", "Sort", "Window")), plan
    monkeypatch.setattr(shaping, "GROUND_BROADCAST", 0)  # where the ground is too large to be sent, vertices are
    assert differences(spark, sf, registry.QUERIES["shape_rivers"], registry.ORACLE_SQL["shape_rivers"], connect(sf)) == ""


#: Bends, a segment of several pieces, two vertices, one, a place twice, and one that is not known.
ODD = [(1, i, 900.0 * i, 300.0 * math.sin(i)) for i in range(12)] + [(2, 0, 0.0, 5000.0), (2, 1, 600000.0, 7000.0), (2, 2, 600100.0, 7000.0)] + [(3, 0, 5.0, 5.0), (3, 1, 50.0, 9.0)]
ODD += [(4, 7, 80.0, 90.0)] + [(5, i, 700.0 * (i // 2), 800.0) for i in range(8)] + [(6, i, 500.0 * i, None if i in (3, 6, 7) else 100.0 * i) for i in range(10)]
PULL, WIGGLE = noise.Fbm(4, 4000, 7), noise.Fbm(3, 650, 7)


def by_columns(f):
    """A field that cannot be had at points of arrays."""
    return lambda x, y: f(x, y)


def same_lines(got, want):
    a, b = (sorted(tuple(math.nan if v is None else v for v in (r.line, r.seq, r.x, r.y)) for r in df.collect()) for df in (got, want))
    assert len(a) == len(b) > len(ODD) and np.allclose(a, b, rtol=0, atol=1e-6, equal_nan=True)


def test_roads_are_shaped_in_one_pass_over_arrays(spark, sf):
    plan = registry.QUERIES["shape_roads"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SIN(" not in plan.upper(), plan


def test_roads_as_arrays_equal_columns(spark):
    raw = spark.createDataFrame(ODD, "line long, seq long, x double, y double")
    assert 600000 / shaping.ROAD_STEP > 2 * shaping.PIECE
    same_lines(shaping.roads(raw, PULL, WIGGLE), shaping.roads(raw, by_columns(PULL), by_columns(WIGGLE)))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64])
def test_means_over_chunks_equal_plain_ones(size):
    rng, rows = np.random.default_rng(6), []
    for n in (1, 2, 6, 7, 8, 40):
        rows += [(k + 1, n, float(v)) for k, v in enumerate(rng.normal(size=n))]
    want = [sum(rows[i + d][2] for d in range(-3, 4)) / 7 if 3 < k <= n - 3 else 0.0 for i, (k, n, _) in enumerate(rows)]
    seq, count, v = (np.array(c) for c in zip(*rows, strict=True))
    of = pa.RecordBatch.from_pydict({"line": list(range(len(rows)))})
    chunks = ({"seq": seq[i : i + size], "_all": count[i : i + size], "v": v[i : i + size], "_of": of, "_row": np.arange(len(rows))[i : i + size]} for i in range(0, len(rows), size))
    got = list(shaping._mean(chunks, "v", 3))
    assert np.allclose(np.concatenate([c["v"] for c in got]), want, rtol=1e-14, atol=0)
    assert [x for c in got for x in c["_of"].take(pa.array(c["_row"])).column(0).to_pylist()] == of.column(0).to_pylist()


def spot(x, y):
    from pyspark.sql import functions as F

    return F.floor(y / 100).cast("long"), F.floor(x / 100).cast("long")


def spot_at(x, y):
    return np.floor(y / 100).astype(np.int64), np.floor(x / 100).astype(np.int64)


class Spot:
    __call__, at = staticmethod(spot), staticmethod(spot_at)


def test_rivers_are_shaped_in_one_pass_over_arrays(spark, sf):
    plan = registry.QUERIES["shape_rivers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SIN(" not in plan.upper() and "Join" not in plan, plan


@pytest.mark.parametrize("ground", ["some", "none", "twice"])
def test_rivers_as_arrays_equal_columns(spark, ground):
    raw = spark.createDataFrame(ODD, "line long, seq long, x double, y double")
    rows = [] if ground == "none" else [(r, c, None if r % 5 == 0 else (r * 37 + c * 91) % 60) for r in range(-6, 90) for c in range(-4, 130) if (r + c) % 7]
    cells = spark.createDataFrame(rows + rows[:500] * (ground == "twice"), "row long, col long, elev long")
    bands = [(130.0, noise.Fbm(3, 1600, 47)), (45.0, noise.Fbm(3, 420, 48))]
    got = shaping.rivers(raw, bands, PULL, cells, Spot())
    same_lines(got, shaping.rivers(raw, [(a, by_columns(f)) for a, f in bands], by_columns(PULL), cells, spot))
    assert ("SIN(" in got._jdf.queryExecution().executedPlan().toString().upper()) == (ground == "twice")  # cells in two rows double vertices: that is left to joins


@pytest.mark.parametrize("name", ["shape_roads", "shape_rivers"])
def test_shapes_equal_their_sql_where_a_place_is_unknown(spark, tmp_path, name):
    import duckdb

    from .test_queries import unknown_places

    con = duckdb.connect()
    unknown_places(con, tmp_path)
    assert differences(spark, str(tmp_path), registry.QUERIES[name], registry.ORACLE_SQL[name], con) == ""
