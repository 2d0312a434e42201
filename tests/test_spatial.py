"""Geometry against independent computations, and the shape of the spatial plans."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from arealcast.operators import grid as GR
from arealcast.operators import spatial as SP

CONCAVE = "POLYGON ((0.2 0.1, 5.3 0.4, 4.1 4.6, 2.7 1.9, 0.6 4.2, 0.2 0.1), (2.0 0.6, 3.1 0.7, 2.6 1.4, 2.0 0.6))"
TWO_PARTS = "MULTIPOLYGON (((0 0, 0 1, 1 1, 1 0, 0 0)), ((3 3, 5 3, 5 5, 3 5, 3 3), (3.5 3.5, 4 3.5, 4 4, 3.5 4, 3.5 3.5)))"


def polygons(spark, **texts):
    df = spark.createDataFrame(list(texts.items()), "geo_id string, wkt string")
    return df.select("geo_id", SP.rings_from_wkt(F.col("wkt")).alias("rings"))


def grid(spark, n=6, step=1.0):
    points = spark.createDataFrame([(0, i * step, j * step) for i in range(n) for j in range(n)], "grid_id int, lat double, lon double")
    return GR.grid_cells(points)


def rings(text):

    return [[tuple(map(float, p.split())) for p in part.split(",")] for part in re.findall(r"\(([^()]+)\)", text)]


def inside(parts, x, y):
    odd = False
    for ring in parts:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def shoelace(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def test_wkt_areas(spark):
    got = {r.geo_id: r.a for r in polygons(spark, c=CONCAVE, m=TWO_PARTS).select("geo_id", SP.polygon_area(F.col("rings")).alias("a")).collect()}
    outer, hole = rings(CONCAVE)
    assert got["c"] == pytest.approx(shoelace(outer) - shoelace(hole))
    assert got["m"] == pytest.approx(1 + 4 - 0.25)


def test_tiny_polygon_keeps_its_weight(spark):
    tiny = polygons(spark, t="POLYGON ((1.1 1.1, 1.10005 1.1, 1.10005 1.10005, 1.1 1.10005, 1.1 1.1))")
    points = spark.createDataFrame([(0, i * 2.5, j * 2.5) for i in range(3) for j in range(3)], "grid_id int, lat double, lon double")
    rows = SP.overlap_weights(GR.grid_cells(points), tiny).collect()
    area = math.radians(0.00005) * 0.00005 * math.cos(math.radians(1.1))
    assert len(rows) == 1 and rows[0].w == pytest.approx(area, rel=1e-4)


def test_wkt_round_trip(spark):
    df = polygons(spark, c=CONCAVE)
    again = df.select("geo_id", SP.rings_from_wkt(SP.wkt_from_rings(F.col("rings"))).alias("rings"))
    assert df.first().rings == again.first().rings


@pytest.mark.parametrize("tile", [0.7, 1.0, 3.0, 50.0])
def test_overlaps_partition_a_concave_polygon(spark, tile):
    pairs = SP._pairs(grid(spark), polygons(spark, c=CONCAVE), [], ("lon_lo", "lon_hi", "lat_lo", "lat_hi"), (tile, tile))
    rows = pairs.select("lat", "lon", F.col("_shared").alias("w")).where("w > 1e-12").collect()
    assert len({(r.lat, r.lon) for r in rows}) == len(rows)
    outer, hole = rings(CONCAVE)
    assert sum(r.w for r in rows) == pytest.approx(shoelace(outer) - shoelace(hole))
    rng = random.Random(0)
    for r in rng.sample(rows, 4):
        hits = sum(inside([outer, hole], r.lon - 0.5 + rng.random(), r.lat - 0.5 + rng.random()) for _ in range(20000))
        assert r.w == pytest.approx(hits / 20000, abs=0.02)


def test_weights_of_a_covered_area_sum_to_its_size(spark):
    df = SP.overlap_weights(grid(spark), polygons(spark, a="POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))"))
    want = 4 * math.sin(math.radians(3))
    assert df.agg(F.sum("w")).first()[0] == pytest.approx(want)
    assert df.count() == 20


def test_within_and_intersects(spark):
    cells = grid(spark, 4)
    square = polygons(spark, a="POLYGON ((-0.5 -0.5, 1.5 -0.5, 1.5 1.5, -0.5 1.5, -0.5 -0.5))")
    within = SP.join_cells(cells, square, "within")
    assert sorted((r.lat, r.lon) for r in within.collect()) == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]
    meets = SP.join_cells(cells, square, "intersects")
    assert meets.count() == 16
    assert meets.where("geo_id IS NOT NULL").count() == 9  # cells that only touch the edge count too


def test_point_in_polygon_against_ray_casting(spark):
    rng = random.Random(5)
    pts = [(0, rng.uniform(-1, 6), rng.uniform(-1, 6)) for _ in range(400)]
    df = spark.createDataFrame(pts, "grid_id int, lat double, lon double")
    got = {(r.lat, r.lon) for r in SP.points_in_polygons(df, polygons(spark, c=CONCAVE, m=TWO_PARTS)).collect()}
    want = {(y, x) for _, y, x in pts if inside(rings(CONCAVE), x, y) or inside(rings(TWO_PARTS), x, y)}
    assert got == want


def test_mean_of_a_constant_field(spark):
    from arealcast.operators.areal import area_weighted_mean

    cells = grid(spark)
    w = SP.overlap_weights(cells, polygons(spark, c=CONCAVE, m=TWO_PARTS))
    out = area_weighted_mean(cells.withColumn("value", F.lit(7.25)), w).collect()
    assert [r.value for r in out] == pytest.approx([7.25, 7.25])


@pytest.mark.parametrize("name", ["cell_polygon_weights", "point_in_polygon", "cells_within_polygon", "cells_intersecting_polygon", "asof_nearest", "contiguity_edges", "grid_mismatches", "population_bands", "kde_rows", "quartile_labels", "zscore"])
def test_no_cross_join(spark, folder, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


@pytest.mark.parametrize("tile", [0.37, 1.0, 40.0])
def test_every_pair_of_random_shapes(spark, tile):
    """Stars with holes, and edges along tile lines: areas against clipping, points against ray casting."""
    rng = random.Random(9)
    texts = {}
    for k in range(12):
        cx, cy, n = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randrange(5, 30)
        star = [(cx + math.cos(2 * math.pi * i / n) * (r := rng.uniform(0.4, 3)), cy + math.sin(2 * math.pi * i / n) * r) for i in range(n)]
        hole = [(cx + dx * 0.1, cy + dy * 0.1) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        ring = lambda p: "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*p, p[0]]) + ")"
        texts[f"s{k}"] = f"POLYGON ({ring(star)}, {ring(hole)})"
    texts["square"] = "POLYGON ((-2 -2, 2 -2, 2 1, -2 1, -2 -2))"
    texts["thin"] = "POLYGON ((-1 0.37, 1 0.37, 1 0.3700001, -1 0.3700001, -1 0.37))"
    points = spark.createDataFrame([(0, i * 0.8 - 3.2, j * 0.8 - 3.2) for i in range(9) for j in range(9)], "grid_id int, lat double, lon double")
    cells = GR.grid_cells(points)
    found = SP._pairs(cells, polygons(spark, **texts), [], ("lon_lo", "lon_hi", "lat_lo", "lat_hi"), (tile, tile))
    got = {(r.geo_id, r.lat, r.lon): r._shared for r in found.collect()}

    def clipped(ring, a, b, c):
        """Part of a ring with a x + b y <= c."""
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            fp, fq = a * p[0] + b * p[1] - c, a * q[0] + b * q[1] - c
            if fp <= 0:
                out.append(p)
            if fp * fq < 0:
                t = fp / (fp - fq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        return out

    def area(ring):
        return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2

    for name, text in texts.items():
        for r in cells.collect():
            want = 0.0
            for k, ring in enumerate(rings(text)):
                part = ring[:-1]
                for half in ((1, 0, r.lon_hi), (-1, 0, -r.lon_lo), (0, 1, r.lat_hi), (0, -1, -r.lat_lo)):
                    part = clipped(part, *half) if part else part
                want += (-1 if k else 1) * (area(part) if part else 0)
            assert got.get((name, r.lat, r.lon), 0.0) == pytest.approx(want, abs=1e-12), name
    spots = [(0, rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(300)] + [(0, i * tile, j * tile) for i in range(-3, 4) for j in range(-3, 4)]
    df = spark.createDataFrame(spots, "grid_id int, lat double, lon double")
    for name in ("s1", "s5", "square"):
        hits = {(r.lat, r.lon) for r in SP.points_in_polygons(df, polygons(spark, **{name: texts[name]}), tile=tile).collect()}
        edge = lambda y, x: name == "square" and (x in (-2, 2) or y in (-2, 1))
        assert {p for p in hits if not edge(*p)} == {(y, x) for _, y, x in spots if inside(rings(texts[name]), x, y) and not edge(y, x)}


def test_large_polygon_is_spread_over_tiles(spark):
    """100,000 vertices over more than 1,000 tiles: no row holds the polygon's edges once they are cut, and areas are right."""
    n, r = 100_000, 20.0
    angle = lambda i: 2 * math.pi * i / n
    wave = lambda i: r + 0.5 * math.sin(40 * angle(i))
    ring = [(math.cos(angle(i)) * wave(i), math.sin(angle(i)) * wave(i)) for i in range(n)]
    df = spark.createDataFrame([("big", [ring])], f"geo_id string, rings {SP.RINGS_TYPE}")
    points = spark.createDataFrame([(0, i * 1.0 - 22, j * 1.0 - 22) for i in range(45) for j in range(45)], "grid_id int, lat double, lon double")
    start = time.time()
    pieces = SP.boundary_pieces(df, [], 1.0, 1.0)
    tiles = pieces.groupBy("_tx", "_ty").count().collect()
    assert len(tiles) > 1000 and max(t["count"] for t in tiles) < n / 50
    pairs = SP._pairs(GR.grid_cells(points), df, [], ("lon_lo", "lon_hi", "lat_lo", "lat_hi"), (1.0, 1.0)).select("_shared").collect()
    want = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
    assert sum(p._shared for p in pairs) == pytest.approx(want, rel=1e-9)
    assert time.time() - start < 120
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "aggregate(" not in plan
