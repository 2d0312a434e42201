"""Polygon and grid-cell geometry as joins and column expressions.

A polygon layer is ``geo_id`` plus ``rings``: arrays of points, outer rings counter-clockwise and holes
clockwise. Its edges are cut at the lines of a grid of tiles, so that every tile gets its own short pieces and nothing
else of the polygon; cells and points meet the pieces of their tile in an equi-join, and what the pieces of a pair
contribute is summed by partial aggregates. A polygon of any number of vertices is spread over tasks, and no geometry
library and no Python worker is involved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"


# ---------------------------------------------------------------- rings
def _ring_area(ring: Column) -> Column:
    """Signed area of a ring by the shoelace sum; the last point may or may not repeat the first."""
    n = F.size(ring)
    terms = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"]
        - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"],
    )
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2


def _oriented(ring: Column, outer: Column) -> Column:
    return F.when((_ring_area(ring) > 0) == outer, ring).otherwise(F.reverse(ring))


def rings_from_wkt(wkt: Column) -> Column:
    """Rings of POLYGON / MULTIPOLYGON text, oriented so that holes count negative."""
    body = F.regexp_replace(F.regexp_replace(wkt, r"(?i)^\s*(MULTI)?POLYGON\s*", ""), r"\s+", " ")
    polygons = F.split(body, r"\)\s*\)\s*,\s*\(\s*\(")

    def point(text: Column) -> Column:
        xy = F.split(F.trim(text), " ")
        return F.struct(F.get(xy, F.lit(0)).cast("double").alias("x"), F.get(xy, F.lit(1)).cast("double").alias("y"))

    def ring(text: Column, i: Column) -> Column:
        points = F.transform(F.split(F.regexp_replace(text, r"[()]", ""), ","), point)
        return _oriented(points, i == 0)

    return F.flatten(
        F.transform(polygons, lambda p: F.transform(F.split(p, r"\)\s*,\s*\("), ring))
    )


def wkt_from_rings(rings: Column) -> Column:
    """POLYGON text of one polygon (outer ring first)."""
    point = lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))


def rectangle_ring(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Rings of an axis-aligned rectangle."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)))


def edges_of(rings: Column) -> Column:
    """All directed edges (ax, ay, bx, by) of a ring list, each ring closed."""

    def of_ring(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                F.get(ring, i)["x"].alias("ax"),
                F.get(ring, i)["y"].alias("ay"),
                F.get(ring, (i + 1) % n)["x"].alias("bx"),
                F.get(ring, (i + 1) % n)["y"].alias("by"),
            ),
        )

    return F.flatten(F.transform(rings, of_ring))


def _sine(ring_list: Column) -> Column:
    """The same rings with y replaced by sin(latitude): the cylindrical equal-area plane."""
    return F.transform(
        ring_list,
        lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), F.sin(F.radians(p["y"])).alias("y"))),
    )


# ---------------------------------------------------------------- pieces by tile
# Columns of a piece: from (_ax, _ay) to (_bx, _by), counted _m times; _edge: whether it lies on the boundary.
PIECE = ["_ax", "_ay", "_bx", "_by"]
# Share of the summed sizes of its terms up to which a sum is rounding noise.
NOISE = 1e-12


def _index(v: Column, tile: float) -> Column:
    """Number of the tile that holds ``v``: i * tile <= v < (i + 1) * tile, as the lines between tiles are computed."""
    i = F.floor(v / tile).cast("long")
    return F.when(v >= (i + 1) * tile, i + 1).when(v < i * tile, i - 1).otherwise(i)


def boundary_pieces(polygons: DataFrame, keys: Sequence[str], tile_x: float, tile_y: float) -> DataFrame:
    """The boundary of every polygon (keys, geo_id, rings) cut into pieces by tile, with what lies above each tile.

    Columns: ``keys``, geo_id, _tx, _ty, the piece, _m and _edge. Seen from inside a tile, the part of the polygon above it
    is told by the winding number along the tile's upper side. It is that of the upper left corner, and changes by one
    where the boundary crosses the side. Both enter as horizontal pieces on the upper side: one of full width, counted
    as often as the corner is wound round, and one from each crossing to the right. A tile that lies wholly inside gets that
    one piece of full width, however far the boundary is.
    """
    ids = [*keys, "geo_id"]
    edges = polygons.select(*ids, F.explode(edges_of(F.col("rings"))).alias("e")).select(*ids, "e.*")
    ca, cb = _index(F.col("ax"), tile_x), _index(F.col("bx"), tile_x)
    cut = edges.withColumn("_tx", F.explode(F.sequence(F.least(ca, cb), F.greatest(ca, cb))))
    left, right = F.col("_tx") * tile_x, (F.col("_tx") + 1) * tile_x
    slope = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))

    def end(at: Column, x: str, y: str) -> tuple[Column, Column]:
        """The edge's end, or where it meets the side of the column beyond which the end lies."""
        side = F.when(at < F.col("_tx"), left).when(at > F.col("_tx"), right)
        return F.coalesce(side, F.col(x)), F.coalesce(F.col("ay") + (side - F.col("ax")) * slope, F.col(y))

    (pax, pay), (pbx, pby) = end(ca, "ax", "ay"), end(cb, "bx", "by")
    cut = cut.select(
        *ids, "_tx", pax.alias("_ax"), pay.alias("_ay"), pbx.alias("_bx"), pby.alias("_by"),
        # Through the left side of the column: 1 from right to left, -1 from left to right.
        (F.when(ca < F.col("_tx"), -1).otherwise(0) + F.when(cb < F.col("_tx"), 1).otherwise(0)).alias("_through"),
        F.when(ca < F.col("_tx"), pay).otherwise(pby).alias("_at"),
    )
    ra, rb = _index(F.col("_ay"), tile_y), _index(F.col("_by"), tile_y)
    pieces = cut.withColumn("_ty", F.explode(F.sequence(F.least(ra, rb), F.greatest(ra, rb))))
    low, high = F.col("_ty") * tile_y, (F.col("_ty") + 1) * tile_y
    run = (F.col("_bx") - F.col("_ax")) / F.nullif(F.col("_by") - F.col("_ay"), F.lit(0.0))

    def clip(at: Column, x: str, y: str) -> tuple[Column, Column]:
        side = F.when(at < F.col("_ty"), low).when(at > F.col("_ty"), high)
        return F.coalesce(F.col("_ax") + (side - F.col("_ay")) * run, F.col(x)), F.coalesce(side, F.col(y))

    (qax, qay), (qbx, qby) = clip(ra, "_ax", "_ay"), clip(rb, "_bx", "_by")
    up, down = (ra <= F.col("_ty")) & (rb > F.col("_ty")), (rb <= F.col("_ty")) & (ra > F.col("_ty"))
    part = lambda ax, ay, bx, by, m, edge: F.struct(
        ax.alias("_ax"), ay.alias("_ay"), bx.alias("_bx"), by.alias("_by"), m.cast("long").alias("_m"), F.lit(edge).alias("_edge")
    )
    # The interior lies left of the boundary's direction, so what is above ends at a crossing upwards and begins downwards.
    crossing = F.when(up, part(right, high, qbx, high, F.lit(-1), False)).when(down, part(right, high, qax, high, F.lit(1), False))
    own = F.filter(F.array(part(qax, qay, qbx, qby, F.lit(1), True), crossing), lambda p: p.isNotNull())
    pieces = pieces.select(*ids, "_tx", "_ty", F.explode(own).alias("p")).select(*ids, "_tx", "_ty", "p.*")

    # Corners: the lines between columns are crossed at a few rows; between two of them the winding number is the same.
    through = cut.where("_through != 0").groupBy(*ids, "_tx", _index(F.col("_at"), tile_y).alias("_row")).agg(F.sum("_through").alias("_n"))
    falling = Window.partitionBy(*ids, "_tx").orderBy(F.desc("_row"))
    wound = through.select(
        *ids, "_tx", "_row",
        F.sum("_n").over(falling.rowsBetween(Window.unboundedPreceding, 0)).alias("_m"),
        F.lead("_row").over(falling).alias("_next"),
    ).where((F.col("_m") != 0) & F.col("_next").isNotNull())
    inner = wound.withColumn("_ty", F.explode(F.sequence(F.col("_next"), F.col("_row") - 1)))
    corners = inner.select(*ids, "_tx", "_ty", part(right, high, left, high, F.col("_m"), False).alias("p"))
    return pieces.unionByName(corners.select(*ids, "_tx", "_ty", "p.*"))


def _tiles(df: DataFrame, x0: str, x1: str, y0: str, y1: str, tile_x: float, tile_y: float) -> DataFrame:
    """Rectangles cut by the tiles that they meet: adds _tx, _ty and the part's sides _x0, _x1, _y0, _y1."""
    span = lambda lo, hi, tile: F.explode(F.sequence(_index(F.col(lo), tile), _index(F.col(hi), tile)))
    out = df.withColumn("_tx", span(x0, x1, tile_x)).withColumn("_ty", span(y0, y1, tile_y))
    return out.withColumns(
        {
            "_x0": F.greatest(F.col(x0), F.col("_tx") * tile_x),
            "_x1": F.least(F.col(x1), (F.col("_tx") + 1) * tile_x),
            "_y0": F.greatest(F.col(y0), F.col("_ty") * tile_y),
            "_y1": F.least(F.col(y1), (F.col("_ty") + 1) * tile_y),
        }
    )


def shared_area() -> Column:
    """Signed area between a piece, cut to the rectangle _x0 .. _y1, and the rectangle's lower side.

    Its sum over the pieces of a tile is the area that polygon and rectangle share there, concave shapes and holes included.
    """
    ax, ay, bx, by = (F.col(c) for c in PIECE)
    x0, x1, y0, y1 = (F.col(c) for c in ("_x0", "_x1", "_y0", "_y1"))
    clamp = lambda y: F.least(F.greatest(y, y0), y1)
    slope = (by - ay) / F.nullif(bx - ax, F.lit(0.0))
    xa, xb = F.least(F.greatest(ax, x0), x1), F.least(F.greatest(bx, x0), x1)
    ya, yb = ay + (xa - ax) * slope, ay + (xb - ax) * slope
    lo, hi = F.least(ya, yb), F.greatest(ya, yb)
    # Mean of (min(max(y, y0), y1) - y0) while y runs evenly from ya to yb.
    inside = (clamp(hi) - clamp(lo)) * ((clamp(hi) + clamp(lo)) / 2 - y0)
    above = F.greatest(hi - F.greatest(lo, y1), F.lit(0.0)) * (y1 - y0)
    height = F.when(hi == lo, clamp(lo) - y0).otherwise((inside + above) / F.nullif(hi - lo, F.lit(0.0)))
    return F.when(xa == xb, F.lit(0.0)).otherwise(F.col("_m") * (xa - xb) * height)


def touches() -> Column:
    """Whether a piece of the boundary meets the closed rectangle _x0 .. _y1."""
    ax, ay, bx, by = (F.col(c) for c in PIECE)
    x0, x1, y0, y1 = (F.col(c) for c in ("_x0", "_x1", "_y0", "_y1"))
    apart = (F.greatest(ax, bx) < x0) | (F.least(ax, bx) > x1) | (F.greatest(ay, by) < y0) | (F.least(ay, by) > y1)
    side = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    one_side = (F.least(*corners) > 0) | (F.greatest(*corners) < 0)
    return F.col("_edge") & ~apart & ~one_side


def _pairs(cells: DataFrame, polygons: DataFrame, keys: Sequence[str], box: Sequence[str], tile: tuple[float, float]) -> DataFrame:
    """One row per cell and polygon that meet in a tile: the shared area, the size of its terms, and whether they touch."""
    ids = list(dict.fromkeys([*keys, "grid_id", "lat", "lon"]))
    parts = _tiles(cells.select(*dict.fromkeys([*ids, *box])), *box, *tile)
    # A piece beside or below the rectangle adds nothing; one above it adds its width.
    meets = (F.greatest("_ax", "_bx") >= F.col("_x0")) & (F.least("_ax", "_bx") <= F.col("_x1")) & (F.greatest("_ay", "_by") >= F.col("_y0"))
    joined = parts.join(boundary_pieces(polygons, keys, *tile), [*keys, "_tx", "_ty"]).where(meets)
    terms = joined.select(*ids, "geo_id", shared_area().alias("_a"), touches().alias("_t"))
    return terms.groupBy(*ids, "geo_id").agg(
        F.sum("_a").alias("_shared"), F.sum(F.abs("_a")).alias("_terms"), F.bool_or("_t").alias("_touch")
    )


def overlap_weights(
    cells: DataFrame, polygons: DataFrame, keys: Sequence[str] = (), tile: float = 1.0
) -> DataFrame:
    """Polygon x cell overlap: ``w`` is the shared area in (degrees longitude x sin latitude).

    ``keys`` are columns both sides share (a grid or domain id); only equal keys are compared. ``tile``: degrees of
    longitude, and about as many of latitude at the equator. What is left of terms that cancel is no overlap.
    """
    sin = lambda c: F.sin(F.radians(F.col(c)))
    plane = cells.withColumns({"_s0": sin("lat_lo"), "_s1": sin("lat_hi")})
    flat = polygons.withColumn("rings", _sine(F.col("rings")))
    pairs = _pairs(plane, flat, keys, ("lon_lo", "lon_hi", "_s0", "_s1"), (tile, math.radians(tile)))
    overlap = pairs.where(F.col("_shared") > F.col("_terms") * NOISE).withColumn("w", F.col("_shared"))
    return overlap.select(*dict.fromkeys([*keys, "grid_id", "geo_id", "lat", "lon", "w"]))


def join_cells(
    cells: DataFrame, polygons: DataFrame, predicate: str, keys: Sequence[str] = (), tile: float = 1.0
) -> DataFrame:
    """Cells with the polygons they lie ``within`` (inner) or that they ``intersects`` (left join).

    Predicates are evaluated in the longitude-latitude plane.
    """
    box = ("lon_lo", "lon_hi", "lat_lo", "lat_hi")
    ids = list(dict.fromkeys([*keys, "grid_id", "lat", "lon"]))
    pairs = _pairs(cells, polygons, keys, box, (tile, tile))
    if predicate == "within":
        sizes = cells.select(*ids, ((F.col("lon_hi") - F.col("lon_lo")) * (F.col("lat_hi") - F.col("lat_lo"))).alias("_cell"))
        near = F.abs(F.col("_shared") - F.col("_cell")) <= F.col("_cell") * 1e-9
        return pairs.join(sizes, ids).where(near).select(*ids, "geo_id")
    if predicate == "intersects":
        hits = pairs.where((F.col("_shared") > F.col("_terms") * NOISE) | F.col("_touch")).select(*ids, "geo_id")
        return cells.select(*ids).join(hits, ids, "left")
    raise ValueError(f"unknown predicate {predicate!r}")


def cell_means(joined: DataFrame, attributes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of polygon attributes over the polygons joined to each cell."""
    return (
        joined.join(attributes, "geo_id", "left")
        .groupBy("grid_id", "lat", "lon")
        .agg(*[F.avg(c).alias(c) for c in columns], F.count("geo_id").alias("n_polygons"))
    )


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, keys: Sequence[str] = (), tile: float = 1.0
) -> DataFrame:
    """Points (lat, lon) that lie in at least one polygon, by the even-odd rule.

    A point counts the pieces of its tile that lie above it. Sides on the left and below belong to a polygon, those on the
    right and above do not.
    """
    x, y = F.col("lon"), F.col("lat")
    ids = list(dict.fromkeys([*keys, "grid_id", "lat", "lon"]))
    asked = points.select(*ids).distinct()
    asked = asked.withColumns({"_tx": _index(x, tile), "_ty": _index(y, tile)})
    ax, ay, bx, by = (F.col(c) for c in PIECE)
    spans = (ax > x) != (bx > x)
    at = ay + (x - ax) * ((by - ay) / F.nullif(bx - ax, F.lit(0.0)))
    over = asked.join(boundary_pieces(polygons, keys, tile, tile), [*keys, "_tx", "_ty"]).where(spans & (at > y))
    counted = over.groupBy(*ids, "geo_id").agg(F.sum("_m").alias("_n")).where(F.col("_n") % 2 != 0)
    return points.join(counted.select(*ids).distinct(), ids, "left_semi")


def polygon_area(rings: Column) -> Column:
    """Planar area of a ring list, holes taken off."""
    return F.aggregate(rings, F.lit(0.0), lambda a, r: a + _ring_area(r))
