"""Points in areas by a grid: areas are dealt to the cells that they meet, points to their own cell, and both meet by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.functions.numbers import in_polygon


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _edges(rings: Column) -> Column:
    """Edges from each corner to the next, of all rings."""
    turned = lambda r: F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(1), F.lit(1)))
    one = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return F.flatten(F.transform(rings, lambda r: F.zip_with(r, turned(r), one)))


def _passes(e: Column, x: Column, y: Column, size: float) -> Column:
    """Whether an edge meets the closed cell whose lower corner is x, y: boxes overlap, and the corners are not all on one side."""
    overlap = (F.least(e["ax"], e["bx"]) <= x + size) & (F.greatest(e["ax"], e["bx"]) >= x) & (F.least(e["ay"], e["by"]) <= y + size) & (F.greatest(e["ay"], e["by"]) >= y)
    side = lambda px, py: F.signum((e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"]))
    corners = [side(x, y), side(x + size, y), side(x, y + size), side(x + size, y + size)]
    return overlap & (F.greatest(*corners) >= 0) & (F.least(*corners) <= 0)


def crossings(edges: Column, x: Column, y: Column) -> Column:
    """How many edges cross the ray from a point to the right, each counted at its lower end only."""
    straddles = lambda e: (e["ay"] > y) != (e["by"] > y)
    level = lambda e: F.when(e["by"] == e["ay"], F.lit(1.0)).otherwise(e["by"] - e["ay"])
    return F.size(F.filter(edges, lambda e: straddles(e) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / level(e) + e["ax"])))


def index(areas: DataFrame, area: str, size: float) -> DataFrame:
    """(area, cx, cy, inner, edges): the cells that an area meets.

    A cell that no edge meets is inner, or of another area and left out. Cells at the border keep the edges that a ray
    from them to the right can meet.
    """
    points = F.flatten("rings")
    ends = lambda axis: F.sequence(cell(F.array_min(F.transform(points, lambda p: p[axis])), size), cell(F.array_max(F.transform(points, lambda p: p[axis])), size))
    rows = areas.filter(F.size(points) > 0).withColumn("edges", _edges(F.col("rings"))).withColumn("cx", F.explode(ends("x"))).withColumn("cy", F.explode(ends("y")))
    x, y = F.col("cx") * size, F.col("cy") * size
    border = F.exists("edges", lambda e: _passes(e, x, y, size))
    rows = rows.withColumn("border", border).filter(F.col("border") | in_polygon(F.col("rings"), x + size / 2, y + size / 2))
    right = F.filter("edges", lambda e: (F.greatest(e["ax"], e["bx"]) >= x) & (F.least(e["ay"], e["by"]) <= y + size) & (F.greatest(e["ay"], e["by"]) >= y))
    return rows.select(area, "cx", "cy", (~F.col("border")).alias("inner"), F.when(F.col("border"), right).alias("edges"))


def points_in_areas(points: DataFrame, areas: DataFrame, point: str, area: str, size: float) -> DataFrame:
    """(point, area) of all areas (area, rings of {x, y}) that contain a point (point, x, y), by the even-odd rule.

    ``size`` is the edge of a cell; any size is right, one of a few cells per area is fast. Cells are an equality key, so
    many points in one cell are dealt by Spark's handling of skew. Points without coordinates are in no area.
    """
    p = points.filter("x is not null and y is not null").select(point, "x", "y", cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    met = p.join(index(areas, area, size), ["cx", "cy"])
    return met.filter(F.col("inner") | (crossings(F.col("edges"), F.col("x"), F.col("y")) % 2 == 1)).select(point, area)
