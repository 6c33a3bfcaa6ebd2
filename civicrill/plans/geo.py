"""Points, rings and areas. Each nation stands for an area: a slanted ring, every second one with a hole; parts stand for points."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicrill.functions.geodesy import world, world_sql
from civicrill.functions.numbers import ring_area
from civicrill.operators.grid import points_in_areas
from civicrill.operators.keyed import places
from civicrill.plans.registry import query
from civicrill.sources.tables import table

#: Edge of a cell of the grid; an area is about ten wide.
CELL = 4.0

#: The same areas in SQL: corners, and edges from each corner to the next.
EDGES = """k AS (SELECT n_nationkey AS area, n_nationkey % 5 * 12 AS p, n_nationkey // 5 * 12 AS q, n_nationkey % 3 AS s FROM nation),
r AS (SELECT area, 0 AS ring, [p, p + 9, p + 10, p - 1] AS xs, [q, q + s, q + 9, q + 8] AS ys FROM k UNION ALL SELECT area, 1, [p + 3, p + 5, p + 5, p + 3], [q + 3, q + 3, q + 5, q + 5] FROM k WHERE area % 2 = 0),
v AS (SELECT area, ring, i, CAST(xs[i] AS DOUBLE) AS x, CAST(ys[i] AS DOUBLE) AS y FROM (SELECT *, unnest(range(1, 5)) AS i FROM r)),
e AS (SELECT a.area, a.ring, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM v a JOIN v b ON b.area = a.area AND b.ring = a.ring AND b.i = a.i % 4 + 1)"""
SPOTS = "spots AS (SELECT p_partkey AS point, p_brand AS brand, p_partkey * 37 % 620 / 10.0 AS x, p_partkey * 53 % 620 / 10.0 AS y FROM part)"


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area and its rings of points: the outer one, then holes."""
    k = F.col("n_nationkey")
    p, q, s = k % 5 * 12, F.floor(k / 5) * 12, k % 3
    ring = lambda *corners: F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    outer = ring((p, q), (p + 9, q + s), (p + 10, q + 9), (p - 1, q + 8))
    hole = ring((p + 3, q + 3), (p + 5, q + 3), (p + 5, q + 5), (p + 3, q + 5))
    return table(spark, sf_dir, "nation").select(k.alias("area"), F.when(k % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("point"), F.col("p_brand").alias("brand"), (k * 37 % 620 / 10).alias("x"), (k * 53 % 620 / 10).alias("y"))


@query(f"""WITH {EDGES}, {SPOTS}, c AS (SELECT point, area, ring, COUNT(*) FILTER (WHERE (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / CASE WHEN b_y = ay THEN 1 ELSE b_y - ay END + ax) % 2 AS odd FROM spots, e GROUP BY 1, 2, 3)
SELECT point, area FROM c GROUP BY 1, 2 HAVING SUM(odd) % 2 = 1""")
def point_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN24, MA04: all areas that contain a point, holes left out. Areas and points meet by cells of a grid."""
    return points_in_areas(spots(spark, sf_dir), areas(spark, sf_dir), "point", "area", CELL)


@query(f"""WITH {EDGES}, s AS (SELECT area, ring, abs(SUM(ax * b_y - bx * ay)) / 2 AS size FROM e GROUP BY 1, 2) SELECT area, SUM(size) FILTER (WHERE ring = 0) AS outer_ring, coalesce(SUM(size) FILTER (WHERE ring > 0), 0.0) AS holes FROM s GROUP BY 1""")
def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA04: areas of the outer ring and of the holes."""
    holes = F.aggregate(F.transform(F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: F.abs(ring_area(r))), F.lit(0.0), lambda s, v: s + v)
    return areas(spark, sf_dir).select("area", F.abs(ring_area(F.col("rings")[0])).alias("outer_ring"), holes.alias("holes"))


@query(f"WITH {EDGES} SELECT area, MIN(ax) AS x0, MAX(ax) AS x1, MIN(ay) AS y0, MAX(ay) AS y1 FROM e GROUP BY 1")
def map_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG30: the box of all vertices."""
    v = areas(spark, sf_dir).select("area", F.explode(F.flatten("rings")).alias("p"))
    return v.groupBy("area").agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1"))


def _pixel(value: Column, low: Column, span: Column) -> Column:
    return F.floor(F.coalesce(F.try_divide(value - low, span), F.lit(0.0)) * 1000 + 0.5)


@query(f"""WITH {SPOTS}, b AS (SELECT brand, COUNT(*) AS n, MIN(x) AS x0, MIN(y) AS y0, greatest((MAX(x) - MIN(x)) * cos(((MIN(y) + MAX(y)) / 2) * {pi / 180!r}), MAX(y) - MIN(y)) AS span, cos(((MIN(y) + MAX(y)) / 2) * {pi / 180!r}) AS narrow FROM spots GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY point) - 1 AS i FROM spots) SELECT brand, point, CAST(floor(coalesce((x - x0) * narrow / nullif(span, 0), 0) * 1000 + 0.5) AS BIGINT) AS px, CAST(floor(coalesce((y - y0) / nullif(span, 0), 0) * 1000 + 0.5) AS BIGINT) AS py FROM o JOIN b USING (brand) WHERE i % CAST(ceil(n / 140.0) AS BIGINT) = 0""")
def drawing_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA05: points of a layer scaled to a drawing, east-west narrowed by the latitude, thinned to about 140."""
    s = spots(spark, sf_dir)
    narrow = F.cos((F.min("y") + F.max("y")) / 2 * F.lit(pi / 180))
    b = s.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), narrow.alias("narrow"), F.greatest((F.max("x") - F.min("x")) * narrow, F.max("y") - F.min("y")).alias("span"))
    o = places(s, ["brand"], F.col("point")).withColumn("i", F.col("place") - 1).join(b, "brand")
    kept = o.filter(F.col("i") % F.ceil(F.col("n") / 140) == 0)
    px = F.floor(F.coalesce(F.try_divide((F.col("x") - F.col("x0")) * F.col("narrow"), F.col("span")), F.lit(0.0)) * 1000 + 0.5)
    return kept.select("brand", "point", px.alias("px"), _pixel(F.col("y"), F.col("y0"), F.col("span")).alias("py"))


GRID = "grid AS (SELECT p_partkey AS point, -866718.0 + p_partkey * 37 % 4000 - 2000 AS east, -1038323.0 + p_partkey * 53 % 4000 - 2000 AS north FROM part WHERE p_partkey IS NOT NULL)"


@query(f"WITH {GRID}, {world_sql('grid')} SELECT point, lon, lat FROM world")
def grid_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA03: places of the national grid as longitude and latitude; parts stand for places around the town."""
    k = F.col("p_partkey")
    at = world(k * 37 % 4000 - 2000 + F.lit(-866718.0), k * 53 % 4000 - 2000 + F.lit(-1038323.0))
    return table(spark, sf_dir, "part").filter("p_partkey is not null").select(k.alias("point"), at.alias("at")).select("point", "at.lon", "at.lat")
