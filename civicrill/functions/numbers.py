"""Sums, ratios, tolerances and plane geometry as Column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(amount: Column) -> Column:
    """Money as a decimal, so that sums do not depend on the order of rows."""
    return amount.cast("decimal(18,2)")


def total(amount: Column) -> Column:
    """Sum of the known amounts; null (unknown, not zero) when none is known."""
    return F.sum(exact(amount)).cast("double")


def total_if(condition: Column, amount: Column) -> Column:
    return F.sum(F.when(condition, exact(amount))).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """Null when the whole is zero or unknown."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


RATES = (0.21, 0.15, 0.12)


def amounts_agree(x: Column, y: Column) -> Column:
    """exact, a VAT rate (either way), or null: equal within the larger of 1 and 2 per mille."""

    def near(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= F.greatest(F.lit(1.0), 0.002 * F.greatest(a, b))

    out = F.when(near(x, y), F.lit("exact"))
    for r in RATES:
        out = out.when(near(x * (1 + r), y) | near(x, y * (1 + r)), F.lit(f"vat{round(r * 100)}"))
    return out


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of points {x, y} (not closed); positive when it runs counter-clockwise."""
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    return F.aggregate(F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: an odd number of edges crosses the ray to the right."""
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))

    def crosses(a: Column, b: Column) -> Column:
        straddles = (a["y"] > y) != (b["y"] > y)
        return F.when(straddles & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, following, crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def in_polygon(rings: Column, x: Column, y: Column) -> Column:
    """Inside the outer ring and outside the holes: an odd number of rings contains the point."""
    return F.size(F.filter(rings, lambda r: in_ring(r, x, y))) % 2 == 1


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(pi / 4) + lat * (pi / 360)))
