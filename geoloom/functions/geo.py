"""Distances and geometry as Column expressions; degrees unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
EARTH_RADIUS_M = 6370996.81
COORD_SCALE = 10_000_000
PLANAR_M_PER_DEGREE = 111195
EPSILON = 1e-7

#: Metres of one degree on the sphere above.
SPHERE_M_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def degrees_of(fixed) -> Column:
    """Degrees from a fixed-point integer."""
    return col(fixed) / F.lit(1e7)


def fixed_of(degrees) -> Column:
    """The fixed-point integer of degrees, cut off towards zero."""
    return (col(degrees) * F.lit(1e7)).cast("bigint")


def any_degrees(x) -> Column:
    """Degrees from either form: what exceeds 10^7 is fixed-point."""
    return F.when(F.abs(col(x)) > COORD_SCALE, col(x) / F.lit(1e7)).otherwise(col(x).cast("double"))


def planar_degrees(lat1, lon1, lat2, lon2) -> Column:
    return F.sqrt(F.pow(col(lon1) - col(lon2), F.lit(2.0)) + F.pow(col(lat1) - col(lat2), F.lit(2.0)))


def planar_m(lat1, lon1, lat2, lon2) -> Column:
    """Euclid in degrees times a constant; overstates east-west."""
    return planar_degrees(lat1, lon1, lat2, lon2) * F.lit(float(PLANAR_M_PER_DEGREE))


def sphere_m(lat1, lon1, lat2, lon2) -> Column:
    """Law of cosines on the sphere; the cosine is held to [-1, 1]. Null if a coordinate is."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    turn = F.cos(F.radians(col(lon1) - col(lon2)))
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * turn
    # Not least and greatest: they pass over a null.
    held = F.when(cosine > 1, F.lit(1.0)).when(cosine < -1, F.lit(-1.0)).otherwise(cosine)
    return F.lit(EARTH_RADIUS_M) * F.acos(held)


def degrees_of_metres(metres) -> Column:
    return F.degrees(col(metres) / F.lit(EARTH_RADIUS_M))


def triangle_height(left, right, base) -> Column:
    """Height over ``base`` of a triangle with these sides (Heron); null if the base is 0."""
    left, right, base = col(left), col(right), col(base)
    p = (left + right + base) / 2
    area = F.sqrt(F.greatest(p * (p - left) * (p - right) * (p - base), F.lit(0.0)))
    return F.try_divide(2 * area, base)


def beside_segment(y, x, y1, x1, y2, x2) -> Column:
    """Whether the point's foot lies on the segment: neither end's angle is obtuse. Any one unit."""
    y, x, y1, x1, y2, x2 = (col(c).cast("double") for c in (y, x, y1, x1, y2, x2))
    at_first = (y - y1) * (y2 - y1) + (x - x1) * (x2 - x1)
    at_second = (y - y2) * (y1 - y2) + (x - x2) * (x1 - x2)
    return (at_first >= -EPSILON) & (at_second >= -EPSILON)


def in_box(lat, lon, min_lat, max_lat, min_lon, max_lon) -> Column:
    """Inclusive on all sides."""
    return col(lat).between(col(min_lat), col(max_lat)) & col(lon).between(col(min_lon), col(max_lon))
