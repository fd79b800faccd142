"""Areas, volumes and signed distances of spheres, frustums and round cones as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vector as V

PI = math.pi
EPS = 1e-6


def circle_area(r: Column) -> Column:
    return PI * r * r


def sphere_area(r: Column) -> Column:
    return 4 * PI * r * r


def sphere_volume(r: Column) -> Column:
    return 4.0 / 3.0 * PI * r * r * r


def cap_volume(r: Column, h: Column) -> Column:
    """Spherical cap of height h."""
    return PI * h * h * (3 * r - h) / 3


def cylinder_volume(r: Column, h: Column) -> Column:
    return PI * r * r * h


def cylinder_side_area(r: Column, h: Column) -> Column:
    return 2 * PI * r * h


def pill_area(ra: Column, rb: Column, h: Column) -> Column:
    """Side of a frustum with hemispheres of its two radii on its ends."""
    slant = F.sqrt((ra - rb) * (ra - rb) + h * h)
    return 2 * PI * ra * ra + 2 * PI * rb * rb + PI * (ra + rb) * slant


def frustum_volume(ra: Column, rb: Column, h: Column) -> Column:
    return PI * h * (ra * ra + ra * rb + rb * rb) / 3


def lens_volume(ra: Column, rb: Column, d: Column) -> Column:
    """Common volume of two spheres at distance d."""
    t = ra + rb - d
    lens = F.try_divide(PI * t * t * (d * d + 2 * d * ra - 3 * ra * ra + 2 * d * rb - 3 * rb * rb + 6 * ra * rb), 12 * d)
    return F.when(d > ra + rb, 0.0).when(d <= F.abs(ra - rb), sphere_volume(F.least(ra, rb))).otherwise(lens)


def two_spheres_union(ra: Column, rb: Column, d: Column) -> Column:
    return sphere_volume(ra) + sphere_volume(rb) - lens_volume(ra, rb, d)


def sphere_frustum_volume(r1: Column, r2: Column, h: Column) -> Column:
    """Common volume of a frustum (radii r1, r2, height h) and the sphere of radius r1 about its r1 end.

    The generator of the frustum leaves the sphere at the share t of its length; what lies below that
    height is frustum, what lies above is a cap, cut by the far end.
    """
    half = cap_volume(r1, r1)
    far = F.when(h >= r1, 0.0).otherwise(cap_volume(r1, r1 - h))
    slope = r2 - r1
    t = F.try_divide(-2 * r1 * slope, slope * slope + h * h)  # second meeting of the generator and the sphere
    h1, r3 = t * h, r1 + t * slope
    part = cap_volume(r1, r1 - h1) + frustum_volume(r1, r3, h1) - far
    return F.when(slope >= -EPS, half - far).when(t > 1 + EPS, frustum_volume(r1, r2, h)).otherwise(part)


def sphere_frustum_union(r1: Column, r2: Column, h: Column) -> Column:
    return sphere_volume(r1) + frustum_volume(r1, r2, h) - sphere_frustum_volume(r1, r2, h)


# Section: signed distances


def sdf_sphere(p: V.Vec, center: V.Vec, radius) -> Column:
    return V.distance(p, center) - radius


def sdf_frustum(p: V.Vec, a: V.Vec, b: V.Vec, ra: Column, rb: Column) -> Column:
    """Distance to a capped cone with end points a, b (which differ) and radii ra, rb.

    In the half plane through the axis: the nearer of a cap and the slanted side, negative inside.
    """
    axis, to = V.sub(b, a), V.sub(p, a)
    size, grow = V.dot(axis, axis), rb - ra
    share = F.try_divide(V.dot(to, axis), size)
    off = F.sqrt(F.greatest(V.dot(to, to) - size * share * share, F.lit(0.0)))
    beyond = F.greatest(F.lit(0.0), off - F.when(share < 0.5, ra).otherwise(rb))
    above = F.abs(share - 0.5) - 0.5
    foot = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((off - ra) * grow + share * size) / (size + grow * grow)))
    side, along = off - (ra + foot * grow), share - foot
    caps = F.pow(beyond, F.lit(2)) + size * F.pow(above, F.lit(2))
    slant = F.pow(side, F.lit(2)) + size * F.pow(along, F.lit(2))
    near = F.sqrt(F.least(caps, slant))
    return F.when((side < 0) & (above < 0), -near).otherwise(near)


def sdf_round_cone(p: V.Vec, a: V.Vec, b: V.Vec, ra: Column, rb: Column) -> Column:
    """Distance to the hull of two spheres; where one holds the other or their centres meet, to both.

    A point belongs to the sphere at a, to that at b or to the tangent cone between them, by where it
    lies along the axis against the slope of the cone.
    """
    axis, to = V.sub(b, a), V.sub(p, a)
    size, fall = V.dot(axis, axis), ra - rb
    reach = size - fall * fall
    before = V.dot(to, axis)
    after = before - size
    across = V.sub(V.scaled(to, size), V.scaled(axis, before))
    wide = V.dot(across, across)
    from_a, from_b = size * before * before, size * after * after
    tilt = F.signum(fall) * wide * fall * fall
    per = F.try_divide(F.lit(1.0), size)
    at_a = per * F.sqrt(wide + from_a) - ra
    at_b = per * F.sqrt(wide + from_b) - rb
    between = per * (before * fall + F.sqrt(F.greatest(per * reach * wide, F.lit(0.0)))) - ra
    cone = F.when(reach * from_a * F.signum(before) < tilt, at_a).when(reach * from_b * F.signum(after) > tilt, at_b).otherwise(between)
    apart = (size > 0) & (reach > 0)
    return F.when(apart, cone).otherwise(F.least(sdf_sphere(p, a, ra), sdf_sphere(p, b, rb)))


def sdf_union(*d: Column) -> Column:
    return F.least(*d) if len(d) > 1 else d[0]


def sdf_intersection(*d: Column) -> Column:
    return F.greatest(*d) if len(d) > 1 else d[0]


def sdf_difference(a: Column, b: Column) -> Column:
    return F.greatest(a, -b)


def in_box(p: V.Vec, low: V.Vec, high: V.Vec) -> Column:
    return reduce(lambda m, n: m & n, [(c >= lo) & (c <= hi) for c, lo, hi in zip(p, low, high)])


def inside(distance: Column, box: Column | None = None) -> Column:
    """Whether a point is inside: its box first, where one is given, then its distance."""
    return distance <= 0 if box is None else box & (distance <= 0)
