"""Vector and matrix algebra as Column expressions.

A vector is a triple of Columns, a matrix a 4 x 4 list of numbers that is folded on the driver before
it enters a plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Matrix = list[list[float]]


def vec(prefix: str = "") -> Vec:
    """The columns <prefix>x, <prefix>y, <prefix>z."""
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def of(v: Column) -> Vec:
    """The x, y, z fields of a struct."""
    return v["x"], v["y"], v["z"]


def const(v: Sequence[float]) -> Vec:
    a, b, c = (F.lit(float(x)) for x in v)
    return a, b, c


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def scaled(a: Vec, k) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def angle(a: Vec, b: Vec) -> Column:
    """Unsigned angle in radians; null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), F.when(n > 0, n)))))


def signed_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle from a to b in the plane, in (-pi, pi]."""
    return F.atan2(ax * by - ay * bx, ax * bx + ay * by)


def project_on_vector(v: Vec, target: Vec) -> Vec:
    """Projection of v on target; null where target is zero."""
    return scaled(target, F.try_divide(dot(v, target), dot(target, target)))


def project_on_plane(v: Vec, normal: Vec) -> Vec:
    return sub(v, project_on_vector(v, normal))


def project_point_on_line(a: Vec, direction: Vec, p: Vec) -> Vec:
    return add(a, project_on_vector(sub(p, a), direction))


def unit_vector_on_plane(normal: Vec) -> Vec:
    """A unit vector at right angles to normal: the same one every time (largest of the axis cross products)."""
    use_x = F.abs(normal[0]) <= F.abs(normal[1])
    zero = F.lit(0.0)
    a, b = cross(normal, const((1, 0, 0))), cross(normal, const((0, 1, 0)))
    v = tuple(F.when(use_x, p).otherwise(q) for p, q in zip(a, b))
    n = norm(v)
    return tuple(F.coalesce(F.try_divide(c, F.when(n > 0, n)), zero) for c in v)


def sphere_line(center: Vec, radius: Column, a: Vec, b: Vec) -> Column:
    """array<struct<t, x, y, z>> of the 0, 1 or 2 points where the line a + t (b - a) meets a sphere, by t."""
    d, f = sub(b, a), sub(a, center)
    qa, qb, qc = dot(d, d), 2 * dot(f, d), dot(f, f) - radius * radius
    disc = qb * qb - 4 * qa * qc

    def point(t: Column) -> Column:
        p = add(a, scaled(d, t))
        return F.struct(t.alias("t"), p[0].alias("x"), p[1].alias("y"), p[2].alias("z"))

    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    lo, hi = F.try_divide(-qb - root, 2 * qa), F.try_divide(-qb + root, 2 * qa)
    none = F.slice(F.array(point(lo)), 1, 0)
    return F.when(disc < 0, none).when(disc == 0, F.array(point(lo))).otherwise(F.array(point(lo), point(hi)))


def padded(values: Column, n: int, fill: float = 0.0) -> Column:
    """An array cut or filled to n values."""
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(values), F.lit(0)))
    return F.slice(F.concat(values, more), 1, n)


# Section: matrices


def identity() -> Matrix:
    return [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]


def matmul(*ms: Matrix) -> Matrix:
    """Product from left to right: the last factor is applied first."""
    out = ms[0]
    for m in ms[1:]:
        out = [[sum(out[i][k] * m[k][j] for k in range(4)) for j in range(4)] for i in range(4)]
    return out


def scale3d(*k: float) -> Matrix:
    """Scaling by kx, ky, kz."""
    m = identity()
    m[0][0], m[1][1], m[2][2] = map(float, k)
    return m


def translate3d(*d: float) -> Matrix:
    """Shift by dx, dy, dz."""
    m = identity()
    m[0][3], m[1][3], m[2][3] = map(float, d)
    return m


def rotate3d(n: Sequence[float], theta: float) -> Matrix:
    """Rotation about an axis by Rodrigues' formula; the axis may have any length but zero."""
    size = math.sqrt(sum(v * v for v in n))
    if not size:
        raise ValueError("the axis of a rotation is zero")
    x, y, z = (v / size for v in n)
    c, s = math.cos(theta), math.sin(theta)
    k = 1 - c
    m = identity()
    m[0][:3] = [c + x * x * k, x * y * k - z * s, x * z * k + y * s]
    m[1][:3] = [y * x * k + z * s, c + y * y * k, y * z * k - x * s]
    m[2][:3] = [z * x * k - y * s, z * y * k + x * s, c + z * z * k]
    return m


def rotate3d_x(theta: float) -> Matrix:
    return rotate3d((1, 0, 0), theta)


def rotate3d_y(theta: float) -> Matrix:
    return rotate3d((0, 1, 0), theta)


def rotate3d_z(theta: float) -> Matrix:
    return rotate3d((0, 0, 1), theta)


def model_view(position: Sequence[float], look_at: Sequence[float], up: Sequence[float]) -> Matrix:
    """Camera matrix: the position becomes the origin, the gaze the negative z-axis, ``up`` the y-axis."""

    def unit(v):
        size = math.sqrt(sum(c * c for c in v))
        return [c / size for c in v]

    g, t = unit(look_at), unit(up)
    e = list(position)
    side = [g[1] * t[2] - g[2] * t[1], g[2] * t[0] - g[0] * t[2], g[0] * t[1] - g[1] * t[0]]
    turn = identity()
    turn[0][:3], turn[1][:3], turn[2][:3] = side, t, [-v for v in g]
    return matmul(turn, translate3d(-e[0], -e[1], -e[2]))


def orthographic() -> Matrix:
    """Projection along z."""
    m = identity()
    m[2][2] = 0.0
    return m


def apply(m: Matrix, p: Vec) -> Vec:
    """The point p moved by a matrix, divided by w where the last row is not (0, 0, 0, 1)."""
    rows = [p[0] * r[0] + p[1] * r[1] + p[2] * r[2] + F.lit(float(r[3])) for r in m]
    if m[3] == identity()[3]:
        return rows[0], rows[1], rows[2]
    return tuple(F.try_divide(v, rows[3]) for v in rows[:3])


def homogeneous(p: Vec, w: float) -> Column:
    return F.array(*p, F.lit(float(w)))
