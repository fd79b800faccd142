"""Geometric transforms of coordinates and radii."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from . import topology as T


def affine(nodes: DataFrame, m: V.Matrix, center: str = "origin") -> DataFrame:
    """x, y, z moved by a 4 x 4 matrix about the origin or the root of each tree: M (p - c) + c."""
    if center not in ("origin", "root"):
        raise ValueError("center must be 'origin' or 'root'")
    n = nodes
    if center == "root":
        r = T.roots(nodes).groupBy("tree_id").agg(F.min_by(F.struct("x", "y", "z"), "id").alias("_c"))
        n = nodes.join(r, "tree_id")
        c = V.of(F.col("_c"))
        moved = V.add(V.apply(m, V.sub(V.vec(), c)), c)
    else:
        moved = V.apply(m, V.vec())
    return n.withColumns(dict(zip("xyz", moved))).select(*nodes.columns)


def translate(nodes: DataFrame, tx: float, ty: float, tz: float) -> DataFrame:
    return affine(nodes, V.translate3d(tx, ty, tz))


def translate_origin(nodes: DataFrame) -> DataFrame:
    """The root of every tree moved to the origin."""
    r = T.roots(nodes).groupBy("tree_id").agg(F.min_by(F.struct("x", "y", "z"), "id").alias("_c"))
    return nodes.join(r, "tree_id").withColumns({c: F.col(c) - F.col(f"_c.{c}") for c in "xyz"}).select(*nodes.columns)


def scale(nodes: DataFrame, sx: float, sy: float, sz: float, center: str = "root") -> DataFrame:
    return affine(nodes, V.scale3d(sx, sy, sz), center)


def rotate(nodes: DataFrame, axis: tuple[float, float, float], theta: float, center: str = "root") -> DataFrame:
    return affine(nodes, V.rotate3d(axis, theta), center)


def rotate_x(nodes: DataFrame, theta: float, center: str = "root") -> DataFrame:
    return affine(nodes, V.rotate3d_x(theta), center)


def rotate_y(nodes: DataFrame, theta: float, center: str = "root") -> DataFrame:
    return affine(nodes, V.rotate3d_y(theta), center)


def rotate_z(nodes: DataFrame, theta: float, center: str = "root") -> DataFrame:
    return affine(nodes, V.rotate3d_z(theta), center)


def normalise(nodes: DataFrame, by_range: bool = False) -> DataFrame:
    """(v - min) / max of x, y, z, r in every tree (over the range instead of the maximum, if ``by_range``); null at 0."""
    agg = nodes.groupBy("tree_id").agg(*(f(c).alias(f"_{n}_{c}") for c in "xyzr" for n, f in (("lo", F.min), ("hi", F.max))))
    j = nodes.join(agg, "tree_id")
    over = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}") if by_range else F.col(f"_hi_{c}")
    return j.withColumns({c: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), over(c)) for c in "xyzr"}).select(*nodes.columns)


def reset_radius(nodes: DataFrame, r: float) -> DataFrame:
    return nodes.withColumn("r", F.lit(float(r))).select(*nodes.columns)
