"""Data of drawings: projected and coloured segments, bounds and rings. Drawing itself is left to a plotter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from . import topology as T

CAMERAS = {
    "xy": ((0, 0, 1), (0, 0, -1), (0, 1, 0)), "xz": ((0, -1, 0), (0, 1, 0), (0, 0, 1)), "yz": ((1, 0, 0), (-1, 0, 0), (0, 0, 1)),
    "yx": ((0, 0, -1), (0, 0, 1), (1, 0, 0)), "zx": ((0, 1, 0), (0, -1, 0), (1, 0, 0)), "zy": ((-1, 0, 0), (1, 0, 0), (0, 1, 0)),
}
#: Colours by node type, 0 to 7; another type takes its remainder.
PALETTE = ["#262626", "#e64b35", "#3c5488", "#00a087", "#8f63b8", "#f39b7f", "#7e6148", "#4dbbd5"]


def camera(view: str | tuple = "xy") -> V.Matrix:
    """View and projection of a named camera, or of (position, look at, up)."""
    position, look_at, up = CAMERAS[view] if isinstance(view, str) else view
    return V.matmul(V.orthographic(), V.model_view(position, look_at, up))


def segments(nodes: DataFrame, view: str | tuple = "xy", colour: str | None = None) -> DataFrame:
    """(tree_id, id, x0, y0, x1, y1, colour): every edge as the camera sees it, coloured by its parent's type."""
    m = camera(view)
    e = T.edges(nodes)
    a, b = V.apply(m, V.vec("p_")), V.apply(m, V.vec("c_"))
    palette = F.array(*map(F.lit, PALETTE))
    c = F.lit(colour) if colour else F.get(palette, F.pmod(F.col("p_type"), F.lit(len(PALETTE))))
    return e.select("tree_id", "id", a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"), c.alias("colour"))


def segments3d(nodes: DataFrame) -> DataFrame:
    e = T.edges(nodes)
    return e.select("tree_id", "id", *(F.col(f"p_{c}").alias(f"{c}0") for c in "xyz"), *(F.col(f"c_{c}").alias(f"{c}1") for c in "xyz"), F.get(F.array(*map(F.lit, PALETTE)), F.pmod(F.col("p_type"), F.lit(len(PALETTE)))).alias("colour"))


def boxes(nodes: DataFrame, by: str = "tree_id") -> DataFrame:
    """Bounding boxes: minimum and maximum of x, y, z."""
    return nodes.groupBy(by).agg(*(F.min(c).alias(f"min_{c}") for c in "xyz"), *(F.max(c).alias(f"max_{c}") for c in "xyz"))


def rings(profile: DataFrame) -> DataFrame:
    """Sholl profile as rings: shade is the share of the highest count of the tree."""
    top = profile.groupBy("tree_id").agg(F.max("crossings").alias("_m"))
    return profile.join(top, "tree_id").withColumn("shade", F.coalesce(F.try_divide("crossings", "_m"), F.lit(0.0))).drop("_m")
