"""Registered queries of the morphology engine and their SQL equivalents.

Every query reads the forest view over ``events``; the SQL is what DuckDB runs on the same tables.
Doubles are rounded on both sides, as sums depend on the order of addition.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import solids as S
from ..functions import vector as V
from ..operators import branching, construct, features, geometry, graphs, images, lmeasure, population, surgery, views, volume
from ..operators import topology as T
from ..sources import swc
from .forest import BRANCH, CTE, WALK, forest

FLAGSHIP = "tree_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0 made 0), integers widened to long.

    Rounded as DuckDB does it, by a product with a power of ten: by its decimals, as Spark's ``round`` takes
    it, a number close to a tie can fall to the other side.
    """
    out = []
    for c, kind in df.dtypes:
        if kind == "double":
            out.append((F.round(F.col(c) * 10.0**digits) / 10.0**digits + F.lit(0.0)).alias(c))
        elif kind == "float":
            out.append((F.round(c, digits) + F.lit(0.0)).alias(c))
        elif kind in ("int", "smallint"):
            out.append(F.col(c).cast("long").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def register(name: str, plan: Callable[[DataFrame], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    """A query that applies ``plan`` to the forest; ``sql`` continues the CTEs of ``forest``."""
    QUERIES[name] = lambda spark, sf_dir: rounded(plan(forest(spark, sf_dir)), digits)
    if sql:
        ORACLE_SQL[name] = sql


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _big(*names: str) -> str:
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)


NODE = "tree_id, " + _big("id", "type", "pid") + ", " + ", ".join(_r(c, c) for c in "xyzr")

# Section: plain table queries

register("tree_summary", features.tree_summary, CTE + f"""
SELECT tree_id, count(*)::BIGINT AS n_nodes, sum((pid <> -1)::INT)::BIGINT AS n_edges, sum((n_children = 0)::INT)::BIGINT AS n_tips,
       sum((n_children > 1)::INT)::BIGINT AS n_furcations, sum(CASE WHEN pid = -1 THEN n_children ELSE 0 END)::BIGINT AS n_stems,
       {_r('sum(coalesce(step, 0))', 'length')}
FROM par GROUP BY tree_id""")
register("compartments", lambda n: T.edges(n).select("tree_id", "id", "pid", "length"), CTE + f"SELECT tree_id, {_big('id', 'pid')}, {_r('step', 'length')} FROM par WHERE pid <> -1")
register("adjacency", T.adjacency, CTE + "SELECT tree_id, pid::BIGINT AS i, id::BIGINT AS j, 1::BIGINT AS v FROM nodes WHERE pid <> -1")
register("child_counts", lambda n: T.child_counts(n).select("tree_id", "id", "n_children"), CTE + "SELECT tree_id, id::BIGINT AS id, n_children FROM nc")
register("tips", lambda n: T.tips(n).select("tree_id", "id"), CTE + "SELECT tree_id, id::BIGINT AS id FROM nc WHERE n_children = 0")
register("furcations", lambda n: T.furcations(n).select("tree_id", "id"), CTE + "SELECT tree_id, id::BIGINT AS id FROM nc WHERE n_children > 1")
register("soma", lambda n: T.soma(n).select("tree_id", "id", "x", "y", "z", "r"), CTE + f"SELECT tree_id, id::BIGINT AS id, {', '.join(_r(c, c) for c in 'xyzr')} FROM nodes WHERE pid = -1")
register("radial_distance", lambda n: features.radial_distance(n).select("tree_id", "id", "radial_distance"), CTE + f"SELECT tree_id, id::BIGINT AS id, {_r('rd', 'radial_distance')} FROM rad")
for kind, cond in (("tip", "n_children = 0"), ("furcation", "n_children > 1")):
    register(f"radial_distance_{kind}", lambda n, k=kind: features.extract(n, f"{k}_radial_distance").select("tree_id", "pos", "value"), CTE + f"SELECT tree_id, id::BIGINT AS pos, {_r('rd', 'value')} FROM rad WHERE {cond}")
_SHOLL = """,
e AS (SELECT c.tree_id, least(c.rd, p.rd) AS lo, greatest(c.rd, p.rd) AS hi FROM rad c JOIN rad p ON c.tree_id = p.tree_id AND c.pid = p.id),
top AS (SELECT tree_id, max(rd) AS rmax FROM rad GROUP BY tree_id)"""
register("sholl", lambda n: features.sholl(n).select("tree_id", "k", "crossings"), CTE + _SHOLL + """
SELECT e.tree_id, k AS k, sum((lo <= k * rmax / 21 AND hi > k * rmax / 21)::INT)::BIGINT AS crossings
FROM e JOIN top USING (tree_id), range(1, 21) g(k) GROUP BY ALL""")
register("sholl_population", lambda n: features.sholl(n, shared=True).select("tree_id", "k", "crossings"), CTE + _SHOLL + """
SELECT e.tree_id, k AS k, sum((lo <= k * m.rmax / 21 AND hi > k * m.rmax / 21)::INT)::BIGINT AS crossings
FROM e, (SELECT max(rmax) AS rmax FROM top) m, range(1, 21) g(k) GROUP BY ALL""")
register("sholl_intersect", lambda n: features.sholl_at(n, 25.0), CTE + _SHOLL + " SELECT tree_id, sum((lo <= 25 AND hi > 25)::INT)::BIGINT AS crossings FROM e GROUP BY tree_id")
register("sholl_statistics", features.sholl_statistics, CTE + _SHOLL + f"""
SELECT tree_id, {_r('avg(c)', 'avg')}, {_r('stddev_pop(c)', 'std')}, sum(c)::BIGINT AS sum FROM (
  SELECT e.tree_id, k, sum((lo <= k * rmax / 21 AND hi > k * rmax / 21)::INT) AS c FROM e JOIN top USING (tree_id), range(1, 21) g(k) GROUP BY ALL)
GROUP BY tree_id""")
register("node_metrics", lmeasure.node_metrics, CTE + f"""
SELECT tree_id, {_big('id', 'type')}, {_r('2 * r', 'diameter')}, {_r('pow(2 * r, 1.5)', 'diameter_pow')}, {_r('pi() * r * r', 'section_area')}, {_r('rd', 'euc_distance')} FROM rad""")
register("compartment_metrics", lmeasure.compartment_metrics, CTE + f"""
SELECT tree_id, id::BIGINT AS id, {_r('step', 'length')}, {_r('2 * pi() * r * step', 'surface')}, {_r('pi() * r * r * step', 'volume')} FROM par WHERE pid <> -1""")
register("tree_metrics", lmeasure.tree_metrics, CTE + f"""
SELECT tree_id, sum(CASE WHEN pid = -1 THEN n_children ELSE 0 END)::BIGINT AS n_stems, sum((n_children > 1)::INT)::BIGINT AS n_bifs,
       sum((CASE WHEN pid = -1 THEN n_children <> 1 ELSE ppid = -1 OR p_children > 1 END)::INT)::BIGINT AS n_branch,
       sum((n_children = 0)::INT)::BIGINT AS n_tips, {_r('max(CASE WHEN pid = -1 THEN 4 * pi() * r * r END)', 'soma_surface')}
FROM par GROUP BY tree_id""")
register("extent_trimmed", lmeasure.trimmed_extent, CTE + "SELECT * FROM " + " JOIN ".join(
    f"(SELECT tree_id, round(max(v) - min(v), 6) + 0.0 AS {name} FROM (SELECT tree_id, {axis} AS v, row_number() OVER (PARTITION BY tree_id ORDER BY {axis}, id) - 1 AS k, count(*) OVER (PARTITION BY tree_id) AS n FROM nodes) WHERE k >= floor(n * ((1 - 0.95::DOUBLE) / 2)) AND k < floor(n * (1 - (1 - 0.95::DOUBLE) / 2)) GROUP BY tree_id) {name}_t"
    for axis, name in zip("xyz", ("width", "height", "depth"))
).replace("height_t", "height_t USING (tree_id)").replace("depth_t", "depth_t USING (tree_id)"))

_PAIR = """,
pr AS (SELECT tree_id, pid AS id, min(struct_pack(i := id, x := x, y := y, z := z, r := r)) AS a, max(struct_pack(i := id, x := x, y := y, z := z, r := r)) AS b
       FROM nodes WHERE pid <> -1 GROUP BY tree_id, pid HAVING count(*) = 2),
bf AS (SELECT p.*, pr.a, pr.b, pr.a.x - p.x AS ux, pr.a.y - p.y AS uy, pr.a.z - p.z AS uz, pr.b.x - p.x AS vx, pr.b.y - p.y AS vy, pr.b.z - p.z AS vz,
              p.px - p.x AS wx, p.py - p.y AS wy, p.pz - p.z AS wz FROM par p JOIN pr USING (tree_id, id))"""


def _angle(a: str, b: str) -> str:
    """Degrees between vectors with components a(x|y|z) and b(x|y|z)."""
    dot = " + ".join(f"{a}{c} * {b}{c}" for c in "xyz")
    na, nb = (f"sqrt({' + '.join(f'{v}{c} * {v}{c}' for c in 'xyz')})" for v in (a, b))
    return f"degrees(acos(greatest(-1.0, least(1.0, ({dot}) / nullif({na} * {nb}, 0)))))"


_DA, _DB, _DP = "2 * a.r", "2 * b.r", "2 * pr"
register("bif_local", lmeasure.bifurcation_local, CTE + _PAIR + f"""
SELECT tree_id, id::BIGINT AS id, {_r(_angle('u', 'v'), 'ampl_local', 4)},
       CASE WHEN pid <> -1 THEN round(least({_angle('w', 'u')}, {_angle('w', 'v')}), 4) + 0.0 END AS tilt_local,
       {_r(f'greatest({_DA}, {_DB}) / least({_DA}, {_DB})', 'daughter_ratio', 4)}, {_r(f'greatest({_DA}, {_DB}) / (2 * r)', 'parent_daughter_ratio', 4)},
       {_r(f'(pow({_DA}, 1.5) + pow({_DB}, 1.5)) / pow({_DP}, 1.5)', 'pk_classic', 4)}, {_r(f'(pow({_DA}, 2) + pow({_DB}, 2)) / pow({_DP}, 2)', 'pk_2', 4)}
FROM bf""", 4)
register("rall", lmeasure.rall_power, CTE + _PAIR + f"""
SELECT tree_id, id::BIGINT AS id, round(p, 4) + 0.0 AS rall_power, round((pow({_DA}, p) + pow({_DB}, p)) / pow({_DP}, p), 4) + 0.0 AS pk FROM (
  SELECT *, list_min(list_transform(range(1000), lambda k: struct_pack(y := pow({_DA}, k * 5::DOUBLE / 1000) + pow({_DB}, k * 5::DOUBLE / 1000) - pow({_DP}, k * 5::DOUBLE / 1000), p := k * 5::DOUBLE / 1000))).p AS p FROM bf WHERE pid <> -1)""", 4)
register("helix", lmeasure.helix, CTE + """,
h AS (SELECT c.tree_id, c.id, c.px - g.px AS ax, c.py - g.py AS ay, c.pz - g.pz AS az, g.px - q.px AS bx, g.py - q.py AS by_, g.pz - q.pz AS bz,
             c.x - c.px AS cx, c.y - c.py AS cy, c.z - c.pz AS cz
      FROM par c JOIN par g ON c.tree_id = g.tree_id AND c.pid = g.id JOIN par q ON g.tree_id = q.tree_id AND g.pid = q.id
      WHERE c.pid <> -1 AND g.pid <> -1 AND q.pid <> -1)
SELECT tree_id, id::BIGINT AS id, round(((ay * bz - az * by_) * cx + (az * bx - ax * bz) * cy + (ax * by_ - ay * bx) * cz)
  / nullif(3 * sqrt(ax*ax + ay*ay + az*az) * sqrt(bx*bx + by_*by_ + bz*bz) * sqrt(cx*cx + cy*cy + cz*cz), 0), 6) + 0.0 AS helix FROM h""")

# Section: geometry


def _affine_sql(m: V.Matrix, root: bool) -> str:
    c = {k: f"s.{k}" if root else "0.0" for k in "xyz"}
    cols = ", ".join(
        _r(f"(({' + '.join(f'(n.{k} - {c[k]}) * ({m[i][j]!r})::DOUBLE' for j, k in enumerate('xyz'))} + ({m[i][3]!r})::DOUBLE) + {c['xyz'[i]]})", "xyz"[i]) for i in range(3)
    )
    return CTE + f"SELECT n.tree_id, n.id::BIGINT AS id, n.type::BIGINT AS type, n.pid::BIGINT AS pid, {cols}, {_r('n.r', 'r')} FROM nodes n JOIN nodes s ON n.tree_id = s.tree_id AND s.pid = -1"


_HALF = math.pi / 5
register("affine_translate", lambda n: geometry.translate(n, 1.5, -2.0, 3.0), _affine_sql(V.translate3d(1.5, -2.0, 3.0), False))
register("affine_scale", lambda n: geometry.scale(n, 2.0, 0.5, 3.0), _affine_sql(V.scale3d(2.0, 0.5, 3.0), True))
register("affine_rotate", lambda n: geometry.rotate(n, (1.0, 2.0, 3.0), _HALF), _affine_sql(V.rotate3d((1.0, 2.0, 3.0), _HALF), True))
register("affine_rotate_x", lambda n: geometry.rotate_x(n, _HALF), _affine_sql(V.rotate3d_x(_HALF), True))
register("affine_rotate_y", lambda n: geometry.rotate_y(n, _HALF), _affine_sql(V.rotate3d_y(_HALF), True))
register("affine_rotate_z", lambda n: geometry.rotate_z(n, _HALF), _affine_sql(V.rotate3d_z(_HALF), True))
register("affine_origin", geometry.translate_origin, CTE + f"SELECT n.tree_id, n.id::BIGINT AS id, n.type::BIGINT AS type, n.pid::BIGINT AS pid, {', '.join(_r(f'n.{c} - s.{c}', c) for c in 'xyz')}, {_r('n.r', 'r')} FROM nodes n JOIN nodes s ON n.tree_id = s.tree_id AND s.pid = -1")
register("normalise", geometry.normalise, CTE + "SELECT tree_id, " + _big("id", "type", "pid") + ", " + ", ".join(_r(f"({c} - min({c}) OVER w) / nullif(max({c}) OVER w, 0)", c) for c in "xyzr") + " FROM nodes WINDOW w AS (PARTITION BY tree_id)")
register("radius_reset", lambda n: geometry.reset_radius(n, 2.5), CTE + f"SELECT tree_id, {_big('id', 'type', 'pid')}, {', '.join(_r(c, c) for c in 'xyz')}, 2.5::DOUBLE AS r FROM nodes")

# Section: volumes and signed distances

_LENS = "CASE WHEN step > r + pr THEN 0.0 WHEN step <= abs(r - pr) THEN 4.0 / 3 * pi() * least(r, pr) ** 3 ELSE pi() / (12 * step) * (r + pr - step) ** 2 * (step ** 2 + 2 * step * r - 3 * r ** 2 + 2 * step * pr - 3 * pr ** 2 + 6 * r * pr) END"


def _CONE(r1: str, r2: str) -> str:
    """Common volume of the frustum (r1, r2, step) and the sphere r1, as in ``solids.sphere_frustum_volume``."""
    cap = lambda r, h: f"(pi() * ({h}) ** 2 * (3 * ({r}) - ({h})) / 3)"
    fr = lambda a, b, h: f"(pi() * ({h}) * (({a}) ** 2 + ({a}) * ({b}) + ({b}) ** 2) / 3)"
    t = f"(-2 * {r1} * ({r2} - {r1}) / nullif(({r2} - {r1}) ** 2 + step ** 2, 0))"
    far = f"(CASE WHEN step >= {r1} THEN 0.0 ELSE {cap(r1, f'{r1} - step')} END)"
    return f"(CASE WHEN {r2} - {r1} >= -1e-6 THEN {cap(r1, r1)} - {far} WHEN {t} > 1 + 1e-6 THEN {fr(r1, r2, 'step')} ELSE {cap(r1, f'{r1} - {t} * step')} + {fr(r1, f'{r1} + {t} * ({r2} - {r1})', f'{t} * step')} - {far} END)"


_SPHERE, _FRUSTUM = "4.0 / 3 * pi() * r ** 3", "coalesce(pi() * step * (r * r + r * pr + pr * pr) / 3, 0)"
_INNER = f"CASE WHEN pid <> -1 THEN {_LENS} - {_CONE('pr', 'r')} - {_CONE('r', 'pr')} ELSE 0.0 END"
for level, expr in ((1, _SPHERE), (2, f"{_SPHERE} + {_FRUSTUM}"), (3, f"{_SPHERE} + {_FRUSTUM} + {_INNER}")):
    register(f"volume_acc{level}", lambda n, a=level: volume.tree_volume(n, accuracy=a), CTE + f"SELECT tree_id, round(sum({expr}), 4) + 0.0 AS volume FROM par GROUP BY tree_id", 4)
_P = (40.0, 30.0, 20.0)


def _sdf(n: DataFrame, which: str) -> DataFrame:
    e, p = T.edges(n), V.const(_P)
    a, b, ra, rb = V.vec("p_"), V.vec("c_"), F.col("p_r"), F.col("c_r")
    d = {"sphere": S.sdf_sphere(p, b, rb), "frustum": S.sdf_frustum(p, a, b, ra, rb), "round_cone": S.sdf_round_cone(p, a, b, ra, rb)}[which]
    return e.select("tree_id", "id", d.alias("distance"))


_EDGE = f""",
ed AS (SELECT *, x - px AS bx, y - py AS by_, z - pz AS bz, {_P[0]}::DOUBLE - px AS qx, {_P[1]}::DOUBLE - py AS qy, {_P[2]}::DOUBLE - pz AS qz, step * step AS bb FROM par WHERE pid <> -1),
el AS (SELECT *, qx * bx + qy * by_ + qz * bz AS yy, qx * qx + qy * qy + qz * qz AS qq, r - pr AS rba FROM ed),
em AS (SELECT *, yy / nullif(bb, 0) AS al, sqrt(greatest(qq - (yy / nullif(bb, 0)) ** 2 * bb, 0)) AS xx FROM el),
en AS (SELECT *, greatest(0, xx - CASE WHEN al < 0.5 THEN pr ELSE r END) AS cax, abs(al - 0.5) - 0.5 AS cay, greatest(0, least(1, (rba * (xx - pr) + al * bb) / (rba * rba + bb))) AS f FROM em)"""
register("sdf_sphere", lambda n: _sdf(n, "sphere"), CTE + f"SELECT tree_id, id::BIGINT AS id, {_r(f'sqrt((x - {_P[0]}) ** 2 + (y - {_P[1]}) ** 2 + (z - {_P[2]}) ** 2) - r', 'distance')} FROM par WHERE pid <> -1")
register("sdf_frustum", lambda n: _sdf(n, "frustum"), CTE + _EDGE + """
SELECT tree_id, id::BIGINT AS id, round((CASE WHEN xx - pr - f * rba < 0 AND cay < 0 THEN -1 ELSE 1 END)
  * sqrt(least(cax ** 2 + cay ** 2 * bb, (xx - pr - f * rba) ** 2 + (al - f) ** 2 * bb)), 6) + 0.0 AS distance FROM en""")
register("sdf_round_cone", lambda n: _sdf(n, "round_cone"), CTE + _EDGE + """,
rc AS (SELECT *, pr - r AS rr, bb - (pr - r) ** 2 AS a2, yy - bb AS zz, (qx * bb - bx * yy) ** 2 + (qy * bb - by_ * yy) ** 2 + (qz * bb - bz * yy) ** 2 AS x2 FROM em)
SELECT tree_id, id::BIGINT AS id, round(CASE
  WHEN bb = 0 OR a2 <= 0 THEN least(sqrt(qq) - pr, sqrt((qx - bx) ** 2 + (qy - by_) ** 2 + (qz - bz) ** 2) - r)
  WHEN sign(yy) * a2 * yy * yy * bb < sign(rr) * rr * rr * x2 THEN sqrt(x2 + yy * yy * bb) / bb - pr
  WHEN sign(zz) * a2 * zz * zz * bb > sign(rr) * rr * rr * x2 THEN sqrt(x2 + zz * zz * bb) / bb - r
  ELSE (sqrt(x2 * a2 / bb) + yy * rr) / bb - pr END, 6) + 0.0 AS distance FROM rc""")

# Section: walks along parents

register("checks", T.checks, CTE + """
SELECT tree_id, sum((pid = -1)::INT)::BIGINT AS n_components, bool_and(n_children <= 2 OR pid = -1) AS bifurcate, bool_and(n_children <= 2) AS bifurcate_with_root,
       bool_and(pid = -1 OR id > pid) AS sorted, false AS cyclic, sum((pid = -1)::INT) = 1 AS single_root FROM nc GROUP BY tree_id""")
register("components", lambda n: T.components(n).select("tree_id", "id", "component_id"), CTE + WALK + "SELECT tree_id, id::BIGINT AS id, 0::BIGINT AS component_id FROM walk")
register("path_distance", lambda n: T.root_walk(n).select("tree_id", "id", "depth", "path_length"), CTE + WALK + f"SELECT tree_id, id::BIGINT AS id, depth, {_r('plen', 'path_length')} FROM walk")
_PATHS = WALK + """,
pt AS (SELECT w.tree_id, w.id AS tip, w.plen, r.rd, CASE WHEN w.plen = 0 THEN 1 ELSE r.rd / w.plen END AS tort FROM walk w JOIN rad r USING (tree_id, id) WHERE w.n_children = 0)"""
register("path_features", features.path_features, CTE + _PATHS + f"SELECT tree_id, tip::BIGINT AS tip, {_r('plen', 'length')}, {_r('rd', 'straight')}, {_r('tort', 'tortuosity')} FROM pt")
register("longest_path", lambda n: features.longest_path(n).select("tree_id", "length"), CTE + _PATHS + f"SELECT tree_id, {_r('max(plen)', 'length')} FROM pt GROUP BY tree_id")
register("to_longest_path", features.to_longest_path, CTE + _PATHS + f""",
bt AS (SELECT tree_id, arg_min(tip, struct_pack(a := -plen, b := tip)) AS tip FROM pt GROUP BY tree_id),
up AS (SELECT n.* FROM nodes n JOIN bt ON n.tree_id = bt.tree_id AND n.id = bt.tip UNION ALL SELECT n.* FROM up u JOIN nodes n ON n.tree_id = u.tree_id AND n.id = u.pid)
SELECT {NODE} FROM up""")
register("furcation_order", lambda n: T.root_walk(n).select("tree_id", "id", "branch_order", "furcation_level"), CTE + WALK + "SELECT tree_id, id::BIGINT AS id, border AS branch_order, level AS furcation_level FROM walk")
register("node_branch_order", features.node_branch_order, CTE + WALK + """
SELECT w.tree_id, w.id::BIGINT AS id, (CASE WHEN w.pid = -1 THEN 0 ELSE w.border - (w.n_children > 1)::INT + 1 - (s.n_children > 1)::INT END)::BIGINT AS branch_order
FROM walk w JOIN nc s ON s.tree_id = w.tree_id AND s.pid = -1 WHERE w.pid = -1 OR w.n_children <> 1""")
_DESC = """,
anc AS (SELECT tree_id, id, id AS up, pid AS next FROM nodes UNION ALL SELECT a.tree_id, a.id, n.id, n.pid FROM anc a JOIN nodes n ON n.tree_id = a.tree_id AND n.id = a.next)"""
register("terminal_degree", lambda n: lmeasure.node_orders(n).select("tree_id", "id", "terminal_degree"), CTE + _DESC + """
SELECT a.tree_id, a.up::BIGINT AS id, sum((n.n_children = 0)::INT)::BIGINT AS terminal_degree FROM anc a JOIN nc n ON a.tree_id = n.tree_id AND a.id = n.id GROUP BY ALL""")
register("partition_asymmetry", lmeasure.partition_asymmetry, CTE + _DESC + """,
td AS (SELECT a.tree_id, a.up AS id, sum((n.n_children = 0)::INT) AS t FROM anc a JOIN nc n ON a.tree_id = n.tree_id AND a.id = n.id GROUP BY ALL)
SELECT n.tree_id, n.pid::BIGINT AS id, round(CASE WHEN min(t) = max(t) THEN 0 ELSE (max(t) - min(t))::DOUBLE / (max(t) + min(t) - 2) END, 6) + 0.0 AS partition_asymmetry
FROM nodes n JOIN td USING (tree_id, id) WHERE n.pid <> -1 GROUP BY n.tree_id, n.pid HAVING count(*) = 2""")
register("subtree_length", lambda n: T.gather(T.with_parent(n, "x", "y", "z").withColumn("_s", F.coalesce(V.distance(V.vec(), V.vec("p_")), F.lit(0.0))), {"all": (F.col("_s"), "sum")}).join(T.with_parent(n, "x", "y", "z").select("tree_id", "id", F.coalesce(V.distance(V.vec(), V.vec("p_")), F.lit(0.0)).alias("own")), ["tree_id", "id"]).select("tree_id", "id", (F.col("all") - F.col("own")).alias("length")), CTE + _DESC + f"""
SELECT a.tree_id, a.up::BIGINT AS id, {_r('sum(CASE WHEN a.id = a.up THEN 0 ELSE p.step END)', 'length')} FROM anc a JOIN par p ON a.tree_id = p.tree_id AND a.id = p.id GROUP BY ALL""")
register("cut_by_order", lambda n: surgery.cut_by_furcation_order(n, 3), CTE + WALK + f"SELECT {NODE} FROM walk WHERE level < 3")
register("cut_by_type", lambda n: surgery.cut_by_type(n, 2), CTE + _DESC + f"SELECT {NODE} FROM nodes SEMI JOIN (SELECT a.tree_id, a.up AS id FROM anc a JOIN nodes m ON a.tree_id = m.tree_id AND a.id = m.id WHERE m.type = 2) k USING (tree_id, id)")
register("cut_by_box", lambda n: surgery.cut_by_box(n, (0.0, 0.0, 0.0), (80.0, 90.0, 55.0)), CTE + f""",
kept AS (SELECT * FROM nodes WHERE pid = -1 AND x BETWEEN 0 AND 80 AND y BETWEEN 0 AND 90 AND z BETWEEN 0 AND 55
  UNION ALL SELECT n.* FROM kept k JOIN nodes n ON n.tree_id = k.tree_id AND n.pid = k.id WHERE n.x BETWEEN 0 AND 80 AND n.y BETWEEN 0 AND 90 AND n.z BETWEEN 0 AND 55)
SELECT {NODE} FROM kept""")
register("to_subtree", lambda n: surgery.to_subtree(n, n.where("id % 7 = 5").select("tree_id", "id")), CTE + _DESC + f"SELECT {NODE} FROM nodes ANTI JOIN (SELECT DISTINCT tree_id, id FROM anc WHERE up % 7 = 5) g USING (tree_id, id)")
register("get_subtree", lambda n: surgery.get_subtree(n, n.where("id = 2").select("tree_id", "id")), CTE + _DESC + f"SELECT {NODE.replace('pid::BIGINT AS pid', 'CASE WHEN id = 2 THEN -1 ELSE pid END::BIGINT AS pid')} FROM nodes SEMI JOIN (SELECT tree_id, id FROM anc WHERE up = 2) g USING (tree_id, id)")
register("densify", lambda n: surgery.densify(surgery.cut_by_type(n, 2)).select("tree_id", "id", "pid", "old_id"), CTE + _DESC + """,
k AS (SELECT n.*, row_number() OVER (PARTITION BY tree_id ORDER BY id) - 1 AS new FROM nodes n SEMI JOIN (SELECT a.tree_id, a.up AS id FROM anc a JOIN nodes m ON a.tree_id = m.tree_id AND a.id = m.id WHERE m.type = 2) k USING (tree_id, id))
SELECT k.tree_id, k.new::BIGINT AS id, coalesce(p.new, -1)::BIGINT AS pid, k.id::BIGINT AS old_id FROM k LEFT JOIN k p ON p.tree_id = k.tree_id AND p.id = k.pid""")
register("neurites", lambda n: T.neurites(n).select("tree_id", "id", "neurite_id"), CTE + WALK + "SELECT tree_id, id::BIGINT AS id, neurite::BIGINT AS neurite_id FROM walk WHERE pid <> -1")
register("dendrites", lambda n: T.neurites(n, (3, 4)).select("tree_id", "id", "neurite_id"), CTE + WALK + "SELECT w.tree_id, w.id::BIGINT AS id, w.neurite::BIGINT AS neurite_id FROM walk w JOIN nodes h ON h.tree_id = w.tree_id AND h.id = w.neurite WHERE w.pid <> -1 AND h.type IN (3, 4)")
register("redirect_tree", lambda n: surgery.redirect(n, T.tips(n).groupBy("tree_id").agg(F.max("id").alias("id"))).select("tree_id", "id", "type", "pid"), CTE + """,
tgt AS (SELECT tree_id, max(id) AS id FROM nc WHERE n_children = 0 GROUP BY tree_id),
up AS (SELECT n.tree_id, n.id, n.pid, -1 AS new FROM nodes n JOIN tgt USING (tree_id, id) UNION ALL SELECT n.tree_id, n.id, n.pid, u.id FROM up u JOIN nodes n ON n.tree_id = u.tree_id AND n.id = u.pid)
SELECT n.tree_id, n.id::BIGINT AS id, (CASE WHEN n.id = t.id THEN s.type WHEN n.pid = -1 THEN e.type ELSE n.type END)::BIGINT AS type, coalesce(u.new, n.pid)::BIGINT AS pid
FROM nodes n JOIN tgt t ON t.tree_id = n.tree_id JOIN nodes s ON s.tree_id = n.tree_id AND s.pid = -1 JOIN nodes e ON e.tree_id = n.tree_id AND e.id = t.id
LEFT JOIN up u ON u.tree_id = n.tree_id AND u.id = n.id""")
register("cat_tree", lambda n: surgery.cat(n.where("tree_id % 2 = 0"), n.where("tree_id % 2 = 1"), n.where("tree_id % 2 = 0").select("tree_id").distinct().select("tree_id", F.lit(0).alias("node1"), (F.col("tree_id") + 1).alias("tree2_id"), F.lit(0).alias("node2"))), CTE + f""",
a AS (SELECT * FROM nodes WHERE tree_id % 2 = 0), hi AS (SELECT tree_id, max(id) AS hi FROM a GROUP BY tree_id),
b AS (SELECT n.tree_id - 1 AS tree_id, n.id + h.hi + 1 AS id, n.type, n.x + s.x - o.x AS x, n.y + s.y - o.y AS y, n.z + s.z - o.z AS z, n.r, CASE WHEN n.pid = 0 THEN 0 ELSE n.pid + h.hi + 1 END AS pid
      FROM nodes n JOIN hi h ON h.tree_id = n.tree_id - 1 JOIN a s ON s.tree_id = n.tree_id - 1 AND s.id = 0 JOIN nodes o ON o.tree_id = n.tree_id AND o.id = 0 WHERE n.tree_id % 2 = 1 AND n.id <> 0)
SELECT {NODE} FROM (SELECT * FROM a UNION ALL SELECT tree_id, id, type, x, y, z, r, pid FROM b)""")

# Section: branches

register("branches", lambda n: T.branches(n).select("tree_id", "branch_id", "pos", "id"), CTE + BRANCH + f"SELECT tree_id, {_big('branch_id', 'pos', 'id')} FROM bn")
register("paths", lambda n: T.paths(n), CTE + WALK + _DESC + "SELECT a.tree_id, a.id::BIGINT AS path_id, w.depth AS pos, a.up::BIGINT AS id FROM anc a JOIN nc n ON n.tree_id = a.tree_id AND n.id = a.id AND n.n_children = 0 JOIN walk w ON w.tree_id = a.tree_id AND w.id = a.up")
register("branch_features", features.branch_features, CTE + BRANCH + f"SELECT tree_id, branch_id::BIGINT AS branch_id, {_r('length', 'length')}, {_r('straight', 'straight')}, n_nodes::BIGINT AS n_nodes, {_r('CASE WHEN length = 0 THEN 1 ELSE straight / length END', 'tortuosity')} FROM bl")
register("branch_metrics", lambda n: lmeasure.branch_metrics(n).select("tree_id", "branch_id", "pathlength", "contraction", "fragmentation", "taper_1", "taper_2", "terminal", "last_parent_diam"), CTE + BRANCH + f"""
SELECT b.tree_id, branch_id::BIGINT AS branch_id, {_r('length', 'pathlength')}, {_r('straight / nullif(length, 0)', 'contraction')}, (n_nodes - 1)::BIGINT AS fragmentation,
       {_r('(2 * r0 - 2 * r1) / nullif(length, 0)', 'taper_1')}, {_r('(2 * r0 - 2 * r1) / (2 * r0)', 'taper_2')}, n.n_children = 0 AS terminal, CASE WHEN n.n_children = 0 THEN round(2 * r0, 6) + 0.0 END AS last_parent_diam
FROM bl b JOIN nc n ON n.tree_id = b.tree_id AND n.id = b.fin""")
register("branch_tree", T.contracted, CTE + BRANCH + f"SELECT tree_id, branch_id::BIGINT AS branch_id, fin::BIGINT AS id, start::BIGINT AS pid, (n_nodes - 1)::BIGINT AS n_edges, {_r('length', 'length')} FROM bl")
register("branch_angle", features.branch_angles, CTE + BRANCH + """,
bv AS (SELECT tree_id, branch_id, x1 - x0 AS x, y1 - y0 AS y, z1 - z0 AS z FROM bl)
SELECT a.tree_id, a.branch_id::BIGINT AS branch_a, b.branch_id::BIGINT AS branch_b,
  round(acos(greatest(-1.0, least(1.0, (a.x*b.x + a.y*b.y + a.z*b.z) / (sqrt(a.x*a.x + a.y*a.y + a.z*a.z) * sqrt(b.x*b.x + b.y*b.y + b.z*b.z) + 1e-7)))), 4) + 0.0 AS angle
FROM bv a JOIN bv b USING (tree_id)""", 4)
_REMOTE = _PAIR + BRANCH.replace("WITH", "") + """,
rm AS (SELECT f.tree_id, f.id, f.pid, f.wx, f.wy, f.wz, l.x1 - f.x AS ux, l.y1 - f.y AS uy, l.z1 - f.z AS uz, m.x1 - f.x AS vx, m.y1 - f.y AS vy, m.z1 - f.z AS vz
       FROM bf f JOIN bl l ON l.tree_id = f.tree_id AND l.branch_id = f.a.i JOIN bl m ON m.tree_id = f.tree_id AND m.branch_id = f.b.i)"""
register("bif_remote", lmeasure.bifurcation_remote, CTE + _REMOTE + f"""
SELECT tree_id, id::BIGINT AS id, {_r(_angle('u', 'v'), 'ampl_remote', 4)}, CASE WHEN pid <> -1 THEN round(least({_angle('w', 'u')}, {_angle('w', 'v')}), 4) + 0.0 END AS tilt_remote FROM rm""", 4)
for kind, source in (("local", "bf"), ("remote", "rm")):
    register(f"torque_{kind}", lambda n, k=kind: lmeasure.torque(n, k == "remote"), CTE + _REMOTE + f""",
pl AS (SELECT tree_id, id, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM {source}),
tq AS (SELECT c.tree_id, c.id, c.nx AS mx, c.ny AS my, c.nz AS mz, p.nx AS kx, p.ny AS ky, p.nz AS kz
       FROM pl c JOIN bl ON bl.tree_id = c.tree_id AND bl.fin = c.id JOIN pl p ON p.tree_id = c.tree_id AND p.id = bl.start)
SELECT tree_id, id::BIGINT AS id, round({_angle('m', 'k')}, 3) + 0.0 AS torque FROM tq""", 3)
register("cut_short_tips", lambda n: surgery.cut_short_tips(n, 40.0), CTE + BRANCH + f""",
st AS (SELECT b.tree_id, b.branch_id FROM bl b JOIN nc e ON e.tree_id = b.tree_id AND e.id = b.fin AND e.n_children = 0 JOIN nc s ON s.tree_id = b.tree_id AND s.id = b.start AND s.n_children > 1 WHERE length <= 40)
SELECT {NODE} FROM nodes ANTI JOIN (SELECT tree_id, id FROM bn JOIN st USING (tree_id, branch_id) WHERE pos > 0) g USING (tree_id, id)""")
register("smooth_tree", branching.smooth_tree, CTE + BRANCH + f""",
sm AS (SELECT tree_id, id, pos, {', '.join(f'CASE WHEN pos = 0 OR lead(pos) OVER w IS NULL THEN {c} ELSE avg({c}) OVER (PARTITION BY tree_id, branch_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS s{c}' for c in 'xyz')} FROM bp WINDOW w AS (PARTITION BY tree_id, branch_id ORDER BY pos))
SELECT n.tree_id, n.id::BIGINT AS id, n.type::BIGINT AS type, n.pid::BIGINT AS pid, {', '.join(_r(f'coalesce(s.s{c}, n.{c})', c) for c in 'xyz')}, {_r('n.r', 'r')} FROM nodes n LEFT JOIN sm s ON s.tree_id = n.tree_id AND s.id = n.id AND s.pos > 0""")
_SAMPLED = BRANCH + """,
ms AS (SELECT *, sum(d) OVER (PARTITION BY tree_id, branch_id ORDER BY pos) AS s FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS d FROM bp WINDOW w AS (PARTITION BY tree_id, branch_id ORDER BY pos))),
pc AS (SELECT *, lead(s) OVER w AS t, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, lead(r) OVER w AS nr FROM ms WINDOW w AS (PARTITION BY tree_id, branch_id ORDER BY pos)),
sp AS (SELECT bl.tree_id, bl.branch_id, k, {at} AS place FROM bl, range(0, 1000000) g(k) WHERE length > 0 AND k < {count})"""
_AT = "SELECT sp.tree_id, sp.branch_id::BIGINT AS branch_id, k AS pos, " + ", ".join(f"round(max_by({c} + CASE WHEN t > s THEN (least(place, t) - s) / (t - s) ELSE 0 END * (n{c} - {c}), s), 6) + 0.0 AS {c}" for c in "xyzr") + " FROM sp JOIN pc ON pc.tree_id = sp.tree_id AND pc.branch_id = sp.branch_id AND pc.t > pc.s AND pc.s <= place + 1e-9 GROUP BY sp.tree_id, sp.branch_id, k"
register("resample_linear", lambda n: branching.resample_linear(T.branches(n), 9), CTE + _SAMPLED.format(at="k * length / 8", count="9").replace("range(0, 1000000)", "range(0, 9)") + _AT)
register("resample_isometric", lambda n: branching.resample_isometric(T.branches(n), 20.0), CTE + _SAMPLED.format(at="k * length / ceil(length / 20 - 1e-12)", count="ceil(length / 20 - 1e-12) + 1").replace("range(0, 1000000)", "(SELECT unnest(range(0, (SELECT max(ceil(length / 20 - 1e-12))::BIGINT + 1 FROM bl))))") + _AT)

# Section: populations and features

register("population_union", lambda n: population.union(*(n.where(F.col("tree_id") % 3 == k) for k in range(3))).groupBy("population").agg(F.countDistinct("tree_id").alias("n_trees"), F.count("*").alias("n_nodes")), CTE + "SELECT tree_id % 3 AS population, count(DISTINCT tree_id)::BIGINT AS n_trees, count(*)::BIGINT AS n_nodes FROM nodes GROUP BY ALL")
register("population_intersect", lambda n: population.intersect(n.where("tree_id % 2 = 0"), n.where("tree_id % 3 = 0")).groupBy("population").agg(F.countDistinct("tree_id").alias("n_trees")), CTE + "SELECT p.population, count(DISTINCT tree_id)::BIGINT AS n_trees FROM nodes, (VALUES (0::BIGINT), (1::BIGINT)) p(population) WHERE tree_id % 6 = 0 GROUP BY ALL")
register("population_filter", lambda n: population.where(n, features.tree_summary(n).where("n_tips > 20")).groupBy("tree_id").agg(F.count("*").alias("n_nodes")), CTE + "SELECT tree_id, count(*)::BIGINT AS n_nodes FROM nc GROUP BY tree_id HAVING sum((n_children = 0)::INT) > 20")
register("population_nth", lambda n: population.nth(n, 3).groupBy("tree_id").agg(F.count("*").alias("n_nodes")), CTE + "SELECT tree_id, count(*)::BIGINT AS n_nodes FROM nodes WHERE tree_id = (SELECT DISTINCT tree_id FROM nodes ORDER BY tree_id LIMIT 1 OFFSET 3) GROUP BY tree_id")
register("feature_padding", lambda n: features.padded(features.extract(n, "tip_radial_distance")).select("tree_id", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total")), CTE + f"SELECT tree_id, (SELECT max(c) FROM (SELECT count(*) AS c FROM rad WHERE n_children = 0 GROUP BY tree_id))::BIGINT AS n, {_r('sum(rd)', 'total')} FROM rad WHERE n_children = 0 GROUP BY tree_id")
register("feature_histogram", lambda n: features.histogram(features.extract(n, "node_radial_distance")), CTE + """,
v AS (SELECT rd FROM rad WHERE rd <> 0), m AS (SELECT min(rd) AS a, (max(rd) - min(rd)) / 20 AS w FROM v)
SELECT 'node_radial_distance' AS feature, b AS bin, round(a + b * w, 6) + 0.0 AS low, round(a + b * w + w, 6) + 0.0 AS high, count(rd)::BIGINT AS n
FROM m CROSS JOIN range(0, 20) g(b) LEFT JOIN v ON least(floor((rd - a) / w), 19) = b GROUP BY a, w, b""")

# Section: images: every embedding is a stack of one row of voxels


def register_voxels(name: str, plan: Callable[[DataFrame], DataFrame], sql: str, digits: int = 6) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        v = e.select(F.col("vec_id").cast("string").alias("path"), F.posexplode("embedding").alias("i", "v"))
        zero = F.lit(0)
        return rounded(plan(v.select("path", "i", zero.alias("j"), zero.alias("k"), zero.alias("c"), F.col("v").cast("double").alias("v"))), digits)

    QUERIES[name] = run
    ORACLE_SQL[name] = _VOXELS + sql


_VOXELS = "WITH vx AS (SELECT vec_id::VARCHAR AS path, generate_subscripts(embedding, 1)::BIGINT - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_VROW = "path, i, 0::BIGINT AS j, 0::BIGINT AS k, 0::BIGINT AS c"
register_voxels("image_contrast", lambda v: images.contrasts(v, F.col("i") < 16), f"""
SELECT path, {_r('stddev_pop(v)', 'std', 4)}, {_r('(max(v) - min(v)) / nullif(max(v) + min(v), 0)', 'michelson', 4)}, {_r('sqrt(avg(v * v))', 'rms', 4)},
       {_r('(avg(v) FILTER (i < 16) - avg(v) FILTER (i >= 16)) / nullif(avg(v) FILTER (i >= 16), 0)', 'weber', 4)} FROM vx GROUP BY path""", 4)
register_voxels("image_folder_stat", images.folder_statistics, f"SELECT (SELECT count(DISTINCT path) FROM vx)::BIGINT AS count, {_r('min(v)', 'minimum')}, {_r('max(v)', 'maximum')}, {_r('avg(v)', 'mean')}, (SELECT round(avg(q), 6) + 0.0 FROM (SELECT var_samp(v) AS q FROM vx GROUP BY i)) AS variance FROM vx")
register_voxels("image_scale", lambda v: images.scale(v, 3.0), f" SELECT {_VROW}, {_r('v * 3', 'v')} FROM vx")
register_voxels("image_clip", images.clip, f" SELECT {_VROW}, {_r('greatest(0, least(1, v))', 'v')} FROM vx")
register_voxels("image_normalise", images.normalise, f" SELECT {_VROW}, {_r('(v - avg(v) OVER w) / nullif(var_pop(v) OVER w, 0)', 'v', 4)} FROM vx WINDOW w AS (PARTITION BY path)", 4)
register_voxels("image_adjust", lambda v: images.adjust(v, 0.1, 0.5), f" SELECT {_VROW}, {_r('(v - 0.1) / 0.5', 'v')} FROM vx")
register_voxels("image_unit_range", lambda v: images.to_unit_range(v, -0.25, 0.25), f" SELECT {_VROW}, {_r('greatest(0, least(1, (v + 0.25) / 0.5))', 'v')} FROM vx")
register_voxels("image_flip", lambda v: images.flip(v, "i"), f" SELECT path, 63 - i AS i, 0::BIGINT AS j, 0::BIGINT AS k, 0::BIGINT AS c, {_r('v', 'v')} FROM vx")
register_voxels("image_crop", lambda v: images.center_crop(v, (20, 1, 1)), f" SELECT path, i - 22 AS i, 0::BIGINT AS j, 0::BIGINT AS k, 0::BIGINT AS c, {_r('v', 'v')} FROM vx WHERE i >= 22 AND i < 42")
register_voxels("image_equalise", lambda v: images.equalise(v, 32), """,
mm AS (SELECT *, min(v) OVER w AS a, (max(v) OVER w - min(v) OVER w) / 32 AS wd, count(*) OVER w AS n FROM vx WINDOW w AS (PARTITION BY path)),
bn AS (SELECT *, coalesce((v - a) / nullif(wd, 0), 0) AS pos, least(floor(coalesce((v - a) / nullif(wd, 0), 0)), 31) AS b FROM mm),
hs AS (SELECT path, b, count(*) AS c FROM bn GROUP BY ALL),
cd AS (SELECT p.path, g.b, sum(coalesce(h.c, 0)) OVER (PARTITION BY p.path ORDER BY g.b) AS f FROM (SELECT DISTINCT path FROM vx) p CROSS JOIN range(0, 32) g(b) LEFT JOIN hs h ON h.path = p.path AND h.b = g.b),
cn AS (SELECT *, coalesce(lead(f) OVER (PARTITION BY path ORDER BY b), f) AS g FROM cd)
SELECT bn.path, bn.i, 0::BIGINT AS j, 0::BIGINT AS k, 0::BIGINT AS c, round(f / n + CASE WHEN bn.b < 31 THEN least(pos - bn.b, 1) * (g / n - f / n) ELSE 0 END, 5) + 0.0 AS v FROM bn JOIN cn ON cn.path = bn.path AND cn.b = bn.b""", 5)

# Section: whole-tree operators and formats

register("swc_roundtrip", lambda n: swc.parse(swc.to_lines(n).select(F.col("tree_id").cast("string").alias("tree_id"), F.col("id").alias("pos"), F.col("line").alias("value"))).select("tree_id", "id", "type", "x", "y", "z", "r", "pid"), CTE + f"""
SELECT tree_id::VARCHAR AS tree_id, (id + 1)::BIGINT AS id, type::BIGINT AS type, (CASE WHEN pid = -1 THEN -1 ELSE pid + 1 END)::BIGINT AS pid, {', '.join(_r(c, c, 4) for c in 'xyzr')} FROM nodes""", 4)
register("dfs_sort", construct.sort_nodes, CTE + f""",
way AS (SELECT *, [0] AS path FROM nodes WHERE pid = -1 UNION ALL SELECT n.*, list_append(w.path, -n.id) FROM way w JOIN nodes n ON n.tree_id = w.tree_id AND n.pid = w.id),
num AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS new FROM way)
SELECT a.tree_id, a.new::BIGINT AS id, a.type::BIGINT AS type, coalesce(p.new, -1)::BIGINT AS pid, {', '.join(_r(f'a.{c}', c) for c in 'xyzr')}
FROM num a LEFT JOIN num p ON p.tree_id = a.tree_id AND p.id = a.pid""")
register("link_nearest", lambda n: construct.link_nearest(n.withColumn("pid", F.when(F.col("id") % 20 == 0, -1).otherwise(F.col("pid")))))
register("traverse", lambda n: construct.traverse(n, "double", leave=lambda r, kids: float(max(1, sum(kids)))), CTE + _DESC + """
SELECT a.tree_id, a.up::BIGINT AS id, sum((n.n_children = 0)::INT)::DOUBLE AS value FROM anc a JOIN nc n ON a.tree_id = n.tree_id AND a.id = n.id GROUP BY ALL""")
_CLOUD = lambda n: n.select(F.col("tree_id").alias("cloud_id"), F.col("id").alias("pos"), "x", "y", "z")
register("mst", lambda n: construct.minimum_spanning_tree(_CLOUD(n)))
register("cuntz_mst", lambda n: construct.points_to_tree(_CLOUD(n)))
register("lines_to_tree", lambda n: construct.lines_to_tree(T.branches(n).select("tree_id", F.col("branch_id").alias("line_id"), "pos", "type", "x", "y", "z", "r")))
register("standardise", lambda n: branching.standardise(T.branches(n)))
register("mvee", construct.ellipses, digits=4)
register("volume_middle", lambda n: volume.tree_volume(n, samples=1_000_000), digits=3)
register("voxelise", lambda n: images.voxelise(n))
register("resample_tree", lambda n: branching.resample_tree(n, distance=20.0).groupBy("tree_id").agg(F.count("*").alias("n_nodes"), F.sum((F.col("pid") == -1).cast("long")).alias("n_roots")), CTE + BRANCH + """
SELECT tree_id, (1 + sum(CASE WHEN length = 0 THEN 0 ELSE ceil(length / 20 - 1e-12) END))::BIGINT AS n_nodes, 1::BIGINT AS n_roots FROM bl GROUP BY tree_id""")
register("floret_share", lambda n: construct.length_share(n, construct.florets(n, n.where("id = 2").select("tree_id", "id"))[1]), CTE + _DESC + f"""
SELECT p.tree_id, 2::BIGINT AS start, {_r('sum(CASE WHEN p.id > 2 AND a.up = 2 THEN p.step END) / (SELECT sum(q.step) FROM par q WHERE q.tree_id = p.tree_id)', 'share')}
FROM par p JOIN anc a ON a.tree_id = p.tree_id AND a.id = p.id AND a.up = 2 AND p.id <> 2 GROUP BY p.tree_id""")

# Section: graphs and views

register("graph_edges", lambda n: graphs.to_graph(n, bidirected=True)[0], CTE + "SELECT tree_id, pid::BIGINT AS src, id::BIGINT AS dst FROM nodes WHERE pid <> -1 UNION ALL SELECT tree_id, id, pid FROM nodes WHERE pid <> -1")
register("matrix_product", lambda n: graphs.product(graphs.edge_distances(n), T.adjacency(n)), CTE + f"SELECT a.tree_id, a.pid::BIGINT AS i, b.id::BIGINT AS j, {_r('sum(a.step)', 'v')} FROM par a JOIN par b ON a.tree_id = b.tree_id AND b.pid = a.id WHERE a.pid <> -1 GROUP BY ALL")
# SQL compares the rounded distance
register("pair_distances", lambda n: rounded(graphs.pair_distances(n, 12.000001)).where("distance <= 12"), CTE + """
SELECT * FROM (SELECT a.tree_id, a.id::BIGINT AS a, b.id::BIGINT AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) + 0.0 AS distance
FROM nodes a JOIN nodes b ON a.tree_id = b.tree_id AND a.id < b.id) WHERE distance <= 12""")
register("view_segments", views.segments, CTE + f"""
SELECT tree_id, id::BIGINT AS id, {_r('px', 'x0')}, {_r('py', 'y0')}, {_r('x', 'x1')}, {_r('y', 'y1')}, ([{', '.join(repr(c) for c in views.PALETTE)}])[ptype % 8 + 1] AS colour FROM par WHERE pid <> -1""")
register("bounding_boxes", views.boxes, CTE + "SELECT tree_id, " + ", ".join(_r(f"{f}({c})", f"{f}_{c}") for f in ("min", "max") for c in "xyz") + " FROM nodes GROUP BY tree_id")

from . import forms  # noqa: E402, F401  (registers more queries)
