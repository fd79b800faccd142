"""Further registered queries: closed forms, cuts and renumberings, collections, files and stacks of voxels.

They follow the pattern of ``catalog``, which imports this module at its end.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime, schema
from ..functions import solids as S
from ..functions import vector as V
from ..operators import branching, construct, features, geometry, images, lmeasure, population, surgery, views
from ..operators import topology as T
from ..sources import archive, asc, swc
from ..sources import images as files
from .catalog import _CONE, _DESC, _LENS, NODE, ORACLE_SQL, QUERIES, _big, _r, register, rounded
from .forest import BRANCH, CTE, forest

# Section: closed forms on every edge

_ENDS = lambda n: T.edges(n).where("NOT (p_x = 0 AND p_y = 0 AND p_z = 0)")
_EDGES = " FROM par WHERE pid <> -1 AND NOT (px = 0 AND py = 0 AND pz = 0)"
_KEY = "SELECT tree_id, id::BIGINT AS id, "


def _xyz(vector: V.Vec, name: str) -> list:
    return [c.alias(f"{name}_{k}") for c, k in zip(vector, "xyz")]


register("solid_areas", lambda n: T.edges(n).select(
    "tree_id", "id", S.circle_area(F.col("c_r")).alias("circle"), S.sphere_area(F.col("c_r")).alias("sphere"), S.cylinder_volume(F.col("c_r"), F.col("length")).alias("cylinder"),
    S.cylinder_side_area(F.col("c_r"), F.col("length")).alias("side"), S.pill_area(F.col("p_r"), F.col("c_r"), F.col("length")).alias("pill"),
), CTE + _KEY + f"""{_r('pi() * r * r', 'circle')}, {_r('4 * pi() * r * r', 'sphere')}, {_r('pi() * r * r * step', 'cylinder')}, {_r('2 * pi() * r * step', 'side')},
{_r('2 * pi() * pr * pr + 2 * pi() * r * r + pi() * (pr + r) * sqrt((pr - r) ** 2 + step ** 2)', 'pill')} FROM par WHERE pid <> -1""")  # fmt: skip
register("solid_unions", lambda n: T.edges(n).select(
    "tree_id", "id", S.two_spheres_union(F.col("c_r"), F.col("p_r"), F.col("length")).alias("spheres"), S.sphere_frustum_union(F.col("p_r"), F.col("c_r"), F.col("length")).alias("cone"),
), CTE + _KEY + f"""{_r(f'4.0 / 3 * pi() * (r ** 3 + pr ** 3) - ({_LENS})', 'spheres', 4)},
{_r(f"4.0 / 3 * pi() * pr ** 3 + pi() * step * (r * r + r * pr + pr * pr) / 3 - {_CONE('pr', 'r')}", 'cone', 4)} FROM par WHERE pid <> -1""", 4)  # fmt: skip


def _composed(n: DataFrame) -> DataFrame:
    e = T.edges(n)
    mid = V.scaled(V.add(V.vec("c_"), V.vec("p_")), 0.5)
    # both ends seen from the middle, so their distances are half the edge's length to the last bit
    half, here = V.scaled(V.sub(V.vec("c_"), V.vec("p_")), 0.5), V.const((0, 0, 0))
    a, b = S.sdf_sphere(here, half, F.col("c_r") * 9), S.sdf_sphere(here, V.scaled(half, -1.0), F.col("p_r") * 9)
    box = S.in_box(mid, V.const((0, 10, 5)), V.const((50, 60, 40)))
    one = S.sdf_union(a, b)
    return e.select("tree_id", "id", one.alias("either"), S.sdf_intersection(a, b).alias("both"), S.sdf_difference(a, b).alias("first"), S.inside(one).alias("inside"), box.alias("boxed"), S.inside(one, box).alias("inside_boxed"))


_IN_BOX = "((x + px) / 2 BETWEEN 0 AND 50 AND (y + py) / 2 BETWEEN 10 AND 60 AND (z + pz) / 2 BETWEEN 5 AND 40)"
register("sdf_composed", _composed, CTE + f"""
SELECT tree_id, id::BIGINT AS id, {_r('least(step / 2 - 9 * r, step / 2 - 9 * pr)', 'either')}, {_r('greatest(step / 2 - 9 * r, step / 2 - 9 * pr)', 'both')}, {_r('greatest(step / 2 - 9 * r, 9 * pr - step / 2)', 'first')},
       least(step / 2 - 9 * r, step / 2 - 9 * pr) <= 0 AS inside, {_IN_BOX} AS boxed, {_IN_BOX} AND least(step / 2 - 9 * r, step / 2 - 9 * pr) <= 0 AS inside_boxed FROM par WHERE pid <> -1""")

_ON = "((x * px + y * py + z * pz) / (px * px + py * py + pz * pz))"
register("vector_projections", lambda n: _ENDS(n).select(
    "tree_id", "id", *_xyz(V.project_on_vector(V.vec("c_"), V.vec("p_")), "on"), *_xyz(V.project_on_plane(V.vec("c_"), V.vec("p_")), "off"),
    *_xyz(V.project_point_on_line(V.vec("p_"), V.const((1, 2, 3)), V.vec("c_")), "at"),
), CTE + _KEY + ", ".join(_r(f"p{k} * {_ON}", f"on_{k}") for k in "xyz") + ", " + ", ".join(_r(f"{k} - p{k} * {_ON}", f"off_{k}") for k in "xyz") + ", "
    + ", ".join(_r(f"p{k} + {i} * ((x - px) + 2 * (y - py) + 3 * (z - pz)) / 14", f"at_{k}") for i, k in enumerate("xyz", 1)) + _EDGES)
register("plane_unit_vector", lambda n: n.select("tree_id", "id", *_xyz(V.unit_vector_on_plane(V.vec()), "u")), CTE + f"""
SELECT tree_id, id::BIGINT AS id, {_r('CASE WHEN abs(x) <= abs(y) THEN 0 ELSE coalesce(-z / nullif(sqrt(x * x + z * z), 0), 0) END', 'u_x')},
       {_r('CASE WHEN abs(x) <= abs(y) THEN coalesce(z / nullif(sqrt(y * y + z * z), 0), 0) ELSE 0 END', 'u_y')},
       {_r('CASE WHEN abs(x) <= abs(y) THEN coalesce(-y / nullif(sqrt(y * y + z * z), 0), 0) ELSE coalesce(x / nullif(sqrt(x * x + z * z), 0), 0) END', 'u_z')} FROM nodes""")
register("sphere_line", lambda n: _ENDS(n).select("tree_id", "id", F.posexplode(V.sphere_line(V.vec("c_"), F.col("c_r") * 10, V.const((0, 0, 0)), V.vec("p_"))).alias("pos", "p")).select("tree_id", "id", "pos", "p.t", "p.x", "p.y", "p.z"), CTE + f""",
q AS (SELECT *, px * px + py * py + pz * pz AS a, -2 * (px * x + py * y + pz * z) AS b, x * x + y * y + z * z - 100 * r * r AS c {_EDGES}),
s AS (SELECT tree_id, id, px, py, pz, pos, CASE pos WHEN 0 THEN -b - sqrt(b * b - 4 * a * c) ELSE -b + sqrt(b * b - 4 * a * c) END / (2 * a) AS t
      FROM q, (VALUES (0::BIGINT), (1::BIGINT)) g(pos) WHERE b * b - 4 * a * c > 0 OR (b * b - 4 * a * c = 0 AND pos = 0))
SELECT tree_id, id::BIGINT AS id, pos, {_r('t', 't', 4)}, {', '.join(_r(f't * p{k}', k, 4) for k in 'xyz')} FROM s""", 4)
_VIEW = ((3.0, 4.0, 5.0), (0.0, 0.0, -2.0), (0.0, 1.0, 0.0))


def _seen(n: DataFrame) -> DataFrame:
    p = V.apply(V.matmul(V.orthographic(), V.model_view(*_VIEW)), V.vec())
    h = V.homogeneous(V.vec(), 1.0)
    return n.select("tree_id", "id", *_xyz(p, "v"), *(F.get(h, i).alias(f"h{i}") for i in range(4)), "r")


register("camera_view", _seen, CTE + f"SELECT tree_id, id::BIGINT AS id, {_r('x - 3', 'v_x')}, {_r('y - 4', 'v_y')}, 0.0::DOUBLE AS v_z, {_r('x', 'h0')}, {_r('y', 'h1')}, {_r('z', 'h2')}, 1.0::DOUBLE AS h3, {_r('r', 'r')} FROM nodes")
register("children", lambda n: T.children(n).select("tree_id", "id", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"), *(F.get(V.padded(F.col("children").cast("array<double>"), 3, -1.0), i).alias(f"k{i}") for i in range(3))), CTE + """
SELECT tree_id, pid::BIGINT AS id, string_agg(id::VARCHAR, ',' ORDER BY id) AS children, """ + ", ".join(f"coalesce(list(id ORDER BY id)[{i + 1}]::DOUBLE, -1) AS k{i}" for i in range(3)) + " FROM nodes WHERE pid <> -1 GROUP BY ALL")
register("node_table", lambda n: schema.node_table(n.select("tree_id", F.col("id").alias("number"), "x", "y", F.col("z").cast("string").alias("z"), "pid"), {"id": "number"}), CTE + f"SELECT tree_id, {_big('id', 'pid')}, 0::BIGINT AS type, {', '.join(_r(c, c) for c in 'xyz')}, 1.0::DOUBLE AS r FROM nodes")

# Section: cuts, renumberings and branches

register("reset_index", lambda n: surgery.reset_index(n.withColumn("pid", F.when(F.col("pid") == -1, -1).otherwise(F.col("pid") + 7)).withColumn("id", F.col("id") + 7)), CTE + f"SELECT {NODE} FROM nodes")
register("mark_roots", lambda n: surgery.mark_roots_as_somas(n.withColumn("pid", F.when(F.col("id") % 20 == 0, -1).otherwise(F.col("pid")))), CTE + "SELECT tree_id, id::BIGINT AS id, (CASE WHEN id % 20 = 0 THEN 1 ELSE type END)::BIGINT AS type, (CASE WHEN id = 0 THEN -1 WHEN id % 20 = 0 THEN 0 ELSE pid END)::BIGINT AS pid, " + ", ".join(_r(c, c) for c in "xyzr") + " FROM nodes")
for _name, _cut, _kind in (("cut_axon", surgery.cut_axon, 2), ("cut_dendrite", surgery.cut_dendrite, 3)):
    register(_name, _cut, CTE + _DESC + f"SELECT {NODE} FROM nodes SEMI JOIN (SELECT a.tree_id, a.up AS id FROM anc a JOIN nodes m ON a.tree_id = m.tree_id AND a.id = m.id WHERE m.type = {_kind}) k USING (tree_id, id)")
register("branch_points", lambda n: branching.from_points(branching.as_arrays(T.branches(n))), CTE + BRANCH + f"SELECT tree_id, {_big('branch_id', 'pos')}, pos::BIGINT AS id, 3::BIGINT AS type, {', '.join(_r(c, c) for c in 'xyzr')} FROM bp")
register("branch_reverse", lambda n: branching.reverse(T.branches(n)), CTE + BRANCH + f""",
lp AS (SELECT tree_id, branch_id, max(pos) AS last, min_by(type, pos) AS t0, max_by(type, pos) AS t1 FROM bp GROUP BY ALL)
SELECT tree_id, branch_id::BIGINT AS branch_id, (last - pos)::BIGINT AS pos, id::BIGINT AS id, (CASE last - pos WHEN 0 THEN t0 WHEN last THEN t1 ELSE type END)::BIGINT AS type, {', '.join(_r(c, c) for c in 'xyzr')} FROM bp JOIN lp USING (tree_id, branch_id)""")
register("branch_to_tree", lambda n: branching.to_tree(T.branches(n)), CTE + BRANCH + f"SELECT tree_id::VARCHAR || '#' || branch_id::VARCHAR AS tree_id, pos::BIGINT AS id, type::BIGINT AS type, (pos - 1)::BIGINT AS pid, {', '.join(_r(c, c) for c in 'xyzr')} FROM bp")
register("diam_threshold", lmeasure.diameter_threshold, CTE + BRANCH + f"SELECT b.tree_id, branch_id::BIGINT AS id, {_r('2 * r0', 'diam_threshold')} FROM bl b JOIN nc n ON n.tree_id = b.tree_id AND n.id = b.fin WHERE n.n_children = 0")
register("branch_thresholds", lambda n: lmeasure.branch_metrics(n).select("tree_id", "branch_id", "hillman_threshold", "fractal_dim"), CTE + BRANCH + """,
two AS (SELECT tree_id, pid AS id, sum(r) AS rs FROM nodes WHERE pid <> -1 GROUP BY ALL HAVING count(*) = 2),
st AS (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, first_value(z) OVER w AS fz, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS d
       FROM bp WINDOW w AS (PARTITION BY tree_id, branch_id ORDER BY pos)),
cu AS (SELECT *, sum(d) OVER (PARTITION BY tree_id, branch_id ORDER BY pos) AS p, sqrt((x - fx) ** 2 + (y - fy) ** 2 + (z - fz) ** 2) AS e FROM st),
lg AS (SELECT tree_id, branch_id, ln(p) AS lp, ln(e) AS le FROM cu WHERE p > 0 AND e > 0),
fd AS (SELECT tree_id, branch_id, sum((le - me) * (lp - mp)) / nullif(sum((le - me) ** 2), 0) AS slope FROM lg JOIN (SELECT tree_id, branch_id, avg(le) AS me, avg(lp) AS mp FROM lg GROUP BY ALL HAVING count(*) >= 2) USING (tree_id, branch_id) GROUP BY ALL)
SELECT bl.tree_id, bl.branch_id::BIGINT AS branch_id, round((2 * r1 + 2 * rs) / 3 / 2, 4) + 0.0 AS hillman_threshold, round(slope, 4) + 0.0 AS fractal_dim
FROM bl LEFT JOIN two ON two.tree_id = bl.tree_id AND two.id = bl.fin LEFT JOIN fd ON fd.tree_id = bl.tree_id AND fd.branch_id = bl.branch_id""", 4)
#: Roots at every 25th node; the first node of every seventh tree hangs on the last, which closes a cycle or makes one part less.
_KNOT = lambda n: n.join(n.groupBy("tree_id").agg(F.max("id").alias("_m")), "tree_id").withColumn("pid", F.when((F.col("id") == 0) & (F.col("tree_id") % 7 == 0), F.col("_m")).when(F.col("id") % 25 == 0, -1).otherwise(F.col("pid"))).drop("_m")
_KNOTS = """,
kn AS (SELECT tree_id, id, CASE WHEN id = 0 AND tree_id % 7 = 0 THEN max(id) OVER (PARTITION BY tree_id) WHEN id % 25 = 0 THEN -1 ELSE pid END AS pid FROM nodes),
rc AS (SELECT tree_id, id, id AS root FROM kn WHERE pid = -1 UNION ALL SELECT k.tree_id, k.id, r.root FROM rc r JOIN kn k ON k.tree_id = r.tree_id AND k.pid = r.id)"""
register("checks_knots", lambda n: T.checks(_KNOT(n)), CTE + _KNOTS + """,
kc AS (SELECT k.*, coalesce(c.n, 0) AS n, r.root FROM kn k LEFT JOIN (SELECT tree_id, pid AS id, count(*) AS n FROM kn WHERE pid <> -1 GROUP BY ALL) c USING (tree_id, id) LEFT JOIN rc r USING (tree_id, id))
SELECT tree_id, sum((pid = -1)::INT)::BIGINT AS n_components, bool_and(n <= 2 OR pid = -1) AS bifurcate, bool_and(n <= 2) AS bifurcate_with_root, bool_and(pid = -1 OR id > pid) AS sorted,
       bool_or(root IS NULL) AS cyclic, sum((pid = -1)::INT) = 1 AND NOT bool_or(root IS NULL) AS single_root FROM kc GROUP BY tree_id""")
register("components_many", lambda n: T.components(_KNOT(n).where("tree_id % 7 <> 0")).select("tree_id", "id", "root", "component_id"), CTE + _KNOTS + """
SELECT tree_id, id::BIGINT AS id, root::BIGINT AS root, (dense_rank() OVER (PARTITION BY tree_id ORDER BY root) - 1)::BIGINT AS component_id FROM rc WHERE tree_id % 7 <> 0""")

# Section: features, collections and views

register("feature_counts", lambda n: features.extract(n, "tip_count", "furcation_count", "node_count", "path_count", "branch_count").select("tree_id", "feature", "pos", "value"), CTE + """
SELECT tree_id, feature, 0::BIGINT AS pos, value::DOUBLE AS value FROM (
  SELECT tree_id, sum((n_children = 0)::INT) AS tip_count, sum((n_children > 1)::INT) AS furcation_count, count(*) AS node_count, sum((n_children = 0)::INT) AS path_count,
         sum((CASE WHEN pid = -1 THEN n_children <> 1 ELSE ppid = -1 OR p_children > 1 END)::INT) AS branch_count FROM par GROUP BY tree_id)
UNPIVOT (value FOR feature IN (tip_count, furcation_count, node_count, path_count, branch_count))""")
register("feature_rows", lambda n: features.extract(n, "branch_length", "branch_tortuosity", "path_length", "path_tortuosity", "length").select("tree_id", "feature", "pos", "value"), CTE + BRANCH + """,
wk AS (SELECT tree_id, id, 0::DOUBLE AS plen FROM par WHERE pid = -1 UNION ALL SELECT p.tree_id, p.id, w.plen + p.step FROM wk w JOIN par p ON p.tree_id = w.tree_id AND p.pid = w.id),
pt AS (SELECT r.tree_id, r.id, plen, CASE WHEN plen = 0 THEN 1 ELSE rd / plen END AS tort FROM wk JOIN rad r USING (tree_id, id) WHERE r.n_children = 0)
SELECT tree_id, feature, pos::BIGINT AS pos, round(value, 6) + 0.0 AS value FROM (
  SELECT tree_id, 'branch_length' AS feature, branch_id AS pos, length AS value FROM bl UNION ALL
  SELECT tree_id, 'branch_tortuosity', branch_id, CASE WHEN length = 0 THEN 1 ELSE straight / length END FROM bl UNION ALL
  SELECT tree_id, 'path_length', id, plen FROM pt UNION ALL SELECT tree_id, 'path_tortuosity', id, tort FROM pt UNION ALL
  SELECT tree_id, 'length', 0, sum(coalesce(step, 0)) FROM par GROUP BY tree_id)""")
_PARTS = lambda n: population.union(*(n.where(F.col("tree_id") % 3 == k) for k in range(3)))
register("population_flat", lambda n: population.flatten(_PARTS(n)).groupBy("tree_id").agg(F.count("*").alias("n_nodes")), CTE + "SELECT (tree_id % 3)::VARCHAR || '/' || tree_id::VARCHAR AS tree_id, count(*)::BIGINT AS n_nodes FROM nodes GROUP BY ALL")
register("population_map", lambda n: population.map_trees(n, lambda t: t.assign(x=t.x - t.x.iloc[0], r=t.r.iloc[::-1].to_numpy())), CTE + f"""
SELECT tree_id, {_big('id', 'type', 'pid')}, {_r('x - first_value(x) OVER w', 'x')}, {_r('y', 'y')}, {_r('z', 'z')}, {_r('first_value(r) OVER (PARTITION BY tree_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'r')} FROM nodes WINDOW w AS (PARTITION BY tree_id ORDER BY id)
""".replace("first_value(r) OVER (PARTITION BY tree_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "list(r) OVER (PARTITION BY tree_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[count(*) OVER (PARTITION BY tree_id) - id]"))
register("transforms", lambda n: population.Transforms(population.identity, geometry.translate_origin, population.Transforms(lambda d: geometry.scale(d, 2.0, 2.0, 2.0)))(n), CTE + "SELECT n.tree_id, n.id::BIGINT AS id, n.type::BIGINT AS type, n.pid::BIGINT AS pid, " + ", ".join(_r(f"2 * (n.{c} - s.{c})", c) for c in "xyz") + f", {_r('n.r', 'r')} FROM nodes n JOIN nodes s ON n.tree_id = s.tree_id AND s.pid = -1")


def _padded_populations(n: DataFrame) -> DataFrame:
    """One value a population, tree and place, padded to the longest of all populations."""
    p = population.flatten(_PARTS(n))
    v = features.padded(features.extract(p, "tip_radial_distance"))
    place = F.split("tree_id", "/")
    return v.select(F.get(place, 0).cast("long").alias("population"), F.get(place, 1).cast("long").alias("tree_id"), F.posexplode("values").alias("pos", "value"))


register("populations_padded", _padded_populations, CTE + f""",
tp AS (SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY id) - 1 AS pos, rd FROM rad WHERE n_children = 0),
ln AS (SELECT max(pos) + 1 AS n FROM tp)
SELECT t.tree_id % 3 AS population, t.tree_id, k AS pos, {_r('coalesce(rd, 0)', 'value')} FROM (SELECT DISTINCT tree_id FROM tp) t CROSS JOIN ln CROSS JOIN range(0, 1000000) g(k) LEFT JOIN tp ON tp.tree_id = t.tree_id AND tp.pos = k WHERE k < n""".replace("range(0, 1000000) g(k)", "(SELECT DISTINCT pos AS k FROM tp) g"))
register("view_segments3d", views.segments3d, CTE + _KEY + ", ".join(_r(f"p{c}", f"{c}0") for c in "xyz") + ", " + ", ".join(_r(c, f"{c}1") for c in "xyz") + f", ([{', '.join(repr(c) for c in views.PALETTE)}])[ptype % 8 + 1] AS colour FROM par WHERE pid <> -1")
register("sholl_rings", lambda n: views.rings(features.sholl(n)).select("tree_id", "k", "crossings", "shade"), CTE + """,
e AS (SELECT c.tree_id, least(c.rd, p.rd) AS lo, greatest(c.rd, p.rd) AS hi FROM rad c JOIN rad p ON c.tree_id = p.tree_id AND c.pid = p.id),
top AS (SELECT tree_id, max(rd) AS rmax FROM rad GROUP BY tree_id),
cr AS (SELECT e.tree_id, k, sum((lo <= k * rmax / 21 AND hi > k * rmax / 21)::INT)::BIGINT AS crossings FROM e JOIN top USING (tree_id), range(1, 21) g(k) GROUP BY ALL)
SELECT tree_id, k, crossings, round(coalesce(crossings / nullif(max(crossings) OVER (PARTITION BY tree_id), 0), 0), 6) + 0.0 AS shade FROM cr""")
register("spanning_length", lambda n: T.edges(construct.minimum_spanning_tree(n.select(F.col("tree_id").alias("cloud_id"), F.col("id").alias("pos"), "x", "y", "z"), furcations=-1)).groupBy("tree_id").agg(F.count("*").alias("n_edges"), F.sum("length").alias("length")), CTE + """,
b0 AS (SELECT a.tree_id, a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM nodes a JOIN nodes b USING (tree_id))""" + "".join(f""",
b{k + 1} AS MATERIALIZED (SELECT p.tree_id, p.a, q.b, min(greatest(p.d, q.d)) AS d FROM b{k} p JOIN b{k} q ON p.tree_id = q.tree_id AND p.b = q.a GROUP BY ALL)""" for k in range(7)) + f"""
SELECT tree_id, count(*)::BIGINT AS n_edges, {_r('sum(b0.d)', 'length')} FROM b0 JOIN b7 USING (tree_id, a, b) WHERE a < b AND b0.d = b7.d GROUP BY tree_id""")

# Section: files that are written to the shared folder and read again


def register_files(name: str, plan, sql: str, digits: int = 4) -> None:
    """A query that writes files of the forest to a new folder and reads them; they go when the session's JVM ends."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{runtime.shared_folder(spark)}/files-{uuid.uuid4().hex}"
        runtime.delete_on_exit(spark, folder)
        return rounded(plan(spark, forest(spark, sf_dir), folder), digits)

    QUERIES[name] = run
    ORACLE_SQL[name] = CTE + sql




def _named(df: DataFrame) -> DataFrame:
    """tree_id as the number that a file is named by."""
    return df.withColumn("tree_id", F.regexp_replace(F.element_at(F.split("tree_id", "/"), -1), r"\.e?swc$", "").cast("long"))


_DFS = """,
way AS (SELECT *, [0] AS path FROM nodes WHERE pid = -1 UNION ALL SELECT n.*, list_append(w.path, -n.id) FROM way w JOIN nodes n ON n.tree_id = w.tree_id AND n.pid = w.id),
num AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS new FROM way)
SELECT a.tree_id, a.new::BIGINT AS id, a.type::BIGINT AS type, coalesce(p.new, -1)::BIGINT AS pid, """ + ", ".join(_r(f"a.{c}", c, 4) for c in "xyzr")
_FROM = " FROM num a LEFT JOIN num p ON p.tree_id = a.tree_id AND p.id = a.pid"
_PLAIN = f"SELECT tree_id, (id + 1)::BIGINT AS id, type::BIGINT AS type, (CASE WHEN pid = -1 THEN -1 ELSE pid + 1 END)::BIGINT AS pid, {', '.join(_r(c, c, 4) for c in 'xyzr')} FROM nodes"


def _swc_files(spark: SparkSession, n: DataFrame, folder: str) -> DataFrame:
    swc.write_swc(n, folder)
    return _named(swc.read_swc(spark, folder))


def _swc_format(spark: SparkSession, n: DataFrame, folder: str) -> DataFrame:
    swc.write_swc(n, folder)
    swc.register(spark)
    return _named(spark.read.format("swc").load(folder))


def _eswc_files(spark: SparkSession, n: DataFrame, folder: str) -> DataFrame:
    extra = {c: (F.col("id") * (i + 1)).cast("int") for i, c in enumerate(schema.EXTENDED)}
    swc.write_eswc(n.withColumns(extra), folder)
    return _named(swc.read_eswc(spark, folder, sort=False)).select("tree_id", "id", "pid", "x", *schema.EXTENDED)


def _found(spark: SparkSession, n: DataFrame, folder: str) -> DataFrame:
    swc.write_swc(n, folder)
    return swc.find_swcs(spark, folder.removeprefix("file://"), relative=True).select("path")


def _parts(spark: SparkSession, n: DataFrame, folder: str) -> DataFrame:
    """Files of several trees, a component each."""
    swc.write_swc(n.withColumn("pid", F.when(F.col("id") % 25 == 0, -1).otherwise(F.col("pid"))), folder)
    c = swc.read_components(spark, folder, reset=False)
    place = F.split(F.element_at(F.split("tree_id", "/"), -1), r"\.swc#component_")
    return c.select(F.get(place, 0).cast("long").alias("tree_id"), F.get(place, 1).cast("long").alias("component"), "id", "pid", "x")


def _asc_files(spark: SparkSession, n: DataFrame, folder: str) -> DataFrame:
    """Every branch as a tree of a Neurolucida file."""
    b = T.branches(n).groupBy("tree_id", "branch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z", "r"))).alias("ps"))
    line = F.array_join(F.transform("ps", lambda p: F.format_string("(%.4f %.4f %.4f %.4f)", *(p[c] for c in "xyzr"))), "\n")
    text = F.concat(F.lit("; a branch\n((Color Red) (Axon)\n"), line, F.lit("\n)"))
    return asc.asc_nodes(b.select(F.concat_ws("#", F.col("tree_id").cast("string"), F.col("branch_id").cast("string")).alias("tree_id"), text.alias("text")))


register_files("swc_files", _swc_files, _DFS + _FROM)
register_files("swc_format", _swc_format, _PLAIN)
register_files("eswc_files", _eswc_files, "SELECT tree_id, id::BIGINT AS id, pid::BIGINT AS pid, round(x, 4) + 0.0 AS x, " + ", ".join(f"(id * {i + 1})::BIGINT AS {c}" for i, c in enumerate(schema.EXTENDED)) + " FROM nodes")
register_files("swc_find", _found, "SELECT DISTINCT tree_id::VARCHAR || '.swc' AS path FROM nodes")
register_files("swc_components", _parts, """,
kn AS (SELECT tree_id, id, x, CASE WHEN id % 25 = 0 THEN -1 ELSE pid END AS pid FROM nodes),
rc AS (SELECT tree_id, id, id AS root FROM kn WHERE pid = -1 UNION ALL SELECT k.tree_id, k.id, r.root FROM rc r JOIN kn k ON k.tree_id = r.tree_id AND k.pid = r.id)
SELECT tree_id, (dense_rank() OVER (PARTITION BY tree_id ORDER BY root) - 1)::BIGINT AS component, (id + 1)::BIGINT AS id, (CASE WHEN pid = -1 THEN -1 ELSE pid + 1 END)::BIGINT AS pid, round(x, 4) + 0.0 AS x FROM kn JOIN rc USING (tree_id, id)""")
register_files("asc_branches", _asc_files, BRANCH + f"SELECT tree_id::VARCHAR || '#' || branch_id::VARCHAR AS tree_id, pos::BIGINT AS id, 2::BIGINT AS type, (CASE pos WHEN 0 THEN -1 ELSE pos - 1 END)::BIGINT AS pid, {', '.join(_r(c, c, 4) for c in 'xyzr')} FROM bp")
register("text_encodings", lambda n: n.select("tree_id", "id", archive.detect_encoding(F.when(F.col("id") % 3 == 0, F.encode(F.concat(F.lit("é"), F.col("x").cast("string")), "UTF-8")).when(F.col("id") % 3 == 1, F.unhex(F.lit("FFFE4100"))).otherwise(F.unhex(F.lit("E94142")))).alias("encoding"), archive.is_valid(F.col("id")).alias("valid")), CTE + f"SELECT tree_id, id::BIGINT AS id, CASE id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16LE' ELSE 'ISO-8859-1' END AS encoding, id NOT IN ({', '.join(map(str, archive.BAD_IDS))}) AS valid FROM nodes")

# Section: every embedding as a stack of 4 x 4 x 4 voxels of 8 bits

_CUBE = """WITH el AS (SELECT vec_id::VARCHAR AS path, generate_subscripts(embedding, 1)::BIGINT - 1 AS e, floor(abs(unnest(embedding)::DOUBLE) * 255) % 256 AS v FROM embeddings),
vx AS (SELECT path, e // 16 AS i, e // 4 % 4 AS j, e % 4 AS k, 0::BIGINT AS c, v::DOUBLE AS v FROM el)"""


def cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image stacks (path, shape, dtype, data) of the embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("path"), F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 255), F.lit(256)).cast("int")).alias("v"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([files.row(p, np.array(v, np.uint8).reshape(4, 4, 4, 1)) for p, v in zip(pdf.path, pdf.v)], columns=["path", "shape", "dtype", "data"])

    return e.mapInPandas(run, files.SCHEMA)


def register_cubes(name: str, plan, sql: str, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(plan(cubes(spark, sf_dir)), digits)
    ORACLE_SQL[name] = _CUBE + sql


def _mapped(fn):
    return lambda s: images.voxels(images.map_stacks(s, fn))


_VOXEL = " SELECT path, i, j, k, c, v FROM vx"
_wide = lambda a: (a.astype(np.uint16) * 257)
for _name, _fn in {
    "stack_v3draw": lambda a: files.decode_v3draw(files.encode_v3draw(a)),
    "stack_v3dpbd": lambda a: files.decode_v3dpbd(files.encode_v3dpbd8(a)),
    "stack_tiff": lambda a: files.decode_tiff(files.encode_tiff(a)),
    "stack_tiff_plain": lambda a: files.decode_tiff(files.encode_tiff(a, compress=False)),
    "stack_nrrd": lambda a: files.decode_nrrd(b"NRRD0004\ntype: uchar\ndimension: 3\nsizes: 4 4 4\nencoding: raw\n\n" + a[..., 0].tobytes(order="F")),
}.items():
    register_cubes(_name, _mapped(_fn), _VOXEL)
register_cubes("stack_v3draw_16", _mapped(lambda a: files.decode_v3draw(files.encode_v3draw(_wide(a)))), " SELECT path, i, j, k, c, v * 257 AS v FROM vx")
register_cubes("stack_v3draw_float", _mapped(lambda a: files.decode("a.v3draw", files.encode_v3draw(files.as_dtype(a, "f4")))), f" SELECT path, i, j, k, c, {_r('v / 255', 'v', 5)} FROM vx", 5)
register_cubes("stack_crop", lambda s: images.center_crop(images.voxels(s), (2, 3, 1)), " SELECT path, i - 1 AS i, j AS j, k - 1 AS k, c, v FROM vx WHERE i IN (1, 2) AND j < 3 AND k = 1")
for _axis in "ijk":
    register_cubes(f"stack_flip_{_axis}", lambda s, a=_axis: images.flip(images.voxels(s), a), " SELECT path, " + ", ".join(f"3 - {a} AS {a}" if a == _axis else a for a in "ijk") + ", c, v FROM vx")
for _m, _at in enumerate(("j, i, k", "k, j, i", "i, k, j", "3 - i, j, k", "i, 3 - j, k", "i, j, 3 - k", "3 - j, i, k", "3 - k, j, i", "i, 3 - k, j")):
    register_cubes(f"stack_augment_{_m}", _mapped(lambda a, m=_m: images.augment(a, m)), " SELECT path, " + ", ".join(f"{x} AS {n}" for x, n in zip(_at.split(", "), "ijk")) + ", c, v FROM vx")
register_cubes("stack_min_z", _mapped(images.subtract_min_z), " SELECT path, i, j, k, c, v - min(v) OVER (PARTITION BY path, i, j ORDER BY k ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v FROM vx")
register_cubes("stack_sigmoid", _mapped(images.sigmoid), " SELECT path, i, j, k, c, floor(255 / (1 + exp(-3 * (v / 255 - p)))) AS v FROM vx JOIN (SELECT path, quantile_cont(v / 255, 0.25) AS p FROM vx GROUP BY path) USING (path)")
register_cubes("stack_labels", lambda s: files.labelled(s, F.col("path").cast("int") % 5).select("path", "label", F.element_at("shape", 1).alias("width"), "dtype"), " SELECT DISTINCT path, path::BIGINT % 5 AS label, 4::BIGINT AS width, 'u1' AS dtype FROM vx")
register_cubes("stack_statistics", lambda s: images.folder_statistics(images.voxels(s)).select("count", "minimum", "maximum", "mean"), f" SELECT (SELECT count(DISTINCT path) FROM vx)::BIGINT AS count, {_r('min(v)', 'minimum')}, {_r('max(v)', 'maximum')}, {_r('avg(v)', 'mean')} FROM vx")
register_cubes("stack_contrast", lambda s: images.contrasts(images.voxels(s), F.col("k") < 2), f"""
SELECT path, {_r('stddev_pop(v)', 'std', 6)}, {_r('(max(v) - min(v)) / nullif(max(v) + min(v), 0)', 'michelson', 6)}, {_r('sqrt(avg(v * v))', 'rms', 6)},
       {_r('(avg(v) FILTER (k < 2) - avg(v) FILTER (k >= 2)) / nullif(avg(v) FILTER (k >= 2), 0)', 'weber', 6)} FROM vx GROUP BY path""", 6)


def _tiff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{runtime.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    runtime.delete_on_exit(spark, folder)
    files.write_tiff(cubes(spark, sf_dir), folder.removeprefix("file://"))
    back = files.read_images(spark, folder, dtype=None)
    return rounded(images.voxels(back).withColumn("path", F.regexp_extract("path", r"([^/]+)\.tiff?$", 1)))


QUERIES["stack_files"] = _tiff_files
ORACLE_SQL["stack_files"] = _CUBE + _VOXEL

# Section: whole-tree operators where SQL can follow

_LINES = lambda n: T.branches(n).select("tree_id", F.col("branch_id").alias("line_id"), "pos", "type", "x", "y", "z", "r")
register("lines_length", lambda n: T.edges(construct.lines_to_tree(_LINES(n), thre=1e-6)).groupBy("tree_id").agg(F.count("*").alias("n_edges"), F.sum("length").alias("length")), CTE + f"SELECT tree_id, count(*)::BIGINT AS n_edges, {_r('sum(step)', 'length')} FROM par WHERE pid <> -1 GROUP BY tree_id")
register("link_two", lambda n: construct.link_nearest(n.withColumn("pid", F.when(F.col("id") == 40, -1).otherwise(F.col("pid")))), CTE + f""",
cut AS (SELECT tree_id, id, x, y, z, CASE WHEN id = 40 THEN -1 ELSE pid END AS pid FROM nodes),
rc AS (SELECT tree_id, id, id AS root FROM cut WHERE pid = -1 UNION ALL SELECT c.tree_id, c.id, r.root FROM rc r JOIN cut c ON c.tree_id = r.tree_id AND c.pid = r.id),
near AS (SELECT m.tree_id, 40 AS id, arg_min(m.id, struct_pack(d := sqrt((m.x - s.x) ** 2 + (m.y - s.y) ** 2 + (m.z - s.z) ** 2), i := m.id)) AS up
         FROM cut m JOIN rc ON rc.tree_id = m.tree_id AND rc.id = m.id AND rc.root = 0 JOIN cut s ON s.tree_id = m.tree_id AND s.id = 40 GROUP BY m.tree_id)
SELECT n.tree_id, n.id::BIGINT AS id, n.type::BIGINT AS type, coalesce(near.up, n.pid)::BIGINT AS pid, {', '.join(_r(f'n.{c}', c) for c in 'xyzr')} FROM nodes n LEFT JOIN near ON near.tree_id = n.tree_id AND near.id = n.id""")
ORACLE_SQL["standardise"] = CTE + BRANCH + f""",
ln AS (SELECT *, x1 - x0 AS vx, y1 - y0 AS vy, z1 - z0 AS vz, straight AS size FROM bl),
pt AS (SELECT b.tree_id, b.branch_id, b.pos, b.r, l.size, l.n_nodes, b.x - x0 AS dx, b.y - y0 AS dy, b.z - z0 AS dz, vx / nullif(size, 0) AS ex, vy / nullif(size, 0) AS ey, vz / nullif(size, 0) AS ez,
              max(b.r) OVER (PARTITION BY b.tree_id, b.branch_id) AS top FROM bp b JOIN ln l USING (tree_id, branch_id)),
ax AS (SELECT *, dx * ex + dy * ey + dz * ez AS along FROM pt),
of AS (SELECT *, dx - along * ex AS ox, dy - along * ey AS oy, dz - along * ez AS oz, sqrt((dx - along * ex) ** 2 + (dy - along * ey) ** 2 + (dz - along * ez) ** 2) AS far FROM ax),
fr AS (SELECT tree_id, branch_id, arg_max(struct_pack(x := ox / far, y := oy / far, z := oz / far), struct_pack(f := far, p := -pos)) AS w FROM of WHERE far > 1e-12 AND pos > 0 AND pos < n_nodes - 1 GROUP BY ALL)
SELECT o.tree_id, o.branch_id::BIGINT AS branch_id, o.pos::BIGINT AS pos, {_r('CASE WHEN size = 0 THEN dx ELSE along / size END', 'x')},
       {_r('CASE WHEN size = 0 THEN dy WHEN w IS NULL THEN 0 ELSE (dx * w.x + dy * w.y + dz * w.z) / size END', 'y')},
       {_r('CASE WHEN size = 0 THEN dz WHEN w IS NULL THEN 0 ELSE (dx * (ey * w.z - ez * w.y) + dy * (ez * w.x - ex * w.z) + dz * (ex * w.y - ey * w.x)) / size END', 'z')}, {_r('r / top', 'r')}
FROM of o LEFT JOIN fr ON fr.tree_id = o.tree_id AND fr.branch_id = o.branch_id"""
