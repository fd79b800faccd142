"""The forest view: trees derived from the ``events`` table, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = """
SELECT tree_id, CAST(id AS INT) AS id,
       CASE WHEN id = 0 THEN 1 WHEN event_type = 'click' THEN 2 WHEN event_type = 'view' THEN 3
            WHEN event_type = 'error' THEN 4 ELSE 6 END AS type,
       x, y, z, r,
       CAST(CASE WHEN id = 0 THEN -1 WHEN id % 4 <> 0 THEN id - 1
            ELSE (id * 7919 + tree_id * 31) % id END AS INT) AS pid
FROM (SELECT user_id AS tree_id,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS id,
             event_type, value AS x,
             CAST(event_id % 97 AS DOUBLE) AS y, CAST(event_id % 61 AS DOUBLE) AS z,
             1.0e0 + (event_id % 5) * 0.25e0 AS r
      FROM {events}) e
"""


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node table of one tree a user: node k is the user's k-th event."""
    events = f"parquet.`{sf_dir}/events.parquet`"
    return spark.sql(SQL.format(events=events))


#: The same as the start of a DuckDB query, with what most checks need.
CTE = f"""
WITH RECURSIVE nodes AS ({SQL.format(events='events')}),
kids AS (SELECT tree_id, pid AS id, count(*) AS n FROM nodes WHERE pid <> -1 GROUP BY ALL),
nc AS (SELECT n.*, coalesce(k.n, 0)::BIGINT AS n_children FROM nodes n LEFT JOIN kids k USING (tree_id, id)),
par AS (SELECT c.*, p.x AS px, p.y AS py, p.z AS pz, p.r AS pr, p.pid AS ppid, p.n_children AS p_children, p.type AS ptype,
               sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) + (c.z - p.z) * (c.z - p.z)) AS step
        FROM nc c LEFT JOIN nc p ON c.tree_id = p.tree_id AND c.pid = p.id),
rad AS (SELECT n.*, sqrt((n.x - s.x) * (n.x - s.x) + (n.y - s.y) * (n.y - s.y) + (n.z - s.z) * (n.z - s.z)) AS rd
        FROM nc n JOIN nodes s ON n.tree_id = s.tree_id AND s.pid = -1)
"""

WALK = """,
walk AS (
  SELECT tree_id, id, pid, type, x, y, z, r, n_children, 0::BIGINT AS depth, 0::DOUBLE AS plen,
         (n_children > 1)::BIGINT AS border, 0::BIGINT AS level, -1 AS neurite
  FROM par WHERE pid = -1
  UNION ALL
  SELECT c.tree_id, c.id, c.pid, c.type, c.x, c.y, c.z, c.r, c.n_children, w.depth + 1, w.plen + c.step,
         w.border + (c.n_children > 1)::BIGINT, w.level + (c.n_children > 1)::BIGINT, CASE WHEN w.pid = -1 THEN c.id ELSE w.neurite END
  FROM par c JOIN walk w ON c.tree_id = w.tree_id AND c.pid = w.id)
"""

BRANCH = """,
br AS (
  SELECT tree_id, id AS branch_id, 1 AS pos, id, n_children, pid AS start FROM par WHERE pid <> -1 AND (ppid = -1 OR p_children > 1)
  UNION ALL
  SELECT b.tree_id, b.branch_id, b.pos + 1, c.id, c.n_children, b.start
  FROM br b JOIN par c ON c.tree_id = b.tree_id AND c.pid = b.id WHERE b.n_children = 1),
bn AS (
  SELECT tree_id, branch_id, pos, id FROM br UNION ALL
  SELECT tree_id, branch_id, 0, start FROM br WHERE pos = 1),
bp AS (SELECT b.*, n.x, n.y, n.z, n.r, n.type FROM bn b JOIN nodes n USING (tree_id, id)),
bl AS (
  SELECT tree_id, branch_id, count(*) AS n_nodes, sum(d) AS length,
         sqrt((max_by(x, pos) - min_by(x, pos)) ** 2 + (max_by(y, pos) - min_by(y, pos)) ** 2 + (max_by(z, pos) - min_by(z, pos)) ** 2) AS straight,
         min_by(r, pos) AS r0, max_by(r, pos) AS r1, min_by(id, pos) AS start, max_by(id, pos) AS fin,
         min_by(x, pos) AS x0, min_by(y, pos) AS y0, min_by(z, pos) AS z0, max_by(x, pos) AS x1, max_by(y, pos) AS y1, max_by(z, pos) AS z1
  FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS d
        FROM bp WINDOW w AS (PARTITION BY tree_id, branch_id ORDER BY pos)) GROUP BY tree_id, branch_id)
"""
