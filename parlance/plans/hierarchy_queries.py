"""Hierarchies of messages that translate an earlier message again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import hierarchy as H
from parlance.operators.versions import current_rows
from parlance.session import written
from parlance.sources.tables import table


def message_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rows(table(spark, folder, "messages"), {"parent": F.col("original_message_id")})
    return written(H.links(rows, "id", "parent"), "links")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(message_id, root_id, depth) of every current message that names a parent."""
    links = message_links(spark, folder)
    found = H.rooted(H.decompose(links)).join(links.select("node"), "node", "left_semi")
    return found.select(F.col("node").alias("message_id"), F.col("root").alias("root_id"), "depth")


def message_trees(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels of the trees, labels of the opened circles, and the circles."""
    links = message_links(spark, folder)
    trees = H.decompose(links)
    circles = written(trees.circles, "circles")
    return written(trees.labels, "labels"), written(H.decompose(H.opened(links, circles)).labels, "around"), circles


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every (message, descendant, steps) of every message, those on circles and above them included."""
    return H.all_descendants(*message_trees(spark, folder)).select(F.col("node").alias("message_id"), F.col("below").alias("descendant_id"), F.col("steps").cast("int").alias("steps"))


def p5_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth, path and number of descendants of every current message, also of those without links.

    Messages that run into a circle have depth -1, the smallest node of the circle as root and no path.
    """
    labels, around, circles = message_trees(spark, folder)
    linked = labels.join(H.paths(labels), "node").select("node", "root", F.col("depth").cast("int").alias("depth"), F.array_join("path", "/").alias("path"), (F.col("size") - 1).alias("descendants"))
    whole = around.where("depth = 0").select("root", F.col("size").alias("whole"))
    rings = circles.join(around.select("node", "root", "size"), "node").join(whole, "root")
    looped = rings.select("node", F.col("circle").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("path"), (F.when(F.col("on_circle"), F.col("whole")).otherwise(F.col("size")) - 1).alias("descendants"))
    found = written(linked.unionByName(looped), "linked")
    ids = table(spark, folder, "messages").where("id IS NOT NULL").select(F.col("id").alias("node")).distinct()
    alone = ids.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.col("node").alias("path"), F.lit(0).cast("long").alias("descendants"))
    return found.unionByName(alone).select(F.col("node").alias("message_id"), F.col("root").alias("root_id"), "depth", "path", "descendants")


QUERIES = {"p5_found": p5_found, "p5_pairs": p5_pairs, "p5_messages": p5_messages}

_CURRENT = """
WITH RECURSIVE cur AS (
  SELECT id, arg_max(coalesce(original_message_id, ''), updated_at) AS parent FROM messages WHERE id IS NOT NULL GROUP BY id),
edges AS (SELECT c.id AS node, p.id AS up FROM cur c LEFT JOIN cur p ON p.id = c.parent WHERE c.parent <> ''),
tops AS (SELECT node FROM edges WHERE up IS NULL UNION SELECT up FROM edges WHERE up IS NOT NULL AND up NOT IN (SELECT node FROM edges)),
walk AS (
  SELECT node, node AS root, 0 AS depth, node AS path FROM tops
  UNION ALL
  SELECT e.node, w.root, w.depth + 1, w.path || '/' || e.node FROM walk w JOIN edges e ON e.up = w.node)
"""

_PAIRS = """,
above AS (
  SELECT node, up AS spot, 1 AS steps, [node, up] AS seen FROM edges WHERE up IS NOT NULL AND up <> node
  UNION ALL
  SELECT a.node, e.up, a.steps + 1, list_append(a.seen, e.up) FROM above a JOIN edges e ON e.node = a.spot
  WHERE e.up IS NOT NULL AND NOT list_contains(a.seen, e.up))
"""

ORACLE = {
    "p5_found": _CURRENT
    + """,
lost AS (SELECT node, up FROM edges WHERE node NOT IN (SELECT node FROM walk)),
reach AS (
  SELECT node, up AS spot FROM lost
  UNION
  SELECT r.node, l.up FROM reach r JOIN lost l ON l.node = r.spot),
ring AS (SELECT node FROM reach WHERE node = spot)
SELECT w.node AS message_id, w.root AS root_id, CAST(w.depth AS INTEGER) AS depth FROM walk w WHERE w.node IN (SELECT node FROM edges)
UNION ALL
SELECT node, min(spot), -1 FROM reach WHERE spot IN (SELECT node FROM ring) GROUP BY node
""",
    "p5_pairs": _CURRENT
    + _PAIRS
    + """
SELECT spot AS message_id, node AS descendant_id, CAST(steps AS INTEGER) AS steps FROM above
""",
    "p5_messages": _CURRENT
    + _PAIRS
    + """,
lost AS (SELECT node, up FROM edges WHERE node NOT IN (SELECT node FROM walk)),
ring AS (SELECT l.node FROM lost l WHERE l.up = l.node OR EXISTS (SELECT 1 FROM above a WHERE a.node = l.up AND a.spot = l.node)),
loops AS (
  SELECT l.node, min(r.node) AS root FROM lost l JOIN ring r ON r.node = l.node OR EXISTS (SELECT 1 FROM above a WHERE a.node = l.node AND a.spot = r.node)
  GROUP BY l.node)
SELECT c.id AS message_id, coalesce(w.root, l.root, c.id) AS root_id, CAST(CASE WHEN l.node IS NOT NULL THEN -1 ELSE coalesce(w.depth, 0) END AS INTEGER) AS depth,
  CASE WHEN l.node IS NULL THEN coalesce(w.path, c.id) END AS path, coalesce(n.n, 0) AS descendants
FROM cur c LEFT JOIN walk w ON w.node = c.id LEFT JOIN loops l ON l.node = c.id
LEFT JOIN (SELECT spot, count(*) AS n FROM above GROUP BY spot) n ON n.spot = c.id
""",
}
