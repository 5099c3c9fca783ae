"""The engine's queries over the test tables, and their SQL."""

from __future__ import annotations


from codeloom.operators import hierarchy
from codeloom.plans import analytics, contexts, operations, retrieval  # noqa: F401
from codeloom.plans.base import QUERIES, SQL, query
from codeloom.session import table

FLAGSHIP = "grep_lines"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]


# Problem 4: parent-child links to hierarchies


@query
def p4_found(spark, d):
    """Classes that are their own ancestor."""
    return hierarchy.cycle_nodes(table(spark, d, "inheritance_edges"), "workspace_id", "child", "parent").withColumnRenamed("scope", "workspace_id")


_CLOSURE = """
WITH RECURSIVE e AS (SELECT DISTINCT workspace_id, child, parent FROM inheritance_edges WHERE workspace_id IS NOT NULL AND child IS NOT NULL AND parent IS NOT NULL),
up(workspace_id, descendant, ancestor) AS (
  SELECT workspace_id, child, parent FROM e
  UNION SELECT up.workspace_id, up.descendant, e.parent FROM up JOIN e ON e.workspace_id = up.workspace_id AND e.child = up.ancestor)
"""
SQL["p4_found"] = _CLOSURE + "SELECT workspace_id, ancestor AS node FROM up WHERE ancestor = descendant"


@query
def p4_hierarchy(spark, d):
    """Status, root, depth, full path and nested-set range of every class."""
    return hierarchy.hierarchy(table(spark, d, "inheritance_edges"), "workspace_id", "child", "parent").withColumnRenamed("scope", "workspace_id")


SQL["p4_hierarchy"] = """
WITH RECURSIVE e AS (SELECT DISTINCT workspace_id AS w, child AS c, parent AS p FROM inheritance_edges WHERE workspace_id IS NOT NULL AND child IS NOT NULL AND parent IS NOT NULL),
nodes AS (SELECT w, c AS v FROM e UNION SELECT w, p FROM e),
up(w, d, a) AS (SELECT w, c, p FROM e UNION SELECT up.w, up.d, e.p FROM up JOIN e ON e.w = up.w AND e.c = up.a),
cyc AS (SELECT DISTINCT w, a AS v FROM up WHERE a = d),
lv(w, v, l) AS (SELECT w, v, 0 FROM nodes WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.w = nodes.w AND e.c = nodes.v) UNION SELECT lv.w, e.c, lv.l + 1 FROM lv JOIN e ON e.w = lv.w AND e.p = lv.v WHERE lv.l < 400),
dep AS (SELECT w, v, min(l) AS depth FROM lv GROUP BY w, v),
par AS (SELECT e.w, e.c AS v, min(e.p) AS u FROM e JOIN dep a ON a.w = e.w AND a.v = e.c JOIN dep b ON b.w = e.w AND b.v = e.p WHERE b.depth = a.depth - 1 GROUP BY e.w, e.c),
tree(w, v, path) AS (SELECT w, v, [v] FROM dep WHERE depth = 0 UNION ALL SELECT par.w, par.v, list_append(tree.path, par.v) FROM tree JOIN par ON par.w = tree.w AND par.u = tree.v),
size AS (SELECT w, unnest(path) AS v, count(*) AS n FROM tree GROUP BY 1, 2),
ranked AS (SELECT tree.*, row_number() OVER (PARTITION BY tree.w, path[1] ORDER BY path) - 1 AS lft FROM tree)
SELECT n.w AS workspace_id, n.v AS node, CASE WHEN c.v IS NOT NULL THEN 'cycle' WHEN r.v IS NOT NULL THEN 'tree' ELSE 'below_cycle' END AS status, c.v IS NOT NULL AS in_cycle, r.path[1] AS root, CAST(len(r.path) - 1 AS BIGINT) AS depth, r.path, r.lft, r.lft + s.n - 1 AS rgt, s.n - 1 AS n_descendants
FROM nodes n LEFT JOIN cyc c ON c.w = n.w AND c.v = n.v LEFT JOIN ranked r ON r.w = n.w AND r.v = n.v LEFT JOIN size s ON s.w = n.w AND s.v = n.v
"""


@query
def p4_descendants(spark, d):
    """Every class with each class below it."""
    return hierarchy.descendants(table(spark, d, "inheritance_edges"), "workspace_id", "child", "parent").withColumnRenamed("scope", "workspace_id")


SQL["p4_descendants"] = _CLOSURE + "SELECT workspace_id, ancestor, descendant FROM up"
