"""Parent-child rows to full hierarchies: path, depth, root, nested-set range, descendants, cycles.

One distributed plan at every size, whose rounds grow with the logarithm of the depth, by pointer doubling:

1. Loops. Where a node has one parent, pointers to it are doubled until they end at a root or at a node with several
   parents. Pointers that never end are in or below a loop of such nodes; the image of the doubled pointers shrinks to
   the loops. Nodes with several parents form a smaller graph over where their parents' pointers end, which is treated
   the same way until nothing is left; nodes that stay unprocessed are those that loops keep from a root.
2. Levels. Depths come down from the roots over the nodes with several parents (rounds by how deep these are nested) and
   then to all nodes by the doubled pointers; each node hangs below its parent of least depth and name.
3. Ranges. Along the tree, doubling sums subtree sizes upward (the nodes within 2**k levels, then twice as many) and
   collects paths; siblings get their offsets by prefix sums over range partitions, so that a parent of any number of
   children lies in no one task, and doubling adds the offsets downward to preorder ranges.

Every round is one equi-join of narrow rows, written to a scratch table. Skew (a parent of very many) meets either side
conditions that leave resolved rows out of the join, partial aggregates, or adaptive skew joins.

Defined results
- Names compare exactly. A row with a null scope, child or parent states no edge and is left out.
- Repeated edges count once. A node with several parents hangs below the parent of least depth, then of
  least name; its other parents still count for descendants and for loops.
- ``status``: 'tree' (a root reaches it), 'cycle' (reachable from itself, whatever else reaches it) or
  'below_cycle' (only loops reach it). Only nodes that a root reaches have root, depth, path, lft and rgt.
- ``lft`` and ``rgt`` count from 0 within the tree of a root; siblings are in the order of their names.
- Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ordered import prefix_sums
from codeloom.session import Scratch


def distinct_edges(edges: DataFrame, scope: str, child: str, parent: str) -> DataFrame:
    """(scope, child, parent), distinct and without nulls."""
    cols = [F.col(scope).cast("string").alias("scope"), F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent")]
    return edges.select(*cols).dropna().distinct()


def numbered(edges: DataFrame, scratch: Scratch, tries: int = 8) -> tuple[DataFrame, DataFrame]:
    """((id, scope, node), (c, p)): nodes with a 64-bit number of their own and the edges between numbers. Numbers are
    hashes; a seed under which two nodes would share one is passed over."""
    names = edges.select("scope", F.col("child").alias("node")).unionByName(edges.select("scope", F.col("parent").alias("node"))).distinct()
    for seed in range(tries):
        nodes = scratch.write(names.select(F.xxhash64(F.lit(seed), "scope", "node").alias("id"), "scope", "node"))
        n, distinct = nodes.agg(F.count("*"), F.countDistinct("id")).first()
        if n == distinct:
            both = edges.select(F.xxhash64(F.lit(seed), "scope", "child").alias("c"), F.xxhash64(F.lit(seed), "scope", "parent").alias("p"))
            return nodes, scratch.write(both)
        scratch.drop(nodes)
    raise RuntimeError("no seed gives every node a number of its own")


class Pointers:
    """Nodes with exactly one parent, their pointers doubled until they end, and what they end at.

    ``steps[k]``: (id, to): the node after 2**k steps or where the pointer ends, if sooner. ``ends``: (id, to, dist), the
    end of every pointer that has one. ``loops``: (id, label), the nodes of loops of such nodes with the least number in
    the loop. ``several``: (c, p), the edges of nodes with more parents.
    """

    def __init__(self, edges: DataFrame, scratch: Scratch, labels: bool = True):
        degree = edges.groupBy("c").agg(F.count("*").alias("n"), F.min("p").alias("p"))
        start = degree.where("n = 1").select(F.col("c").alias("id"), F.col("p").alias("to"), F.lit(1).cast("long").alias("dist"), F.lit(True).alias("live"))
        self.several = scratch.write(edges.join(degree.where("n > 1").select("c"), "c", "left_semi"))
        t = self.single = scratch.write(start)
        self.steps, left = [t], None
        while True:
            # a pointer goes on while it is at a node that has one itself
            far = t.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("dist").alias("dist2"))
            on = t.where("live").join(far, "to", "left")
            on = on.select("id", F.coalesce("to2", "to").alias("to"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.col("to2").isNotNull().alias("live"))
            t = scratch.write(t.where("not live").unionByName(on))
            n = t.where("live").count()
            self.steps.append(t)
            if not n or n == left:  # none ends between 2**(k-1) and 2**k steps, so that none that is left ever ends
                break
            left = n
        moving = t.where("live") if n else None
        single = self.single
        if moving is None:
            self.ends, self.loops = t, single.select("id", F.col("id").alias("label")).limit(0)
        else:
            self.ends = t.where("not live")
            self.loops = self._loops(moving.select("id", "to"), single, scratch, labels)

    @staticmethod
    def _loops(moving: DataFrame, single: DataFrame, scratch: Scratch, labels: bool) -> DataFrame:
        """The image of endless pointers, doubled until it is stable, with the least number of each loop."""
        size = None
        while True:
            image = moving.select("to").distinct()
            n = image.count()
            if n == size:
                break
            size = n
            moving = scratch.write(moving.alias("a").join(moving.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", F.col("b.to").alias("to")))
        image = scratch.write(image.withColumnRenamed("to", "id"))
        if not labels:
            return image.select("id", F.col("id").alias("label"))
        low = scratch.write(single.join(image, "id", "left_semi").select("id", "to", F.col("id").alias("label")))
        total = None
        while True:
            nxt = low.alias("a").join(low.alias("b"), F.col("a.to") == F.col("b.id"))
            low = scratch.write(nxt.select("a.id", F.col("b.to").alias("to"), F.least("a.label", "b.label").alias("label")))
            s = low.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
            if s == total:
                return low.select("id", "label")
            total = s


def strong(edges: DataFrame, scratch: Scratch, labels: bool = True) -> DataFrame:
    """(id, label) of every node on a loop of (c, p), a number in common for nodes that reach one another.

    An edge from a node to itself is a loop. Recursion is over the nodes with several parents that are left. Without
    ``labels`` only the nodes count.
    """
    own = scratch.write(edges.where("c = p").select(F.col("c").alias("id")).distinct())
    e = edges.where("c <> p").distinct()
    # a loop needs an edge in and one out of each of its nodes
    e = scratch.write(e.join(e.select(F.col("p").alias("c")).distinct(), "c", "left_semi").join(e.select(F.col("c").alias("p")).distinct(), "p", "left_semi").select("c", "p"))
    n = e.count()
    if not n:
        return own.select("id", F.col("id").alias("label"))
    at = Pointers(e, scratch, labels)
    heads = at.several.select(F.col("c").alias("id")).distinct()
    # edges of nodes with several parents, to where the parents' pointers end
    end = at.several.join(at.ends.select(F.col("id").alias("p"), "to"), "p", "left").join(at.loops.select(F.col("id").alias("p"), F.lit(True).alias("lost")), "p", "left")
    end = scratch.write(end.select("c", "p", F.coalesce("to", "p").alias("a"), F.col("to").isNotNull().alias("via")))
    small = scratch.write(end.join(heads.withColumnRenamed("id", "a"), "a", "left_semi").select("c", F.col("a").alias("p")).distinct())
    m = small.count()
    if m == 0:
        found = own.select("id", F.col("id").alias("label")).limit(0)
    elif m == n:
        found = _coloured(small, scratch)
    else:
        found = strong(small, scratch)
    found = scratch.write(found)
    # nodes with one parent are on a loop if they lie between a parent and the end of its pointer, both in one loop
    lab = found.select(F.col("id").alias("c"), F.col("label").alias("lc"))
    inner = end.where("via").join(lab, "c").join(found.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").where("lc = la").select(F.col("p").alias("id"), F.col("la").alias("label")).distinct()
    new = marks = scratch.write(inner)
    for step in at.steps if new.take(1) else []:
        up = marks.join(step.select("id", "to"), "id").select(F.col("to").alias("id"), "label").join(at.single.select("id"), "id", "left_semi")
        new = scratch.write(up.distinct().join(marks.select("id"), "id", "left_anti"))
        if not new.take(1):  # closed under jumps of this length, so under all longer ones
            break
        marks = marks.unionByName(new)
    all_found = found.unionByName(marks).unionByName(at.loops).groupBy("id").agg(F.min("label").alias("label"))
    return all_found.unionByName(own.join(all_found, "id", "left_anti").select("id", F.col("id").alias("label")))


def _coloured(e: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) for graphs that pointers make no smaller: every node takes the greatest number among its ancestors as
    its colour, the node of that number takes back what it is reached from within the colour, and the rest goes on."""
    loops = e.where("c = p").select(F.col("c").alias("id")).distinct()
    e = scratch.write(e.where("c <> p"))
    found = None
    while e.take(1):
        color = scratch.write(e.select(F.col("c").alias("id")).unionByName(e.select(F.col("p").alias("id"))).distinct().withColumn("k", F.col("id")))
        while True:
            got = e.join(color.withColumnRenamed("id", "p"), "p").groupBy(F.col("c").alias("id")).agg(F.max("k").alias("g"))
            nxt = scratch.write(color.join(got, "id", "left").select("id", F.greatest("k", "g").alias("k"), (F.col("g") > F.col("k")).alias("changed")))
            if not nxt.where("changed").take(1):
                break
            color = nxt.select("id", "k")
        color = nxt.select("id", "k")
        same = scratch.write(e.join(color.withColumnsRenamed({"id": "c", "k": "kc"}), "c").join(color.withColumnsRenamed({"id": "p", "k": "kp"}), "p").where("kc = kp").select("c", "p", F.col("kc").alias("k")))
        back = front = scratch.write(color.where("id = k"))
        while True:
            nxt = same.join(front.withColumnRenamed("id", "c"), ["c", "k"]).select(F.col("p").alias("id"), "k").distinct()
            front = scratch.write(nxt.join(back, ["id", "k"], "left_anti"))
            if not front.take(1):
                break
            back = scratch.write(back.unionByName(front))
        more = back.join(back.groupBy("k").count().where("count > 1").select("k"), "k", "left_semi").select("id", F.col("k").alias("label"))
        found = scratch.write(more if found is None else found.unionByName(more))
        gone = back.select("id")
        e = scratch.write(e.join(gone.withColumnRenamed("id", "c"), "c", "left_anti").join(gone.withColumnRenamed("id", "p"), "p", "left_anti"))
    alone = loops.select("id", F.col("id").alias("label"))
    return alone if found is None else found.unionByName(alone.join(found.select("id"), "id", "left_anti"))


def _tree(nodes: DataFrame, e: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, up, depth, node) of the nodes a root reaches; ``up`` is null for roots."""
    at = Pointers(e.where("c <> p"), scratch, False)
    roots = nodes.join(e.select(F.col("c").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("depth"))
    depth = scratch.write(roots)
    hops = at.several.join(at.ends.select(F.col("id").alias("p"), "to", "dist"), "p", "left").join(at.loops.select(F.col("id").alias("p"), F.lit(1).alias("l")), "p", "left")
    ended = at.single.join(at.ends.select("id"), "id", "left_anti").select(F.col("id").alias("p"))  # in or below loops
    hops = scratch.write(hops.join(ended, "p", "left_anti").select("c", "p", F.coalesce("to", "p").alias("id"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist")))
    if hops.take(1):
        while True:  # least depths over nodes with several parents, until none falls
            new = hops.join(depth, "id").groupBy(F.col("c").alias("id")).agg(F.min(F.col("dist") + F.col("depth")).alias("new"))
            nxt = scratch.write(depth.join(new, "id", "full").select("id", F.least("depth", "new").alias("depth"), (F.col("depth").isNull() | (F.col("new") < F.col("depth"))).alias("changed")))
            if not nxt.where("changed").take(1):
                break
            depth = nxt.select("id", "depth")
    below = at.ends.join(depth.withColumnRenamed("id", "to"), "to").select("id", (F.col("depth") + F.col("dist")).alias("depth"))
    depth = scratch.write(depth.unionByName(below).join(nodes.select("id", "node"), "id"))
    one = at.single.select("id", F.col("to").alias("up"))
    several = at.several.select(F.col("c").alias("id"), F.col("p").alias("up"))
    over = several.join(depth.select(F.col("id").alias("up"), "depth", "node"), "up").groupBy("id").agg(F.min_by("up", F.struct("depth", "node")).alias("up"))
    return scratch.write(depth.join(one.unionByName(over), "id", "left").select("id", "up", "depth", "node"))


def _ranges(tree: DataFrame, scratch: Scratch, paths: bool) -> DataFrame:
    """(id, depth, path, root, lft, size) by doubling along the tree."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    rows = tree.select("id", "up", "depth", F.lit(1).cast("long").alias("size"), F.col("node").alias("root"), *([F.array("node").alias("path")] if paths else []))
    rows, ups, k = scratch.write(rows), [], 0
    while (1 << k) <= deepest:
        has = F.col("depth") >= (1 << k)  # those with a node 2**k levels up, whose pointer this is
        ups.append(rows.where(has).select("id", "up"))
        more = rows.where(has).groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        high = rows.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), *([F.col("path").alias("path2")] if paths else []))
        moved = rows.where(has).join(high, "up").select("id", F.col("up2").alias("up"), "depth", "size", F.col("root2").alias("root"), *([F.concat("path2", "path").alias("path")] if paths else []))
        rows = moved.unionByName(rows.where(~has)).join(more, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        rows = scratch.write(rows)
        k += 1
    sized = tree.where("up is not null").select("id", "up", "node").join(rows.select("id", "size"), "id")
    lft = prefix_sums(sized, ["up"], ["node", "id"], {"before": "size"}, scratch).select("id", (F.col("before") + 1).alias("lft"))
    lft = scratch.write(lft.unionByName(tree.where("up is null").select("id", F.lit(0).cast("long").alias("lft"))))
    for up in ups:
        high = lft.select(F.col("id").alias("up"), F.col("lft").alias("lft2"))
        lft = scratch.write(lft.join(up.join(high, "up").select("id", "lft2"), "id", "left").select("id", (F.col("lft") + F.coalesce("lft2", F.lit(0))).alias("lft")))
    return rows.drop("up").join(lft, "id")


def hierarchy(edges: DataFrame, scope: str, child: str, parent: str, paths: bool = True) -> DataFrame:
    """One row per node: scope, node, status, in_cycle, root, depth, path, lft, rgt, n_descendants (see the module's text).

    Without ``paths`` the column path is null: its size is the sum of all depths, which very deep trees may not want.
    """
    scratch = Scratch(edges.sparkSession)
    nodes, e = numbered(distinct_edges(edges, scope, child, parent), scratch)
    loops = strong(e, scratch, False).select("id", F.lit(True).alias("looped"))
    placed = _ranges(_tree(nodes, e, scratch), scratch, paths)
    out = nodes.join(placed, "id", "left").join(loops, "id", "left")
    cyclic = F.coalesce("looped", F.lit(False))
    status = F.when(cyclic, "cycle").when(F.col("root").isNotNull(), "tree").otherwise("below_cycle")
    path = F.col("path") if paths else F.lit(None).cast("array<string>")
    return out.select("scope", "node", status.alias("status"), cyclic.alias("in_cycle"), "root", "depth", path.alias("path"), "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants"))


def cycle_nodes(edges: DataFrame, scope: str, child: str, parent: str) -> DataFrame:
    """(scope, node) of the nodes reachable from themselves."""
    scratch = Scratch(edges.sparkSession)
    nodes, e = numbered(distinct_edges(edges, scope, child, parent), scratch)
    return nodes.join(strong(e, scratch, False).select("id"), "id", "left_semi").select("scope", "node")


def descendants(edges: DataFrame, scope: str, child: str, parent: str) -> DataFrame:
    """All (scope, ancestor, descendant) pairs along every parent link; a node in a loop is its own descendant.

    The nested-set ranges of ``hierarchy`` state the pairs along the tree without spelling them out. Here walks are
    doubled: what lies within 2**k links joined with what lies exactly 2**k links on, so that along a tree every pair is
    made once.
    """
    scratch = Scratch(edges.sparkSession)
    nodes, e = numbered(distinct_edges(edges, scope, child, parent), scratch)
    exact = scratch.write(e.select(F.col("p").alias("a"), F.col("c").alias("d")))
    within, n = exact, exact.count()
    while True:
        on = within.select("a", F.col("d").alias("m")).join(exact.select(F.col("a").alias("m"), "d"), "m").select("a", "d")
        within = scratch.write(within.unionByName(exact).unionByName(on).distinct())
        m = within.count()
        if m == n:
            break
        n = m
        exact = scratch.write(exact.select("a", F.col("d").alias("m")).join(exact.select(F.col("a").alias("m"), "d"), "m").select("a", "d").distinct())
    name = nodes.select(F.col("id").alias("a"), "scope", F.col("node").alias("ancestor"))
    below = nodes.select(F.col("id").alias("d"), F.col("node").alias("descendant"))
    return within.join(name, "a").join(below, "d").select("scope", "ancestor", "descendant")
