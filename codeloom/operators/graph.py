"""Call-graph analytics over edges (scope, src, dst): src calls or extends dst.

Traversals are frontier loops: each level is one equi-join of the frontier with the edges and one anti-join with
what was seen, written to a scratch table, so plans stay small and no closure of the whole graph is made. Nodes compare
exactly within their scope; edges with a null end are left out; repeated edges count once where distinct neighbours do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.session import Scratch


def edges(df: DataFrame, scope: str, src: str, dst: str) -> DataFrame:
    """Distinct (scope, src, dst)."""
    return df.select(F.col(scope).alias("scope"), F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().distinct()


def _frontier(step: DataFrame, starts: DataFrame, depth: int, keep_start: bool) -> DataFrame:
    """(scope, way, start, node, level) along (scope, way, node, next) from (scope, way, start, node), at the least level."""
    scratch = Scratch(step.sparkSession)
    key = ["scope", "way", "node"]
    seen = scratch.write(starts.distinct().withColumn("level", F.lit(0).cast("long")))
    front, levels = seen, [seen]
    known = seen.where("level > 0") if keep_start else seen
    for n in range(1, depth + 1):
        nxt = front.select("start", *key).join(step, key).select("scope", "way", "start", F.col("next").alias("node")).distinct()
        new = scratch.write(nxt.join(known.select("start", *key), ["start", *key], "left_anti").withColumn("level", F.lit(n).cast("long")))
        if not new.take(1):
            break
        front = new
        levels.append(new)
        known = reduce(DataFrame.unionByName, levels[1:] if keep_start else levels)
    return reduce(DataFrame.unionByName, levels).where("level > 0")


def _steps(e: DataFrame, forward: bool, keep_start: bool) -> DataFrame:
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = e.select("scope", F.lit("ahead" if forward else "back").alias("way"), F.col(a).alias("node"), F.col(b).alias("next"))
    return step.where("node <> next" if not keep_start else "true").distinct()


def reach(e: DataFrame, starts: DataFrame, depth: int, forward: bool = True, keep_start: bool = False) -> DataFrame:
    """(scope, start, node, level) within ``depth`` hops, at the least level. ``forward`` follows src to dst.

    The start itself is left out, unless ``keep_start`` and a loop leads back to it.
    """
    front = starts.select("scope", F.lit("ahead" if forward else "back").alias("way"), F.col("node").alias("start"), "node")
    return _frontier(_steps(e, forward, keep_start), front, depth, keep_start).drop("way")


def hops(e: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(scope, way, start, node, level): what both ways ('ahead' from src to dst, 'back') reach, in one traversal."""
    ways = F.explode(F.array(F.lit("ahead"), F.lit("back"))).alias("way")
    front = starts.select("scope", ways, F.col("node").alias("start"), "node")
    return _frontier(_steps(e, True, False).unionByName(_steps(e, False, False)), front, depth, False)


def neighbours(e: DataFrame, starts: DataFrame) -> DataFrame:
    """(scope, node, direction, other): direct callers and callees."""
    s = starts.select("scope", "node").distinct()
    out = e.join(s.withColumnRenamed("node", "src"), ["scope", "src"], "left_semi").select("scope", F.col("src").alias("node"), F.lit("callee").alias("direction"), F.col("dst").alias("other"))
    into = e.join(s.withColumnRenamed("node", "dst"), ["scope", "dst"], "left_semi").select("scope", F.col("dst").alias("node"), F.lit("caller").alias("direction"), F.col("src").alias("other"))
    return out.unionByName(into).distinct()


def roots(e: DataFrame) -> DataFrame:
    """(scope, node): sources without callers."""
    return e.select("scope", F.col("src").alias("node")).distinct().join(e.select("scope", F.col("dst").alias("node")), ["scope", "node"], "left_anti")


#: Parts of names that mark entry points.
ENTRY_PARTS = ["main", "app", "create_app", "__init__", "__main__", "setup", "teardown", "conftest"]


def dead(e: DataFrame) -> DataFrame:
    """(scope, node) without callers that are neither entry points (by a part of the name) nor tests."""
    low = F.lower("node")
    named = reduce(lambda x, y: x | y, [low.contains(p) for p in ENTRY_PARTS])
    return roots(e).where(~named & ~low.startswith("test_"))


def impact(e: DataFrame, files: DataFrame, starts: DataFrame, depth: int = 2, found: DataFrame | None = None) -> DataFrame:
    """One row per start: affected (reached forward), dependents (reached backward), files (of edges that touch any of
    these or the start) and blast radius (affected and dependents together).

    ``files``: (scope, src, dst, path). The touch of either end is two semi joins, not one join on a disjunction.
    ``found``: hops of at least this depth, if they are there already.
    """
    found = (hops(e, starts, depth) if found is None else found).where(F.col("level") <= depth)
    ahead = found.where("way = 'ahead'").select("scope", "start", "node")
    back = found.where("way = 'back'").select("scope", "start", "node")
    own = starts.select("scope", F.col("node").alias("start"), "node").distinct()
    every = ahead.unionByName(back).unionByName(own).distinct()
    touched = every.join(files.select("scope", F.col("src").alias("node"), "path"), ["scope", "node"]).unionByName(every.join(files.select("scope", F.col("dst").alias("node"), "path"), ["scope", "node"]))
    n_files = touched.groupBy("scope", "start").agg(F.countDistinct("path").alias("files"))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("scope", "start").agg(F.countDistinct("node").alias(name))

    out = own.select("scope", "start")
    for part in (count(ahead, "affected"), count(back, "dependents"), count(ahead.unionByName(back), "blast_radius"), n_files):
        out = out.join(part, ["scope", "start"], "left")
    return out.na.fill(0)


def member_impact(calls: DataFrame, members: DataFrame, scope: str, most: int = 3) -> DataFrame:
    """(scope, owner, members, calls, called_by): of every class its members, the other names that these call and the callables
    outside it that call one of them. A member's name that more than ``most`` classes of the scope declare is too
    ambiguous to follow callers by.
    """
    m = members.select(F.col(scope).alias("scope"), "owner", "member").distinct()
    e = calls.select(F.col(scope).alias("scope"), "caller", "callee").distinct()
    clear = m.groupBy("scope", "member").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("scope", "member")
    own = m.select("scope", "owner", F.col("member").alias("other"))
    ahead = m.join(e.withColumnRenamed("caller", "member"), ["scope", "member"]).select("scope", "owner", F.col("callee").alias("other")).join(own, ["scope", "owner", "other"], "left_anti")
    back = m.join(clear, ["scope", "member"]).join(e.withColumnRenamed("callee", "member"), ["scope", "member"]).select("scope", "owner", F.col("caller").alias("other")).join(own, ["scope", "owner", "other"], "left_anti")
    out = m.groupBy("scope", "owner").agg(F.count("*").alias("members"))
    for rows, name in ((ahead, "calls"), (back, "called_by")):
        out = out.join(rows.groupBy("scope", "owner").agg(F.countDistinct("other").alias(name)), ["scope", "owner"], "left")
    return out.na.fill(0, ["calls", "called_by"])


def entry_points(e: DataFrame, starts: DataFrame, depth: int = 20) -> DataFrame:
    """(scope, start, node): roots that reach the start within ``depth`` hops."""
    return reach(e, starts, depth, forward=False).join(roots(e), ["scope", "node"], "left_semi").select("scope", "start", "node")


def related_tests(e: DataFrame, files: DataFrame, starts: DataFrame, depth: int = 3, found: DataFrame | None = None) -> DataFrame:
    """(scope, start, path): test files that call the start or one of its callers within ``depth`` hops."""
    back = reach(e, starts, depth, forward=False) if found is None else found.where((F.col("way") == "back") & (F.col("level") <= depth))
    near = back.select("scope", "start", "node").unionByName(starts.select("scope", F.col("node").alias("start"), "node")).distinct()
    t = files.where(T.is_test_path("path"))
    out = near.join(t.select("scope", F.col("src").alias("node"), "path"), ["scope", "node"]).unionByName(near.join(t.select("scope", F.col("dst").alias("node"), "path"), ["scope", "node"]))
    return out.select("scope", "start", "path").distinct()


def name_key(name: Column) -> Column:
    """A name without case, underscores and hyphens."""
    return F.lower(F.translate(name, "_-", ""))


def tests_by_name(nodes: DataFrame, files: DataFrame, scope: str, path: str) -> DataFrame:
    """(scope, node, path): test files named after a node, but for the mark of a test; an equi-join on the bare name."""
    stem = F.regexp_replace(T.basename(F.col(path)), r"\.[^.]*(?:\.[^.]*)?$", "")
    key = F.regexp_replace(name_key(stem), r"^tests?|(?:tests?|spec)$", "")
    t = files.where(T.is_test_path(path)).select(F.col(scope).alias("scope"), F.col(path).alias("path"), key.alias("_k")).where("_k <> ''")
    return nodes.select("scope", "node", name_key(F.col("node")).alias("_k")).join(t, ["scope", "_k"]).select("scope", "node", "path").distinct()


def code_graph(rows: DataFrame, scope: str, src: str, dst: str, path: str, depth: int = 3) -> DataFrame:
    """(scope, from_dir, to_dir, edges, names): edges between directories, cut at a depth, of an edge's own file and the file
    where its other end is declared, the first by name; ends declared nowhere lead to a null directory."""
    d = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, F.least(F.lit(depth), F.size(F.split(c, "/")) - 1)), "/")
    e = rows.select(F.col(scope).alias("scope"), F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(path).alias("path")).dropna().distinct()
    home = e.groupBy("scope", F.col("src").alias("dst")).agg(F.min("path").alias("home"))
    x = e.join(home, ["scope", "dst"], "left").select("scope", d(F.col("path")).alias("from_dir"), F.when(F.col("home").isNotNull(), d(F.col("home"))).alias("to_dir"), "dst")
    return x.groupBy("scope", "from_dir", "to_dir").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("names"))


def risk(impact_rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Impact rows with n_tests, risk_score (0..7) and risk: more callers, files and fewer tests are riskier."""
    n = tests.groupBy("scope", "start").agg(F.countDistinct("path").alias("n_tests"))
    x = impact_rows.join(n, ["scope", "start"], "left").na.fill(0, ["n_tests"])
    callers = F.when(F.col("dependents") > 10, 3).when(F.col("dependents") > 3, 2).when(F.col("dependents") > 0, 1).otherwise(0)
    spread = F.when(F.col("files") > 5, 2).when(F.col("files") > 2, 1).otherwise(0)
    untested = F.when(F.col("n_tests") == 0, 2).when(F.col("n_tests") < 2, 1).otherwise(0)
    x = x.withColumn("risk_score", (callers + spread + untested).cast("long"))
    return x.withColumn("risk", F.when(F.col("risk_score") >= 5, "high").when(F.col("risk_score") >= 3, "medium").otherwise("low"))


def traversable(definitions: DataFrame, scope: str, name: str, path: str, most: int = 3) -> DataFrame:
    """(scope, name) defined in one to ``most`` paths; others are too ambiguous to follow."""
    return definitions.groupBy(F.col(scope).alias("scope"), F.col(name).alias("name")).agg(F.countDistinct(path).alias("paths")).where(F.col("paths") <= most).select("scope", "name")


def stats(df: DataFrame, scope: str, src: str, dst: str, path: str) -> DataFrame:
    """Edges, distinct ends and files per scope."""
    return df.groupBy(scope).agg(F.count("*").alias("edges"), F.countDistinct(src).alias("callers"), F.countDistinct(dst).alias("callees"), F.countDistinct(path).alias("files"))


def replace_files(old: DataFrame, new: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Edges after an incremental update: those of changed and removed files give way to the new ones."""
    gone = new.select(*keys).distinct().unionByName(removed.select(*keys).distinct())
    return old.join(gone, keys, "left_anti").unionByName(new)


def upsert_references(old: DataFrame, new: DataFrame, keys: list[str], revision: str, confidence: str) -> DataFrame:
    """One row per key: the greatest revision, then confidence, wins."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(revision), F.lit(-1)), F.coalesce(F.col(confidence), F.lit(-1.0)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest]))
    return both.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def top_rows(df: DataFrame, part: list[str], confidence: str, order: list[str], most: int = 100) -> DataFrame:
    """The first rows of each part by falling confidence, then ``order``."""
    by = ", ".join([f"`{confidence}` desc nulls last", *[f"`{c}`" for c in order]])
    r = F.expr(f"row_number() over (partition by {', '.join(f'`{p}`' for p in part)} order by {by})")
    return df.withColumn("_n", r).where(F.col("_n") <= most).drop("_n")


def ascii_graph(e: DataFrame, per_node: int = 8) -> DataFrame:
    """(scope, src, rendered): a node with its first callees."""
    x = e.withColumn("_n", F.expr("row_number() over (partition by scope, src order by dst)")).where(F.col("_n") <= per_node + 1)
    names = F.array_sort(F.collect_list(F.when(F.col("_n") <= per_node, F.col("dst"))))
    return x.groupBy("scope", "src").agg(F.concat(F.col("src"), F.lit(" -> "), F.array_join(names, ", "), F.when(F.max("_n") > per_node, ", ...").otherwise("")).alias("rendered"))
