"""Memory store: fingerprints, merging of repeats, hybrid ranking, statistics, listings and advice.

Times are compared with an explicit ``as_of``, never with the clock. Null lists count as empty, null texts as "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T


def list_column(json: str) -> Column:
    """A JSON list of strings as an array; null and broken JSON give an empty one."""
    return F.coalesce(F.from_json(F.col(json), "array<string>"), F.array().cast("array<string>"))


def parsed(df: DataFrame) -> DataFrame:
    """``df`` with tags and related_files as arrays."""
    return df.withColumn("tags", list_column("tags_json")).withColumn("files", list_column("related_files_json"))


def dedupe(df: DataFrame, row_id: str = "id") -> DataFrame:
    """One row per category and normalised content: least id, number merged, summed accesses, greatest importance, verified
    if any is, and tags and files in first-seen order by id."""
    x = parsed(df).withColumn("fp", T.fingerprint("category", "content"))

    def ordered(col: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(F.col(row_id), F.col(col))))
        return F.array_distinct(F.flatten(F.transform(rows, lambda r: r[col])))

    return x.groupBy("fp").agg(
        F.min(row_id).alias(row_id), F.count("*").alias("merged"), F.sum(F.coalesce("access_count", F.lit(0))).alias("access_count"), F.max("importance").alias("importance"),
        F.coalesce(F.bool_or("verified"), F.lit(False)).alias("verified"), ordered("tags").alias("tags"), ordered("files").alias("files"),
    )


def rank(df: DataFrame, query: str, vector: list[float] | None = None, min_score: float = 0.3, limit: int = 20, row_id: str = "id") -> DataFrame:
    """Rows by keyword and vector score: share of words in the content, matching tags, category 0.4, subcategory 0.3 and
    files 0.5 over 1.5 (at most 1); with a vector, plus 0.3 of its cosine, or 0.7 of it if no word matches."""
    import re

    words = [w for w in re.split(r"[^\w一-鿿]+", query.lower()) if len(w) >= 2]
    if not words:
        return df.limit(0).select(row_id, F.lit(0.0).alias("score"), F.lit(0.0).alias("keyword_score"), F.lit(0.0).alias("semantic_score"))
    ws = F.array(*[F.lit(w) for w in words])

    def hits(text: Column) -> Column:
        t = F.lower(F.coalesce(text, F.lit("")))
        return F.size(F.filter(ws, lambda w: t.contains(w))).cast("double")

    tags = F.transform(F.col("tags"), lambda t: F.lower(F.coalesce(t, F.lit(""))))
    in_content = hits(F.col("content")) / len(words)
    in_tags = F.least(F.lit(1.0), F.size(F.array_intersect(F.array_distinct(ws), tags)) / len(words))
    in_files = F.when(F.exists("files", lambda f: F.exists(ws, lambda w: F.lower(f).contains(w))), 0.5).otherwise(0.0)
    total = in_content + in_tags + F.when(hits(F.col("category")) > 0, 0.4).otherwise(0.0) + F.when(hits(F.col("subcategory")) > 0, 0.3).otherwise(0.0) + in_files
    x = parsed(df).withColumn("keyword_score", F.least(F.lit(1.0), total / 1.5))
    sem = F.lit(0.0)
    if vector is not None:
        n = sum(v * v for v in vector) ** 0.5
        same = F.size("embedding_vector") == len(vector)
        sem = F.when(same, F.coalesce(F.greatest(F.lit(0.0), T.dot(T.unit_vector("embedding_vector"), F.array(*[F.lit(v / n) for v in vector]))), F.lit(0.0))).otherwise(0.0) if n else sem
    x = x.withColumn("semantic_score", F.coalesce(sem, F.lit(0.0)))
    k, s = F.col("keyword_score"), F.col("semantic_score")
    score = F.when((k > 0) & (s > 0), F.least(F.lit(1.0), k + 0.3 * s)).otherwise(F.greatest(k, 0.7 * s))
    x = x.withColumn("score", F.round(score, 4)).where(((k > 0) | (s > 0)) & (F.col("score") >= min_score))
    return x.select(row_id, "score", F.round("keyword_score", 4).alias("keyword_score"), F.round("semantic_score", 4).alias("semantic_score")).orderBy(F.desc("score"), row_id).limit(limit)


def stats(df: DataFrame, as_of: str) -> DataFrame:
    """(section, key, n) in one pass: totals, by category and importance, of the last week, verified, archived."""
    active = F.col("status") == "active"
    recent = active & (F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr("interval 7 days"))

    def pair(when: Column, section: str, key: Column) -> Column:
        return F.when(when, F.struct(F.lit(section).alias("section"), key.alias("key")))

    none = F.lit("")
    pairs = F.array(
        pair(active, "total", none), pair(active, "category", F.coalesce("category", none)), pair(active, "importance", F.coalesce(F.col("importance").cast("string"), none)),
        pair(recent, "recent", none), pair(active & F.col("verified"), "verified", none), pair(F.col("status") == "archived", "archived", none),
    )
    return df.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).groupBy("p.section", "p.key").agg(F.count("*").alias("n"))


def select(df: DataFrame, status: str | None = "active", category: str | None = None, subcategory: str | None = None, min_importance: int | None = None, since: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Rows that meet every given condition; tags meet if any is shared without case."""
    x = df
    for col, value in (("status", status), ("category", category), ("subcategory", subcategory)):
        if value is not None:
            x = x.where(F.col(col) == value)
    if min_importance is not None:
        x = x.where(F.col("importance") >= min_importance)
    if since is not None:
        x = x.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if tags:
        x = x.where(F.arrays_overlap(F.transform(list_column("tags_json"), F.lower), F.array(*[F.lit(t.lower()) for t in tags])))
    return x


def listing(df: DataFrame, by: str, descending: bool = True, offset: int = 0, limit: int = 50, row_id: str = "id") -> DataFrame:
    """A page: sorted, then offset, then limited."""
    key = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return df.orderBy(key, row_id).offset(offset).limit(limit)


def context_summary(df: DataFrame, as_of: str) -> DataFrame:
    """Four reports in one: recent progress, important learnings, preferences, recent mistakes; newest first."""
    now = F.lit(as_of).cast("timestamp")
    c, i, t = F.col("category"), F.col("importance"), F.col("created_at")
    section = (
        F.when((c == "progress") & (t >= now - F.expr("interval 30 days")), "recent_progress").when((c == "learning") & (i >= 4), "key_learnings").when(c == "preference", "user_preferences")
        .when((c == "mistake") & (i >= 3) & (t >= now - F.expr("interval 60 days")), "important_warnings")
    )
    x = select(df).withColumn("section", section).where("section is not null")
    x = x.withColumn("rank", F.expr("row_number() over (partition by section order by created_at desc, id)").cast("long"))
    return x.where(F.col("rank") <= F.when(F.col("section") == "user_preferences", 10).otherwise(5)).select("section", "rank", "id")


def advisory(df: DataFrame, angles: list[str], top: int = 5, budget: int = 3200) -> DataFrame:
    """Best memories over at most five queries of three hits each: rank, id, line, while the lines fit the budget."""
    got = None
    for n, q in enumerate(angles[:5]):
        part = rank(select(df), q, limit=3).withColumn("angle", F.lit(n))
        got = part if got is None else got.unionByName(part)
    if got is None:
        return df.limit(0).select(F.lit(0).cast("long").alias("rank"), "id", F.lit("").alias("line"), F.lit(0.0).alias("confidence"))
    first = got.groupBy("id").agg(F.min_by(F.struct("score"), "angle").alias("s")).select("id", F.col("s.score").alias("score"))
    x = first.join(df.select("id", "category", "content"), "id").withColumn("rank", F.expr("row_number() over (order by score desc, id)").cast("long")).where(F.col("rank") <= top)  # at most 15 rows
    body = F.trim(F.coalesce("content", F.lit("")))
    body = F.when(F.length(body) > 200, F.concat(F.substring(body, 1, 197), F.lit("..."))).otherwise(body)
    x = x.withColumn("line", F.concat(F.col("rank").cast("string"), F.lit(". ["), "category", F.lit("] "), body))
    x = x.withColumn("_used", F.expr("sum(length(line)) over (order by rank)")).withColumn("confidence", F.round(F.least(F.lit(1.0), F.expr("max(score) over ()") * 1.2), 3))
    return x.where(F.col("_used") <= budget).select("rank", "id", "line", "confidence")


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store-or-bump: a new memory whose fingerprint is stored adds to its access count and may raise its importance;
    others are added, one per fingerprint. Columns: fp, id, category, content, importance, access_count."""
    cols = ["id", "category", "content", "importance", "access_count"]
    a = store.select(T.fingerprint("category", "content").alias("fp"), *cols, F.lit(0).alias("_new"))
    b = new.select(T.fingerprint("category", "content").alias("fp"), *cols, F.lit(1).alias("_new"))
    first = F.min_by(F.struct("id", "category", "content"), F.struct("_new", "id"))
    return a.unionByName(b).groupBy("fp").agg(first.alias("r"), F.max("importance").alias("importance"), (F.sum(F.when(F.col("_new") == 0, F.coalesce("access_count", F.lit(0))).otherwise(F.lit(1))) - F.min("_new")).alias("access_count")).select("fp", "r.*", "importance", "access_count")


def update(store: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Partial update by id: given values replace stored ones; the fingerprint follows."""
    c = changes.select("id", *[F.col(x).alias(f"_n_{x}") for x in columns])
    x = store.join(c, "id", "left")
    for name in columns:
        x = x.withColumn(name, F.coalesce(f"_n_{name}", name))
    return x.drop(*[f"_n_{n}" for n in columns]).withColumn("content_fingerprint", T.fingerprint("category", "content"))


def skill_search(skills: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Skills by words shared with the query: name 10, each name word 4, keyword 3, description word 1, use case 2; if none
    scores, all by name with 0. Columns: name, keywords, description, when_to_use."""
    words = F.array_distinct(T.query_words(F.lit(query)))

    def shared(text: Column) -> Column:
        return F.size(F.array_intersect(words, T.query_words(F.coalesce(text, F.lit("")))))

    name = F.lower("name")
    score = F.when(F.lit(query.lower()).contains(name), 10).otherwise(0) + 4 * shared(F.translate("name", "-_", "  ")) + 3 * F.size(F.array_intersect(words, F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower))) + shared(F.col("description")) + 2 * shared(F.col("when_to_use"))
    x = skills.withColumn("score", score.cast("long"))
    best = F.expr("max(score) over ()")  # skills are a short catalogue
    return x.withColumn("_b", best).where((F.col("score") > 0) | (F.col("_b") == 0)).orderBy(F.desc("score"), "name").limit(limit).select("name", "score")
