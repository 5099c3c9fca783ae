"""Queries pN_ over the test tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from codeloom.llm import credentials, mixing, packing, parsing, percentiles, pieces, provenance, similar, truncation
from codeloom.llm.tokens import n_tokens
from codeloom.session import registry, table

PERCENTILES = [0.5, 0.9, 0.95, 0.99]
#: The rank file of the public tokenizer that sizes are counted with.
VOCABULARY = os.environ.get("CODELOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
QUERIES, SQL, query = registry()


# 1: provenance

#: The company whose notices are no third party's.
OWN = ("Orrin Works",)


@query
def p1_found(spark, d):
    """Pushed rows that are not hand-written source."""
    files = table(spark, d, "sync_files").select("sync_id", provenance.reason_column(F.col("path"), F.col("content"), OWN).alias("reason"))
    return files.where("reason is not null").select("sync_id").distinct()


@query
def p1_reasons(spark, d):
    """How many rows of each workspace come out, and why."""
    files = table(spark, d, "sync_files").select("workspace_id", provenance.reason_column(F.col("path"), F.col("content"), OWN).alias("reason"))
    return files.groupBy("workspace_id", F.coalesce("reason", F.lit("hand_written")).alias("reason")).agg(F.count("*").alias("n"))


# 2: percentiles


@query
def p2_percentiles(spark, d):
    """Exact percentiles of every delivered row by radix selection."""
    return percentiles.exact_percentiles(table(spark, d, "call_records"), ["provider", "model"], "duration_ms", PERCENTILES)


_RANKED = """
WITH v AS (SELECT {keys}, duration_ms AS x FROM {source} WHERE duration_ms IS NOT NULL AND NOT isnan(duration_ms)),
r AS (SELECT {keys}, x, row_number() OVER (PARTITION BY {keys} ORDER BY x) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM v),
p AS (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS p)
SELECT {keys}, p, n, x + 0.0 AS value FROM r, p WHERE k = greatest(1, CAST(ceil(p * n) AS BIGINT))
"""
SQL["p2_percentiles"] = _RANKED.format(keys="provider, model", source="call_records")


@query
def p2_percentiles_by_call(spark, d):
    """The same over calls: of redelivered rows only the last received counts."""
    calls = percentiles.latest(table(spark, d, "call_records").select("call_id", "received_at", "provider", "model", "duration_ms"), "call_id", "received_at")
    return percentiles.exact_percentiles(calls, ["provider", "model"], "duration_ms", PERCENTILES)


SQL["p2_percentiles_by_call"] = _RANKED.format(keys="provider, model", source="(SELECT * FROM call_records QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY received_at DESC NULLS LAST) = 1)")


@query
def p2_daily_sketch(spark, d):
    """Mergeable sketches per day of call."""
    calls = table(spark, d, "call_records").withColumn("day", F.to_date("called_at"))
    return percentiles.sketch(calls, ["day", "provider", "model"], "duration_ms")


@query
def p2_combined_days(spark, d):
    """Percentiles per provider and model from the days' sketches added up, with the bounds of the error."""
    return percentiles.from_sketch(percentiles.combine(p2_daily_sketch(spark, d), ["provider", "model"]), ["provider", "model"], PERCENTILES)


@query
def p2_intervals(spark, d):
    """Whether the interval from the days' sketches holds the exact percentile, per group and rank, and is narrow enough."""
    exact = p2_percentiles(spark, d).select(F.col("provider").alias("_p"), F.col("model").alias("_m"), F.col("p").alias("_q"), F.col("value").alias("exact"))
    c = p2_combined_days(spark, d)
    both = c.join(exact, c["provider"].eqNullSafe(F.col("_p")) & c["model"].eqNullSafe(F.col("_m")) & (c["p"] == F.col("_q")))
    narrow = F.col("high") - F.col("low") <= F.abs("value") / 256 + 1e-300
    return both.select("provider", "model", "p", "n", ((F.col("low") <= F.col("exact")) & (F.col("exact") <= F.col("high"))).alias("holds"), narrow.alias("narrow"))


SQL["p2_intervals"] = f"SELECT provider, model, p, n, true AS holds, true AS narrow FROM ({SQL['p2_percentiles']})"


# 3: pieces


def _oversized(spark, d):
    return pieces.items(table(spark, d, "chunks"), table(spark, d, "sync_files"), table(spark, d, "size_limits"))


@query
def p3_found(spark, d):
    """Items that the splitter cut: those with a first piece."""
    return pieces.split_oversized(_oversized(spark, d), ["item_kind", "item_id"], "content", "max_chars", "overlap_chars", "text_kind").where("piece_no = 0").select("item_kind", "item_id").distinct()


SQL["p3_found"] = """
SELECT DISTINCT 'chunk' AS item_kind, faiss_id AS item_id FROM chunks c JOIN size_limits l ON l.item_kind = 'chunk' AND l.chunk_type = c.chunk_type WHERE length(content) > max_chars
UNION SELECT DISTINCT 'file', sync_id FROM sync_files, size_limits l WHERE l.item_kind = 'file' AND length(content) > max_chars
"""


@query
def p3_pieces(spark, d):
    """Every piece, in order, with its place in the text."""
    return pieces.split_oversized(_oversized(spark, d), ["item_kind", "item_id"], "content", "max_chars", "overlap_chars", "text_kind")


@query
def p3_rejoined(spark, d):
    """The texts put together again from their pieces less the overlap, and whether every piece keeps its limit."""
    p = p3_pieces(spark, d).withColumn("own", F.expr("substr(piece, cast(max(start + n_chars) over (partition by item_kind, item_id order by piece_no rows between unbounded preceding and 1 preceding) - start + 1 as int))"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", F.coalesce("own", "piece").alias("own")))), lambda x: x["own"]), "")
    return p.groupBy("item_kind", "item_id").agg(F.md5(text).alias("md5"))


SQL["p3_rejoined"] = """
SELECT 'chunk' AS item_kind, faiss_id AS item_id, md5(content) AS md5 FROM chunks c JOIN size_limits l ON l.item_kind = 'chunk' AND l.chunk_type = c.chunk_type WHERE length(content) > max_chars
UNION ALL SELECT 'file', sync_id, md5(content) FROM sync_files, size_limits l WHERE l.item_kind = 'file' AND length(content) > max_chars
"""


# 5: credentials


def _texts(spark, d):
    c = table(spark, d, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("faiss_id").alias("item_id"), "content")
    return c.unionByName(table(spark, d, "sync_files").select(F.lit("file").alias("item_kind"), F.col("sync_id").alias("item_id"), "content"))


@query
def p5_found(spark, d):
    """Lines that hold a credential."""
    return credentials.found_lines(_texts(spark, d), ["item_kind", "item_id"], "content").select("item_kind", "item_id", "line_no").distinct()


@query
def p5_masked(spark, d):
    """All contents with their credentials masked."""
    return _texts(spark, d).select("item_kind", "item_id", credentials.masked_column(F.col("content")).alias("content"))


# 6: parsing


def _checked(spark, d):
    return parsing.checked(table(spark, d, "sync_files"), table(spark, d, "files"), ["sync_id"], ["workspace_id", "path"])


@query
def p6_found(spark, d):
    """Pushed rows that do not parse in their language."""
    return _checked(spark, d).where("not valid").select("sync_id").distinct()


@query
def p6_errors(spark, d):
    """The first error of every row that does not parse."""
    return _checked(spark, d).where("not valid").select("sync_id", "workspace_id", "path", "language", "error_line")


@query
def p6_rates(spark, d):
    """Share of invalid rows per workspace and language."""
    return parsing.rates(_checked(spark, d), "workspace_id")


# 7: similar vectors

VECTORS = (("chunk", "chunks", "faiss_id", "embedding"), ("memory", "memories", "id", "embedding_vector"))


def _each(spark, d, fn):
    out = None
    for kind, name, row_id, vector in VECTORS:
        part = fn(table(spark, d, name), row_id, vector)
        part = part.select(F.lit(kind).alias("item_kind"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query
def p7_found(spark, d):
    """Pairs of rows whose vectors have a cosine similarity of at least 0.95."""
    return _each(spark, d, lambda t, i, v: similar.near_pairs(t, i, v, 0.95)).select("item_kind", "id_a", "id_b").distinct()


@query
def p7_links(spark, d):
    """Every row with its class of copies and the number of rows at least 0.95 similar, without spelling out pairs."""
    return _each(spark, d, lambda t, i, v: similar.links(t, i, v, 0.95))


def _pairs_sql(kind, name, row_id, vector):
    unit = f"SELECT {row_id} AS id, CAST({vector} AS DOUBLE[]) AS v FROM {name} WHERE len({vector}) = 64"
    return f"""SELECT DISTINCT '{kind}' AS item_kind, a.id AS id_a, b.id AS id_b FROM (SELECT id, list_transform(v, lambda x: x / n) AS u FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM ({unit})) WHERE n > 0) a
JOIN (SELECT id, list_transform(v, lambda x: x / n) AS u FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM ({unit})) WHERE n > 0) b ON a.id < b.id WHERE list_inner_product(a.u, b.u) >= 0.95"""


SQL["p7_found"] = " UNION ALL ".join(_pairs_sql(*x) for x in VECTORS)


@query
def p7_link_counts(spark, d):
    """The numbers of links alone."""
    return p7_links(spark, d).where("n_links > 0").select("item_kind", "id", "n_links")


SQL["p7_link_counts"] = f"SELECT item_kind, id, count(*) AS n_links FROM (SELECT item_kind, unnest([id_a, id_b]) AS id FROM ({SQL['p7_found']})) GROUP BY ALL"


@query
def p7_neighbours(spark, d):
    """The ten most similar rows of every row whose id is divisible by 100."""
    return _each(spark, d, lambda t, i, v: similar.neighbours(t, i, v, 10, "id % 100 = 0"))


@query
def p7_recall(spark, d):
    """How much of the true ten most similar vectors the search finds for these rows."""
    return _each(spark, d, lambda t, i, v: similar.recall(t, i, v, 10, "id % 100 = 0"))


# 8: packing


def _sized(spark, d, *cols):
    return table(spark, d, "documents").select("doc_id", *cols, n_tokens(F.col("text"), VOCABULARY).alias("n_tokens"))


@query
def p8_containers(spark, d):
    """Every document's container of each kind."""
    return packing.containers(_sized(spark, d), table(spark, d, "pack_sizes"), "doc_id", "n_tokens")[0]


@query
def p8_unused(spark, d):
    """Containers used, the least possible, and the share of space left unused, per kind."""
    return packing.containers(_sized(spark, d), table(spark, d, "pack_sizes"), "doc_id", "n_tokens")[1]


@query
def p8_checked(spark, d):
    """Per kind: documents placed, containers over their capacity, documents split though they fit, tokens lost."""
    docs = _sized(spark, d)
    items = packing.containers(docs, table(spark, d, "pack_sizes"), "doc_id", "n_tokens")[0]
    kind = ["container_kind", "capacity_tokens"]
    full = items.groupBy(*kind, "container_id").agg(F.sum("n_tokens").alias("t")).groupBy(*kind).agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("over_full"))
    per = items.groupBy(*kind, "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("t"))
    per = per.groupBy(*kind).agg(F.count("*").alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("split_though_fitting"), F.sum("t").alias("placed"))
    total = docs.agg(F.sum("n_tokens").alias("total"))
    return per.join(full, kind).join(F.broadcast(total)).select(*kind, "n_documents", "over_full", "split_though_fitting", (F.col("total") - F.col("placed")).alias("lost_tokens"))  # the total is one row


SQL["p8_checked"] = "SELECT DISTINCT container_kind, capacity_tokens, (SELECT count(*) FROM documents) AS n_documents, 0 AS over_full, 0 AS split_though_fitting, 0 AS lost_tokens FROM pack_sizes WHERE capacity_tokens > 0"


# 9: mixing


@query
def p9_mixture(spark, d):
    """The records of a mixture as large as all records, with the number of times each is used."""
    return mixing.mixture(_sized(spark, d, "source"), table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens")[0]


@query
def p9_shares(spark, d):
    """Target and reached shares per source."""
    return mixing.mixture(_sized(spark, d, "source"), table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens")[1]


@query
def p9_exact_shares(spark, d):
    """The same for the greatest mixture in which every source can give its share."""
    return mixing.mixture(_sized(spark, d, "source"), table(spark, d, "mix_targets"), "doc_id", "source", "n_tokens", extent="exact")[1]


@query
def p9_checked(spark, d):
    """Per target: records used more often than allowed, and whether the share of the largest exact mixture is reached within
    the size of one record."""
    docs, targets = _sized(spark, d, "source"), table(spark, d, "mix_targets")
    used, report = mixing.mixture(docs, targets, "doc_id", "source", "n_tokens", extent="exact")
    most = docs.agg(F.max("n_tokens").alias("most"))
    often = used.join(F.broadcast(targets.select("source", "max_repeats")), "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("too_often"))
    near = F.abs(F.col("tokens_used") - F.col("budget")) <= F.col("most")
    return report.join(often, "source", "left").join(F.broadcast(most)).select("source", "target_share", F.coalesce("too_often", F.lit(0)).alias("too_often"), near.alias("near"))  # targets are a fixed table, the greatest size is one row


SQL["p9_checked"] = "SELECT source, target_share, 0 AS too_often, true AS near FROM mix_targets"


# 10: truncation


def _scored(spark, d):
    return truncation.truncated(table(spark, d, "documents"), "doc_id", "text", "source")


@query
def p10_found(spark, d):
    """Documents whose text was cut."""
    return _scored(spark, d).where("is_cut").select("doc_id").distinct()


@query
def p10_rates(spark, d):
    """How often each source's texts are cut, and how many of these stop at a length typical of the source."""
    n, cut, lim = F.count("*").alias("n"), F.count_if("is_cut").alias("n_cut"), F.count_if(F.col("is_cut") & F.col("at_limit")).alias("n_cut_at_limit")
    return _scored(spark, d).groupBy("source").agg(n, cut, lim).withColumn("rate", F.round(F.col("n_cut") / F.col("n"), 6))
