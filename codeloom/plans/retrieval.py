"""Queries of line, symbol and vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import graph, symbols, text, vector
from codeloom.plans.base import DOC_LINES, KEYS, LINES, SNAP, SQL, doc_lines, file_lines, query, snapshot
from codeloom.session import table

# Lines


@query
def line_count_by_doc(spark, d):
    return doc_lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"))


SQL["line_count_by_doc"] = f"WITH {DOC_LINES} SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest FROM lines GROUP BY doc_id"


@query
def grep_lines(spark, d):
    """Ranked hits of a word with two lines of context."""
    out = text.grep(table(spark, d, "documents"), ["doc_id"], "text", "snapshot", limit=50)
    return out.select("doc_id", "line_no", "line", "start", "stop", "penalty", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


SQL["grep_lines"] = f"""WITH {DOC_LINES},
ctx AS (SELECT *, coalesce(array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)), '') AS before,
  coalesce(array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), chr(10)), '') AS after FROM lines),
hit AS (SELECT *, instr(lower(line), 'snapshot') - 1 AS start FROM ctx WHERE instr(lower(line), 'snapshot') > 0),
pen AS (SELECT *, start + 8 AS stop, CASE WHEN (start = 0 OR NOT regexp_matches(substr(line, start, 1), '^[\\p{{L}}\\p{{N}}_]')) AND (start + 8 >= length(line) OR NOT regexp_matches(substr(line, start + 9, 1), '^[\\p{{L}}\\p{{N}}_]')) THEN 0 ELSE 1 END AS penalty FROM hit)
SELECT doc_id, line_no, line, start, stop, penalty, before, after FROM pen ORDER BY penalty, length(line), doc_id, line_no LIMIT 50"""


@query
def grep_all_files(spark, d):
    """Every matching line of the snapshot, case kept, without a limit."""
    hits = text.grep(snapshot(spark, d), KEYS, "content", "TODO", case_sensitive=True, context=0, limit=None)
    return hits.select(*KEYS, "line_no", "start", "stop")


SQL["grep_all_files"] = f"WITH {LINES} SELECT workspace_id, path, line_no, instr(line, 'TODO') - 1 AS start, instr(line, 'TODO') + 3 AS stop FROM lines WHERE instr(line, 'TODO') > 0"


@query
def regex_grep(spark, d):
    """lines that match a pattern, with its span."""
    hits = text.matches(file_lines(spark, d), r"except\s+[A-Z]\w+Error", regex=True, case_sensitive=True)
    return hits.select(*KEYS, "line_no", "start", "stop")


SQL["regex_grep"] = f"""WITH {LINES}, hit AS (SELECT *, regexp_extract(line, 'except\\s+[A-Z]\\w+Error') AS m FROM lines WHERE regexp_matches(line, 'except\\s+[A-Z]\\w+Error'))
SELECT workspace_id, path, line_no, instr(line, m) - 1 AS start, instr(line, m) - 1 + length(m) AS stop FROM hit"""


@query
def grep_merge_adjacent(spark, d):
    """Hits whose context of two lines touches become one island."""
    hits = text.matches(doc_lines(spark, d), "the")
    return text.merged(hits, ["doc_id"], 2)


SQL["grep_merge_adjacent"] = f"""WITH {DOC_LINES}, h AS (SELECT doc_id, line_no, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) <= 4 THEN 0 ELSE 1 END AS fresh FROM lines WHERE instr(lower(line), 'the') > 0),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM h)
SELECT doc_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_hits FROM i GROUP BY doc_id, island"""


@query
def token_overlap(spark, d):
    """Lines with at least two of three words."""
    out = text.token_overlap(snapshot(spark, d), KEYS, "content", ["cursor", "class", "batch"], "path", limit=50)
    return out.select(*KEYS, "line_no", F.array_join("matched", ",").alias("matched"), "score")


SQL["token_overlap"] = f"""WITH {LINES}, s AS (SELECT *, list_filter(['cursor', 'class', 'batch'], lambda t: instr(lower(line), t) > 0) AS m FROM lines)
SELECT workspace_id, path, line_no, array_to_string(m, ',') AS matched, len(m) + CASE WHEN regexp_matches(ltrim(line), '^(class |def |async def )') THEN 1.5 ELSE 0.0 END AS score
FROM s WHERE len(m) >= 2 ORDER BY score DESC, CASE WHEN path LIKE 'tests/%' OR path LIKE 'docs/%' THEN 1 ELSE 0 END, workspace_id, path, line_no LIMIT 50"""


@query
def line_slice(spark, d):
    """Lines 3 to 5 of every file, with rendered numbers (read by range)."""
    x = file_lines(spark, d).where("line_no between 3 and 5")
    return x.select(*KEYS, "line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 4, " "), F.lit(" | "), "line").alias("rendered"))


SQL["line_slice"] = f"WITH {LINES} SELECT workspace_id, path, line_no, lpad(CAST(line_no AS VARCHAR), 4, ' ') || ' | ' || line AS rendered FROM lines WHERE line_no BETWEEN 3 AND 5"


@query
def markdown_outline(spark, d):
    """Headings of every document with their nearest heading above."""
    return text.outline(doc_lines(spark, d), ["doc_id"])


SQL["markdown_outline"] = f"""WITH {DOC_LINES}, f AS (SELECT *, sum(CASE WHEN ltrim(line) LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 AS open, length(regexp_extract(line, '^(#{{1,6}})\\s+\\S', 1)) AS level FROM lines),
h AS (SELECT doc_id, line_no, level, trim(regexp_replace(line, '^#{{1,6}}\\s+', '')) AS title FROM f WHERE level > 0 AND open = 0),
p AS (SELECT a.doc_id, a.line_no, a.level, a.title, b.title AS parent, row_number() OVER (PARTITION BY a.doc_id, a.line_no ORDER BY b.line_no DESC) AS rn FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND b.level < a.level)
SELECT doc_id, line_no, level, title, parent FROM p WHERE rn = 1"""


# Paths (F1-F4, F11, F13-F15, X27, X28)


@query
def path_predicates(spark, d):
    """Globs, test paths, built paths, canonical paths, languages and sizes of every file."""
    p = table(spark, d, "files").select(*KEYS, "size").distinct()
    return p.select(
        *KEYS, "size", T.matches_glob("path", ["*_p*.py", "src/*.go"]).alias("glob_a"), T.matches_either("path", ["src/*", "*.ts"]).alias("glob_b"), T.is_test_path("path").alias("is_test"), T.is_test_like("path").alias("is_test_like"),
        T.is_built_path("path").alias("is_built"), T.normal_path(F.concat(F.lit("./"), F.col("path"))).alias("key"), T.language("path").alias("language"), T.format_size("size").alias("shown"),
    )


_TEST_LIKE = "regexp_matches('/' || lower(path) || '/', '/tests?/') OR instr(lower(path), 'src/test') > 0 OR regexp_matches(lower(string_split(path, '/')[-1]), '^test_|^tests?\\.py$|(_tests?\\.py|tests?\\.java|tests?\\.scala|\\.(spec|test)\\.[jt]s)$')"
SQL["path_predicates"] = f"""SELECT DISTINCT workspace_id, path, size,
regexp_matches(string_split(path, '/')[-1], '^.*_p.*\\.py$') OR regexp_matches(path, '^src/.*\\.go$') AS glob_a,
regexp_matches(path, '^src/.*$') OR regexp_matches(string_split(path, '/')[-1], '^.*\\.ts$') AS glob_b,
regexp_matches('/' || lower(path) || '/', '/tests?/') OR regexp_matches(lower(string_split(path, '/')[-1]), '^test_|(_tests?\\.py|tests?\\.java|tests?\\.scala|spec\\.scala)$') AS is_test,
{_TEST_LIKE} AS is_test_like,
regexp_matches(lower(path), '/static/|/vendors?/|/node_modules/|/dist/|/build/|jquery') AS is_built, path AS key,
CASE regexp_extract(lower(string_split(path, '/')[-1]), '^.+\\.([^.]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'c' THEN 'cpp' WHEN 'h' THEN 'cpp' WHEN 'json' THEN 'json' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'toml' THEN 'toml' WHEN 'sh' THEN 'shell' ELSE 'text' END AS language,
CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' WHEN size < 1048576 THEN printf('%.1f', size / 1024.0) || ' KB' ELSE printf('%.1f', size / 1048576.0) || ' MB' END AS shown FROM files"""


@query
def content_filter(spark, d):
    """chunks that contain a phrase literally, and whether they look binary."""
    c = table(spark, d, "chunks")
    return c.where(T.contains_ci("content", "max_tokens = ")).select("faiss_id", T.looks_binary("content").alias("binary"))


SQL["content_filter"] = "SELECT faiss_id, instr(substr(content, 1, 4096), chr(0)) > 0 AS binary FROM chunks WHERE instr(lower(content), 'max_tokens = ') > 0"

# Symbols

_SYMBOL = r"^(\s*)(?:(?:public|private|protected|static|final|abstract|sealed|case|open|override|implicit|lazy)\s+)*(class|trait|object|interface|enum|def|async\s+def|function|func)\s+([A-Za-z_][A-Za-z0-9_]*)\b"
def _forms_sql():
    """The first form of a line as a CASE of structs, from the same patterns."""
    kind = f"regexp_replace(regexp_extract(line, '{_SYMBOL}', 2), '\\s+', ' ', 'g')"
    out = [f"CASE WHEN regexp_extract(line, '{_SYMBOL}', 3) <> '' THEN {{'name': regexp_extract(line, '{_SYMBOL}', 3), 'kind': {kind}}} END"]
    words = ", ".join(f"'{w}'" for w in symbols.STATEMENTS)
    for suffixes, pattern, what, at in symbols.FORMS:
        name = f"regexp_extract(line, '{pattern}', {at})"
        kind = f"regexp_extract(line, '{pattern}', {what})" if isinstance(what, int) else f"'{what}'"
        out.append(f"CASE WHEN suffix IN ({', '.join(repr(x) for x in suffixes)}) AND {name} <> '' AND {name} NOT IN ({words}) THEN {{'name': {name}, 'kind': {kind}}} END")
    return f"coalesce({', '.join(out)})"


SYMBOLS = LINES + f""", declared AS (SELECT *, {_forms_sql()} AS d FROM (SELECT *, lower(split_part(path, '.', -1)) AS suffix FROM lines)),
symbols AS (SELECT workspace_id, path, d.name AS name, d.kind AS kind, line_no AS line_start, substr(trim(line, ' ' || chr(9) || chr(13)), 1, 200) AS signature FROM declared WHERE d IS NOT NULL)"""


def file_symbols(spark, d):
    return symbols.symbols(file_lines(spark, d), KEYS)


@query
def symbol_extract(spark, d):
    """Every declared symbol of the snapshot."""
    return file_symbols(spark, d).drop("signature")


SQL["symbol_extract"] = f"WITH {SYMBOLS} SELECT workspace_id, path, name, kind, line_start FROM symbols"


@query
def symbol_tiers(spark, d):
    """Prefix and contained names; an exact one would end the search."""
    return symbols.search(file_symbols(spark, d), "Cursor", "path", limit=20).select(*KEYS, "name", "kind", "line_start", "score")


_TIER = "CASE WHEN lower(name) = '{q}' THEN 1.0 WHEN starts_with(lower(name), '{q}') THEN 0.9 WHEN instr(lower(name), '{q}') > 0 THEN 0.7 END"
SQL["symbol_tiers"] = f"""WITH {SYMBOLS}, s AS (SELECT *, CAST({_TIER.format(q='cursor')} AS DOUBLE) AS score FROM symbols)
SELECT workspace_id, path, name, kind, line_start, score FROM s WHERE score >= 0.5 AND ((SELECT max(score) FROM s) < 1.0 OR score = 1.0)
ORDER BY score DESC, name = 'Cursor' DESC, kind = 'class' DESC, lower(name), path, line_start LIMIT 20"""


@query
def symbol_kinds(spark, d):
    """classes alone, by prefix and contained name."""
    return symbols.search(file_symbols(spark, d), "View", "path", kind="class", limit=30).select(*KEYS, "name", "kind", "line_start", "score")


SQL["symbol_kinds"] = f"""WITH {SYMBOLS}, s AS (SELECT *, CAST({_TIER.format(q='view')} AS DOUBLE) AS score FROM symbols WHERE kind = 'class')
SELECT workspace_id, path, name, kind, line_start, score FROM s WHERE score >= 0.5 AND ((SELECT max(score) FROM s) < 1.0 OR score = 1.0)
ORDER BY score DESC, name = 'View' DESC, lower(name), path, line_start LIMIT 30"""


@query
def relevant_chunks(spark, d):
    """Of every file the three chunks that hold most of a question's words."""
    return text.relevant(table(spark, d, "chunks"), ["workspace_id", "file_path"], "faiss_id", "content", ["cursor", "batch", "index", "retry"])


SQL["relevant_chunks"] = """WITH s AS (SELECT workspace_id, file_path, faiss_id, CAST((instr(lower(content), 'cursor') > 0)::INT + (instr(lower(content), 'batch') > 0)::INT + (instr(lower(content), 'index') > 0)::INT + (instr(lower(content), 'retry') > 0)::INT AS BIGINT) AS score FROM chunks)
SELECT *, row_number() OVER (PARTITION BY workspace_id, file_path ORDER BY score DESC, faiss_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 3"""


@query
def symbol_fuzzy(spark, d):
    """Tiers and edit similarity over chunk symbols."""
    c = table(spark, d, "chunks").select("faiss_id", F.get_json_object("metadata", "$.symbol_name").alias("name")).where("name is not null")
    first = c.orderBy("faiss_id").first()
    s = c.withColumn("score", F.round(symbols.fuzzy_score(F.col("name"), first["name"] if first else ""), 6)).where("score >= 0.5")
    return s.orderBy(F.desc("score"), "name", "faiss_id").limit(50)


SQL["symbol_fuzzy"] = """WITH c AS (SELECT faiss_id, json_extract_string(metadata, '$.symbol_name') AS name FROM chunks), n AS (SELECT * FROM c WHERE name IS NOT NULL), q AS (SELECT lower(trim(name)) AS q FROM n ORDER BY faiss_id LIMIT 1),
s AS (SELECT n.*, q, 100.0 * (1 - levenshtein(lower(name), q)::DOUBLE / greatest(length(name), length(q))) AS ratio FROM n, q),
t AS (SELECT faiss_id, name, round(CASE WHEN lower(name) = q THEN 1.0 WHEN starts_with(lower(name), q) THEN 0.9 WHEN instr(lower(name), q) > 0 THEN 0.7 WHEN ratio >= 60 THEN least(0.95, 0.5 + (ratio - 60) / 100) END::DOUBLE, 6) AS score FROM s)
SELECT * FROM t WHERE score >= 0.5 ORDER BY score DESC, name, faiss_id LIMIT 50"""


@query
def symbol_nth(spark, d):
    """The second declaration of each name in a file, or its last."""
    return symbols.nth(file_symbols(spark, d), KEYS, 2).select(*KEYS, "name", "line_start")


SQL["symbol_nth"] = f"""WITH {SYMBOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, path, name ORDER BY line_start) AS r, count(*) OVER (PARTITION BY workspace_id, path, name) AS n FROM symbols)
SELECT workspace_id, path, name, line_start FROM r WHERE r = least(n, 2)"""


@query
def inheritance_extract(spark, d):
    """Child and parent of class heads, by language family."""
    return symbols.inheritance(file_lines(spark, d), KEYS)


def _inheritance_sql():
    parts = []
    for pattern, kind in symbols.INHERITANCE:
        child, parents = (2, 1) if kind == "impl" else (1, 2)
        parts.append(f"SELECT workspace_id, path, regexp_extract(line, '{pattern}', {child}) AS child, unnest(string_split(regexp_extract(line, '{pattern}', {parents}), ',')) AS p, '{kind}' AS kind, line_no FROM lines WHERE regexp_extract(line, '{pattern}', {child}) <> ''")
    return f"""WITH {LINES}, raw AS ({" UNION ALL ".join(parts)}),
named AS (SELECT *, regexp_extract(p, '^\\s*metaclass\\s*=\\s*(\\S+)', 1) AS m FROM raw),
e AS (SELECT workspace_id, path, child, CASE WHEN m <> '' THEN m ELSE regexp_replace(regexp_replace(trim(p), '<.*$', ''), '^((public|private|protected|virtual)\\s+)+', '') END AS parent, CASE WHEN m <> '' THEN 'metaclass' ELSE kind END AS edge_type, line_no AS line FROM named)
SELECT DISTINCT * FROM e WHERE parent <> '' AND parent NOT LIKE '%=%'"""


SQL["inheritance_extract"] = _inheritance_sql()


@query
def import_extract(spark, d):
    """Imported modules."""
    return symbols.imports(file_lines(spark, d), KEYS)


def _imports_sql():
    quoted = [p.replace("'", "''") for p in symbols.IMPORTS]
    first = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', 1) END" for p in quoted) + ")"
    return f"WITH {LINES} SELECT * FROM (SELECT workspace_id, path, {first} AS imported, line_no AS line FROM lines) WHERE imported IS NOT NULL"


SQL["import_extract"] = _imports_sql()


@query
def call_extract(spark, d):
    """Lexical call edges within callables."""
    return symbols.call_edges(file_lines(spark, d), KEYS)


_NOT_CALLED = ", ".join(f"'{w}'" for w in symbols.NOT_CALLED)
SQL["call_extract"] = f"""WITH {LINES}, n AS (SELECT *, CASE WHEN regexp_matches(regexp_extract(line, '{_SYMBOL}', 2), 'def|func') THEN regexp_extract(line, '{_SYMBOL}', 3) END AS d FROM lines),
i AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY workspace_id, path ORDER BY line_no) AS caller FROM n),
c AS (SELECT workspace_id, path, caller, line_no AS line, unnest(list_distinct(regexp_extract_all(regexp_replace(line, '{_SYMBOL}', ''), '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))) AS callee FROM i WHERE caller IS NOT NULL)
SELECT workspace_id, path, caller, callee, line FROM c WHERE callee NOT IN ({_NOT_CALLED})"""


@query
def member_impact(spark, d):
    """What the members of every class call and what calls them."""
    ls = file_lines(spark, d)
    return graph.member_impact(symbols.call_edges(ls, KEYS), symbols.members(ls, KEYS), "workspace_id")


SQL["member_impact"] = f"""WITH {LINES}, decl AS (SELECT workspace_id, path, line_no, length(regexp_extract(line, '{_SYMBOL}', 1)) AS ind, regexp_matches(regexp_extract(line, '{_SYMBOL}', 2), '^({symbols.HOLDERS})$') AS holds, regexp_extract(line, '{_SYMBOL}', 3) AS name FROM lines WHERE regexp_matches(line, '{_SYMBOL}')),
o AS (SELECT *, last_value(CASE WHEN holds THEN {{'name': name, 'ind': ind}} END IGNORE NULLS) OVER (PARTITION BY workspace_id, path ORDER BY line_no) AS i FROM decl),
m AS (SELECT DISTINCT workspace_id AS scope, i.name AS owner, name AS member FROM o WHERE NOT holds AND ind > i.ind),
n AS (SELECT *, CASE WHEN regexp_matches(regexp_extract(line, '{_SYMBOL}', 2), 'def|func') THEN regexp_extract(line, '{_SYMBOL}', 3) END AS d FROM lines),
c0 AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY workspace_id, path ORDER BY line_no) AS caller FROM n),
c AS (SELECT DISTINCT workspace_id AS scope, caller, unnest(regexp_extract_all(regexp_replace(line, '{_SYMBOL}', ''), '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS callee FROM c0 WHERE caller IS NOT NULL),
e AS (SELECT * FROM c WHERE callee NOT IN ({_NOT_CALLED})), clear AS (SELECT scope, member FROM m GROUP BY ALL HAVING count(*) <= 3),
a AS (SELECT m.scope, m.owner, e.callee AS other FROM m JOIN e ON e.scope = m.scope AND e.caller = m.member), b AS (SELECT m.scope, m.owner, e.caller AS other FROM m JOIN clear ON clear.scope = m.scope AND clear.member = m.member JOIN e ON e.scope = m.scope AND e.callee = m.member),
ac AS (SELECT scope, owner, count(DISTINCT other) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.scope = a.scope AND m.owner = a.owner AND m.member = a.other) GROUP BY ALL),
bc AS (SELECT scope, owner, count(DISTINCT other) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.scope = b.scope AND m.owner = b.owner AND m.member = b.other) GROUP BY ALL),
mc AS (SELECT scope, owner, count(*) AS members FROM m GROUP BY ALL)
SELECT mc.scope, mc.owner, members, coalesce(ac.n, 0) AS calls, coalesce(bc.n, 0) AS called_by FROM mc LEFT JOIN ac ON ac.scope = mc.scope AND ac.owner = mc.owner LEFT JOIN bc ON bc.scope = mc.scope AND bc.owner = mc.owner"""


@query
def symbol_weighted(spark, d):
    """The fifty symbol names nearest to a word by the weighted ratio, each name once."""
    n = table(spark, d, "chunks").select(F.get_json_object("metadata", "$.symbol_name").alias("name")).where("name is not null").distinct()
    return n.withColumn("score", F.round(symbols.weighted_ratio(F.col("name"), "sortCursor"), 6)).where("score >= 60").orderBy(F.desc("score"), "name").limit(50)


# Vectors


def _query_vector(spark, d):
    row = table(spark, d, "chunks").where("faiss_id = 1").select("embedding").first()
    return [float(x) for x in row[0]] if row and row[0] else [0.0] * 64


_COS = """u AS (SELECT faiss_id, chunk_id, chunk_type, file_path, content, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM chunks WHERE faiss_id = 1),
scored AS (SELECT u.*, round(list_sum(list_transform(list_zip(e, v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(v, lambda x: x * x)))), 6) AS score FROM u, q)"""


@query
def vector_topk(spark, d):
    """Exact cosine search."""
    return vector.topk(table(spark, d, "chunks"), "faiss_id", "embedding", _query_vector(spark, d), 10).select("faiss_id", "chunk_id", "score")


SQL["vector_topk"] = f"WITH {_COS} SELECT faiss_id, chunk_id, score FROM scored ORDER BY score DESC, faiss_id LIMIT 10"


@query
def vector_topk_filtered(spark, d):
    """the metadata filter comes before the limit."""
    c = table(spark, d, "chunks")
    return vector.topk(c, "faiss_id", "embedding", _query_vector(spark, d), 10, F.col("chunk_type") == "method").select("faiss_id", "chunk_id", "score")


SQL["vector_topk_filtered"] = f"WITH {_COS} SELECT faiss_id, chunk_id, score FROM scored WHERE chunk_type = 'method' ORDER BY score DESC, faiss_id LIMIT 10"


@query
def keyword_topk(spark, d):
    """First hits of a phrase."""
    return vector.keyword(table(spark, d, "chunks"), "faiss_id", "content", "cursor", 10).select("faiss_id", "score")


SQL["keyword_topk"] = "SELECT faiss_id, 1.0::DOUBLE AS score FROM chunks WHERE instr(lower(content), 'cursor') > 0 ORDER BY faiss_id LIMIT 10"


@query
def rrf_fusion(spark, d):
    """Vector and keyword lists fused by reciprocal ranks."""
    c = table(spark, d, "chunks")
    lists = {"keyword": vector.keyword(c, "faiss_id", "content", "cursor", 20), "vector": vector.topk(c, "faiss_id", "embedding", _query_vector(spark, d), 20)}
    return vector.rrf(lists, "faiss_id").select("faiss_id", "score", F.array_join("found_in", ",").alias("found_in")).limit(10)


SQL["rrf_fusion"] = f"""WITH {_COS}, a AS (SELECT faiss_id, 'vector' AS l, row_number() OVER (ORDER BY score DESC, faiss_id) AS r FROM scored QUALIFY r <= 20),
b AS (SELECT faiss_id, 'keyword' AS l, row_number() OVER (ORDER BY faiss_id) AS r FROM chunks WHERE instr(lower(content), 'cursor') > 0 QUALIFY r <= 20)
SELECT faiss_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, string_agg(l, ',' ORDER BY l) AS found_in FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY faiss_id ORDER BY score DESC, faiss_id LIMIT 10"""


@query
def boost_merge(spark, d):
    """Exact symbol hits first, then vector hits that are not among them."""
    c = table(spark, d, "chunks")
    exact = c.where(F.get_json_object("metadata", "$.symbol_name") == F.lit("sortRidge")).withColumn("score", F.lit(1.0))
    near = vector.topk(c, "faiss_id", "embedding", _query_vector(spark, d), 10)
    return vector.boosted(exact, near, ["faiss_id"], 15)


SQL["boost_merge"] = f"""WITH {_COS}, x AS (SELECT faiss_id, 1.0::DOUBLE AS score, 'boost' AS source, 0 AS p FROM chunks WHERE json_extract_string(metadata, '$.symbol_name') = 'sortRidge'),
n AS (SELECT faiss_id, score, 'vector' AS source, 1 AS p FROM (SELECT * FROM scored ORDER BY score DESC, faiss_id LIMIT 10) WHERE faiss_id NOT IN (SELECT faiss_id FROM x))
SELECT faiss_id, score, source FROM (SELECT * FROM x UNION ALL SELECT * FROM n) ORDER BY p, score DESC, faiss_id LIMIT 15"""


@query
def lexical_boost(spark, d):
    """Files by overlap of path and best line with a question's words."""
    snap = snapshot(spark, d).withColumn("file", F.concat_ws(":", "workspace_id", "path"))
    ls = text.lines(snap, ["file"], "content")
    return vector.lexical_boost(ls, "file", "where does the worker publish batches for cursors", 20).select("file", "line_no", "matched", "score", "relevance")


_LB = ["worker", "publish", "batch", "cursor"]


def _lexical_sql():
    toks = vector.query_tokens("where does the worker publish batches for cursors")
    hit = lambda text, t: "(" + " OR ".join(f"instr({text}, '{v}') > 0" for v in vector.variants(t)) + ")"
    arr = lambda text: "list_filter([" + ", ".join(f"CASE WHEN {hit(text, t)} THEN '{t}' END" for t in toks) + "], lambda x: x IS NOT NULL)"
    return f"""WITH {LINES}, l AS (SELECT workspace_id || ':' || path AS file, line_no, line, {arr('lower(line)')} AS m FROM lines WHERE NOT regexp_matches(lower(workspace_id || ':' || path), '/static/|/vendors?/|/node_modules/|/dist/|/build/|jquery')),
s AS (SELECT *, 2.0::DOUBLE * len(m) + CASE WHEN regexp_matches(ltrim(line), '^(class |def |async def )') THEN 1.5 ELSE 0.0 END + CASE WHEN len(m) >= 2 THEN len(m) ELSE 0.0 END AS ls FROM l WHERE len(m) > 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY file ORDER BY ls DESC, line_no) = 1),
p AS (SELECT *, {arr('lower(file)')} AS ip, {arr("string_split(lower(file), '/')[-1]")} AS inn FROM b),
a AS (SELECT *, len(list_distinct(list_concat(ip, m))) AS n FROM p),
z AS (SELECT file, line_no, n AS matched, round((3.0 * len(ip) + 2.0 * len(inn) + ls + n + CASE WHEN n = {len(toks)} THEN 4.0 WHEN n >= 3 THEN 2.0 ELSE 0.0 END) * CASE WHEN instr(lower(file), '/tests/') > 0 OR lower(file) LIKE 'tests/%' THEN 0.55 ELSE 1.0 END, 6) AS score FROM a WHERE n >= 2)
SELECT file, line_no, matched, score::DOUBLE AS score, round(least(0.98, 0.55 + score / 40), 6)::DOUBLE AS relevance FROM z WHERE score >= 5 ORDER BY relevance DESC, score DESC, file LIMIT 20"""


SQL["lexical_boost"] = _lexical_sql()


@query
def search_stats(spark, d):
    """Indexed files, chunks and symbols per workspace."""
    c = table(spark, d, "chunks")
    return c.groupBy("workspace_id").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"), F.count_if(F.col("chunk_type").isin("function", "class", "method")).alias("symbols"))


SQL["search_stats"] = "SELECT workspace_id, count(DISTINCT file_path) AS files, count(*) AS chunks, count(*) FILTER (chunk_type IN ('function', 'class', 'method')) AS symbols FROM chunks GROUP BY workspace_id"


@query
def path_counts(spark, d):
    """Symbols and lines of every file."""
    n = file_lines(spark, d).groupBy(*KEYS).agg(F.count("*").alias("lines"))
    s = file_symbols(spark, d).groupBy(*KEYS).agg(F.count("*").alias("symbols"))
    return n.join(s, KEYS, "left").na.fill(0, ["symbols"])


SQL["path_counts"] = f"WITH {SYMBOLS} SELECT l.workspace_id, l.path, l.lines, coalesce(s.symbols, 0) AS symbols FROM (SELECT workspace_id, path, count(*) AS lines FROM lines GROUP BY ALL) l LEFT JOIN (SELECT workspace_id, path, count(*) AS symbols FROM symbols GROUP BY ALL) s ON l.workspace_id = s.workspace_id AND l.path = s.path"


@query
def object_store(spark, d):
    """SK1/X15: one object per content digest, with whether the pushed hash and size agree (H2's checks)."""
    f = table(spark, d, "sync_files").where("content is not null").withColumn("digest", T.digest("content"))
    size = F.octet_length("content").cast("long")
    return f.groupBy("digest").agg(F.count("*").alias("n_refs"), F.min("sync_id").alias("first_sync"), F.max(size).alias("size"), F.count_if(F.col("digest") != F.col("hash")).alias("bad_hash"), F.count_if(size != F.col("size")).alias("bad_size"))


SQL["object_store"] = """SELECT 'sha256:' || sha256(content) AS digest, count(*) AS n_refs, min(sync_id) AS first_sync, max(strlen(content)) AS size, count(*) FILTER ('sha256:' || sha256(content) <> hash) AS bad_hash, count(*) FILTER (strlen(content) <> size) AS bad_size FROM sync_files WHERE content IS NOT NULL GROUP BY 1"""
