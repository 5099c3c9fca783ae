"""What several queries read: the snapshot of pushed files, its lines, and the SQL of both."""

from __future__ import annotations

from codeloom.operators import text
from codeloom.session import registry, table

QUERIES, SQL, query = registry()

SNAP = """snap AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, path ORDER BY revision DESC NULLS LAST, sync_id DESC) AS rn FROM sync_files) WHERE rn = 1)"""
LINES = (
    SNAP
    + """, parts AS (SELECT workspace_id, path, string_split(content, chr(10)) AS l0 FROM snap WHERE content IS NOT NULL),
cut AS (SELECT workspace_id, path, CASE WHEN l0[-1] = '' THEN l0[:len(l0) - 1] ELSE l0 END AS l FROM parts),
lines AS (SELECT workspace_id, path, unnest(range(1, len(l) + 1)) AS line_no, regexp_replace(unnest(l), '\\r$', '') AS line FROM cut)"""
)
DOC_LINES = """parts AS (SELECT doc_id, string_split(text, chr(10)) AS l0 FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, CASE WHEN l0[-1] = '' THEN l0[:len(l0) - 1] ELSE l0 END AS l FROM parts),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, regexp_replace(unnest(l), '\\r$', '') AS line FROM cut)"""
KEYS = ["workspace_id", "path"]


def snapshot(spark, d):
    """The newest version of every pushed file."""
    return text.latest(table(spark, d, "sync_files"), KEYS, ["revision", "sync_id"], "sync_id")


def file_lines(spark, d):
    return text.lines(snapshot(spark, d), KEYS, "content")


def doc_lines(spark, d):
    return text.lines(table(spark, d, "documents"), ["doc_id"], "text")
