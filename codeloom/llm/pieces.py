"""Cut oversized texts at natural boundaries into pieces under a limit, neighbours sharing an overlap.

One bounded regex per limit and kind of text consumes the text from left to right. Its alternatives are ordered by the
strength of the boundary they end at: first in the second half of the room, then anywhere in the room; only where
there is no boundary at all does the last alternative take any character, so nothing is lost. The room is the limit
less the overlap. Array functions then put the last ``overlap`` characters before each piece in front of it.
The work is linear in the text; it is all JVM-side, without a shuffle of texts.

Defined results
- Limits count code points. A text within its limit, a null text or one without a limit gives no pieces.
- Pieces without their overlap concatenate to the text exactly. ``start`` is the 1-based position of the piece,
  its overlap included.
- The overlap is exact unless fewer characters come before the piece. An overlap of null or below 0 counts as 0, one of
  the limit or more as the limit less 1.
- An unknown or null kind is cut as code. Rows repeat as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import bounded_broadcast

#: A blank line ends here; one of up to 80 blanks counts. The line's end is looked for first, which is one step.
BLANK = r"(?<=\n)(?<=\n[ \t]{0,80}\r?\n)"
LINE = r"(?<=\n)"
#: Boundaries by kind of text, strongest first, each as what lies around the cut.
BOUNDARIES = {
    "code": [BLANK + r"(?=\S)", BLANK, LINE + r"(?=[^\s}\])])", LINE, r"(?<=[;,{}])", r"(?<=\s)"],
    "member": [BLANK, LINE + r"(?=[ \t]*(?:def|async|class|@|public|private|protected|static|func|function|if|for|while|return|try)\b)", LINE, r"(?<=[;,{}])", r"(?<=\s)"],
    "data": [BLANK, r"(?<=\n)(?<=[}\]],?\r?\n)", LINE + r"(?=[^\s}\]])", LINE, r"(?<=[,;}\]])", r"(?<=\s)"],
    "prose": [BLANK, LINE, r"(?<=[.!?。！？]\s?)", r"(?<=[,;:，；：、]\s?)", r"(?<=\s)"],
}
#: Kinds by chunk type and by suffix of the path.
CHUNK_KINDS = {"class": "member", "method": "member", "function": "member", "module_body": "code", "file": "code", "file_overview": "prose", "parse_error": "code"}
PATH_KINDS = {"json": "data", "yaml": "data", "yml": "data", "toml": "data", "properties": "data", "lock": "data", "csv": "data", "md": "prose", "rst": "prose", "txt": "prose", "html": "prose"}


def kind_of(chunk_type: Column, path: Column) -> Column:
    """Kind of a text by its chunk type, or without one (or as a whole file) by its path."""
    by_type = F.create_map(*[F.lit(x) for kv in CHUNK_KINDS.items() for x in kv])[chunk_type]
    by_path = F.create_map(*[F.lit(x) for kv in PATH_KINDS.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]
    return F.coalesce(F.when(chunk_type.isin("class", "method", "function"), by_type), by_path, by_type, F.lit("code"))


def boundary_regex(room: Column, low: Column, kind: Column) -> Column:
    """The bounded extraction pattern for a room and a least fill, as a column."""

    def pattern(boundaries: list[str]) -> Column:
        late = [F.concat(F.lit(".{"), low, F.lit(","), room, F.lit("}" + b)) for b in boundaries]
        early = [F.concat(F.lit(".{1,"), room, F.lit("}" + b)) for b in boundaries]
        whole = F.concat(F.lit(".{1,"), room, F.lit(r"}\z"))
        rest = F.concat(F.lit(".{1,"), room, F.lit("}"))
        return F.concat(F.lit("(?s)(?:"), F.concat_ws("|", whole, *late, *early, rest), F.lit(")"))

    out = pattern(BOUNDARIES["code"])
    for name in ("member", "data", "prose"):
        out = F.when(kind == name, pattern(BOUNDARIES[name])).otherwise(out)
    return out


def with_parts(df: DataFrame, text: str, limit: str, overlap: str, kind: str | None = None) -> DataFrame:
    """``df`` of oversized rows with ``_parts`` (the text cut without overlap) and ``_ov`` (the overlap used)."""
    ov = F.least(F.greatest(F.coalesce(F.col(overlap), F.lit(0)), F.lit(0)), F.col(limit) - 1).cast("int")
    room = F.col(limit) - F.col("_ov")
    low = F.greatest(F.lit(1), F.ceil(room / 2)).cast("int")
    long = df.where((F.length(text) > F.col(limit)) & (F.col(limit) > 0)).withColumn("_ov", ov)
    form = boundary_regex(room.cast("string"), low.cast("string"), F.col(kind) if kind else F.lit("code"))
    return long.withColumn("_re", form).withColumn("_parts", F.regexp_extract_all(F.col(text), F.col("_re"), F.lit(0))).drop("_re")


def split_oversized(df: DataFrame, ids: list[str], text: str, limit: str, overlap: str, kind: str | None = None) -> DataFrame:
    """ids.., piece_no (from 0), n_pieces, start, n_chars, piece; ``kind`` names a column of BOUNDARIES' kinds."""
    cut = with_parts(df.select(*ids, text, limit, overlap, *([kind] if kind else [])), text, limit, overlap, kind)
    # two parts in a row make more than half the room: after an early cut no boundary follows for long
    back = F.expr(f"cast(2 * ceil(_ov / greatest(1, ceil((`{limit}` - _ov) / 2))) + 2 as int)")
    cut = cut.withColumn("_back", back).withColumn(
        "_pieces",
        F.expr("transform(_parts, (p, i) -> named_struct('own', p, 'lead', if(i = 0 or _ov = 0, '', right(array_join(slice(_parts, greatest(1, i - _back + 1), least(i, _back)), ''), _ov))))"),
    )
    cut = cut.withColumn("_lens", F.expr("transform(_parts, p -> cast(length(p) as long))"))
    out = cut.select(*ids, F.size("_parts").cast("long").alias("n_pieces"), F.posexplode(F.arrays_zip("_pieces", _starts("_lens").alias("_starts"))).alias("_i", "_z"))
    piece = F.concat(F.col("_z._pieces.lead"), F.col("_z._pieces.own"))
    return out.select(*ids, F.col("_i").cast("long").alias("piece_no"), "n_pieces", (F.col("_z._starts") - F.length("_z._pieces.lead") + 1).cast("long").alias("start"), F.length(piece).cast("long").alias("n_chars"), piece.alias("piece"))


def _starts(lens: str) -> Column:
    """Prefix sums of the lengths before each part."""
    return F.expr(f"slice(aggregate({lens}, array(0L), (a, x) -> array_append(a, element_at(a, -1) + x)), 1, size({lens}))")


def items(chunks: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """item_kind, item_id, content, max_chars, overlap_chars and kind of text of all rows that have a limit.

    The limits are a table of fixed size: one row per kind and type, read once and joined as literals.
    """
    lim = limits.select("item_kind", "chunk_type", F.col("max_chars").cast("int").alias("max_chars"), F.col("overlap_chars").cast("int").alias("overlap_chars"))
    lim = bounded_broadcast(lim.groupBy("item_kind", "chunk_type").agg(F.min("max_chars").alias("max_chars"), F.min_by("overlap_chars", "max_chars").alias("overlap_chars")), 10_000)
    c = chunks.select(F.lit("chunk").alias("item_kind"), F.col("faiss_id").cast("long").alias("item_id"), "chunk_type", F.col("file_path").alias("path"), "content")
    f = files.select(F.lit("file").alias("item_kind"), F.col("sync_id").cast("long").alias("item_id"), F.lit(None).cast("string").alias("chunk_type"), "path", "content")
    both = c.unionByName(f)
    on = (both["item_kind"] == lim["item_kind"]) & both["chunk_type"].eqNullSafe(lim["chunk_type"])
    return both.join(lim, on).select(both["item_kind"], "item_id", "content", "max_chars", "overlap_chars", kind_of(both["chunk_type"], F.col("path")).alias("text_kind"))
