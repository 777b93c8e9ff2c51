"""Markdown playbooks: header chunking inside each row, and the change-aware chunk index.

A document is one row, so its sections are found with array functions in that row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import text as tx

# Both patterns start at a line feed, which is looked up fast. A fenced block is tried first and taken whole,
# so a "#" line or a blank line inside it is never seen as a header or a gap.
_FENCE = r"(```|~~~)[^\n]*+(?:\n(?!\2)[^\n]*+)*+(?:\n\2[^\n]*+)?"
_FENCE_OR_HEADER = rf"\n(?:({_FENCE})|(#{{1,3}}(?:[ \t][^\n]*+)?(?=\n|$)))"
_FENCE_OR_GAP = rf"(\n{_FENCE})|\n\n++"
_MARK = "\x01\x1e"
_HEADER = r"^[ \t]*(#{1,3})(?:[ \t]([^\n]*))?(?=\n|$)"


def split_sections(content: Column) -> Column:
    """Array of (level, title, body): the text up to each header outside fences, in order.

    Lines are trimmed; blank runs outside fences become two blanks and a line feed. Level 0 is text before
    the first header. Header lines stay in the body.
    """
    text = F.concat(F.lit("\n"), F.regexp_replace(content, r"\r\n?", "\n"))
    lines = F.regexp_replace(text, r"[ \t]*+\n[ \t]*+", "\n")
    marked = F.regexp_replace(lines, _FENCE_OR_HEADER, f"\n$1{_MARK}$3")
    gaps = F.regexp_replace(marked, _FENCE_OR_GAP, "$1\x02")
    joined = F.regexp_replace(F.regexp_replace(gaps, "\x02(?=\n)", ""), "\x02+", "  \n")

    def describe(piece: Column) -> Column:
        hashes = F.regexp_extract(piece, _HEADER, 1)
        return F.struct(
            F.length(hashes).alias("level"), tx.strip(F.regexp_extract(piece, _HEADER, 2)).alias("title"),
            F.btrim(piece, F.lit(" \n")).alias("body"),
        )

    return F.transform(F.split(joined, _MARK), describe)


_FOLD = """
aggregate(
  sections,
  named_struct('h1', cast(null AS STRING), 'h2', cast(null AS STRING), 'h3', cast(null AS STRING),
               'done', cast(array() AS ARRAY<STRUCT<h1:STRING,h2:STRING,h3:STRING,level:INT,body:STRING>>)),
  (acc, s) -> CASE
    WHEN s.level = 0 AND size(acc.done) > 0 THEN named_struct(
      'h1', acc.h1, 'h2', acc.h2, 'h3', acc.h3,
      'done', concat(slice(acc.done, 1, size(acc.done) - 1), transform(slice(acc.done, -1, 1), d -> named_struct(
        'h1', d.h1, 'h2', d.h2, 'h3', d.h3, 'level', d.level, 'body', concat(d.body, '\\n', s.body)))))
    ELSE transform(array(named_struct(
      'h1', CASE WHEN s.level = 1 THEN s.title ELSE acc.h1 END,
      'h2', CASE WHEN s.level = 1 THEN null WHEN s.level = 2 THEN s.title ELSE acc.h2 END,
      'h3', CASE WHEN s.level IN (1, 2) THEN null WHEN s.level = 3 THEN s.title ELSE acc.h3 END)), h ->
      named_struct('h1', h.h1, 'h2', h.h2, 'h3', h.h3, 'done',
        concat(acc.done, array(named_struct('h1', h.h1, 'h2', h.h2, 'h3', h.h3, 'level', s.level, 'body', s.body)))))[0]
  END,
  acc -> acc.done)
"""

# A section that is only its header line joins the deeper section after it, which keeps its own headers.
_JOIN_BARE = """
aggregate(
  chunks,
  cast(array() AS ARRAY<STRUCT<h1:STRING,h2:STRING,h3:STRING,level:INT,body:STRING>>),
  (acc, s) -> CASE
    WHEN size(acc) > 0 AND acc[size(acc) - 1].level > 0 AND s.level > acc[size(acc) - 1].level
         AND acc[size(acc) - 1].body NOT RLIKE '\\\\n'
    THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct(
      'h1', s.h1, 'h2', s.h2, 'h3', s.h3, 'level', s.level,
      'body', concat(acc[size(acc) - 1].body, '  \\n', s.body))))
    ELSE concat(acc, array(s)) END)
"""


def chunk_documents(docs: DataFrame) -> DataFrame:
    """One row per section of (source_file, content) documents, with headers in effect and technique tags.

    Chunk ordinals count blank sections too; blank sections are dropped afterwards.
    """
    split = (
        docs.withColumn("sections", split_sections(F.col("content")))
        .withColumn("sections", F.expr("filter(sections, (s, i) -> i > 0 OR trim(BOTH ' \\t\\n' FROM s.body) <> '')"))
        .withColumn("chunks", F.expr(_FOLD))
        .withColumn("chunks", F.expr(_JOIN_BARE))
        # Per-document values are made before the explode, and the whole text stops here.
        .select(
            "source_file", tx.document_title(F.col("content"), F.col("source_file")).alias("playbook_name"),
            tx.content_hash(F.col("content")).alias("file_hash"), "chunks",
        )
        # Without "outer" a filter on the list's size goes below it, which makes all chunks of every document once more.
        .select("source_file", "playbook_name", "file_hash", F.posexplode_outer("chunks").alias("chunk_no", "chunk"))
    )
    body = tx.strip(F.col("chunk.body"))
    section = F.coalesce(*[F.nullif(F.col(f"chunk.{h}"), F.lit("")) for h in ("h3", "h2", "h1")], F.lit(""))
    return split.select(
        F.concat("source_file", F.lit("::"), "chunk_no").alias("chunk_id"), "source_file", "chunk_no", "playbook_name",
        section.alias("section"), body.alias("content"),
        tx.join_techniques(tx.techniques(body)).alias("mitre_techniques"), "file_hash",
    ).filter(F.col("content") != "")


def known_hashes(index: DataFrame) -> DataFrame:
    """First stored hash per source."""
    return index.groupBy("source_file").agg(F.min_by("file_hash", "chunk_no").alias("known_hash"))


def change_status(docs: DataFrame, index: DataFrame | None, rebuild: bool = False) -> DataFrame:
    """Documents with status new, changed or unchanged against the index; without one all are new."""
    hashed = docs.withColumn("file_hash", tx.content_hash(F.col("content")))
    if index is None:
        return hashed.withColumn("known_hash", F.lit(None).cast("string")).withColumn("status", F.lit("new"))
    joined = hashed.join(known_hashes(index), "source_file", "left")
    status = (
        F.when(F.col("known_hash").isNull(), "new")
        .when((F.col("known_hash") == F.col("file_hash")) & F.lit(not rebuild), "unchanged")
        .otherwise("changed")
    )
    return joined.withColumn("status", status)


def marked_documents(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The (source_file, content) documents that (source_file, mark) rows name; a mark is a hash of the text's hash."""
    mark = F.xxhash64(tx.content_hash(F.col("content")))
    named = marks["source_file"].eqNullSafe(docs["source_file"]) & (marks["mark"] == mark)
    return docs.join(marks, named, "left_semi").select("source_file", "content")


def upsert_chunks(index: DataFrame, fresh: DataFrame, changed_sources: DataFrame) -> DataFrame:
    """Index rows of untouched sources plus the fresh chunks."""
    kept = index.join(changed_sources.select("source_file"), "source_file", "left_anti")
    return kept.unionByName(fresh)


def index_stats(status: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: indexed files (with at least one chunk), skipped files, new chunks."""
    per_file = fresh.groupBy("source_file").agg(F.count("*").alias("n_chunks"))
    joined = status.select("source_file", "status").join(per_file, "source_file", "left")
    return joined.agg(
        F.count_if((F.col("status") != "unchanged") & F.col("n_chunks").isNotNull()).alias("indexed_files"),
        F.count_if(F.col("status") == "unchanged").alias("skipped_files"),
        F.coalesce(F.sum(F.when(F.col("status") != "unchanged", F.col("n_chunks"))), F.lit(0)).alias("total_chunks"),
    )
