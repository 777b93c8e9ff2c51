"""Playbook retrieval: nearest chunks per incident, technique boost, two-stage ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import text as tx
from emberline.operators.lexical import LexicalIndex, lexical_search
from emberline.operators.nearest import nearest_by_cosine
from emberline.schema import RETRIEVE_BOOST, RETRIEVE_OVER_FETCH, RETRIEVE_TOP_K

CHUNK_FIELDS = ["source_file", "playbook_name", "section", "content", "mitre_techniques", "file_hash"]


def incident_queries(profiles: DataFrame) -> DataFrame:
    """(cluster_id, query, hints) from event type, class labels and the best representative row."""
    sample = F.get("representative_logs", F.lit(0))["description"]
    labels = F.transform(F.coalesce("dominant_classes", F.expr("array()")), lambda d: d["class_name"])
    return profiles.select(
        "cluster_id",
        tx.retrieval_query(F.col("dominant_event_type"), labels, sample).alias("query"),
        tx.techniques(F.coalesce(sample, F.lit(""))).alias("hints"),
    )


def over_fetch(queries: DataFrame, index: DataFrame, top_k: int, over: int) -> DataFrame:
    """(qid, id, dist, rank): the ``top_k * over`` nearest chunks of each (id, vec) query."""
    corpus = index.select(F.col("chunk_id").alias("id"), "vec")
    return nearest_by_cosine(queries, corpus, max(top_k * over, top_k))


def retrieve(
    queries: DataFrame, index: DataFrame, top_k: int = RETRIEVE_TOP_K, boost: float = RETRIEVE_BOOST,
    over: int = RETRIEVE_OVER_FETCH,
) -> DataFrame:
    """Top-k chunks of each (id, vec, hints) query after the boost, with ``chunk_rank``."""
    return rerank(over_fetch(queries, index, top_k, over), queries, index, top_k, boost)


def retrieve_by_words(
    queries: DataFrame, index: DataFrame, lexical: LexicalIndex, top_k: int = RETRIEVE_TOP_K, boost: float = RETRIEVE_BOOST,
    over: int = RETRIEVE_OVER_FETCH,
) -> DataFrame:
    """Like ``retrieve`` for (id, query, hints) rows, by words: ``lexical`` is the index of the chunks' contents by chunk_id.

    Chunks that share no word with a query are not retrieved for it.
    """
    found = lexical_search(queries.select("id", F.col("query").alias("text")), lexical, max(top_k * over, top_k))
    return rerank(found.withColumn("dist", 1.0 - F.col("score")).drop("score"), queries, index, top_k, boost)


def rerank(found: DataFrame, queries: DataFrame, index: DataFrame, top_k: int, boost: float) -> DataFrame:
    """Top-k of the over-fetched (qid, id, dist, rank) candidates after the boost; equal scores keep their distance order."""
    known = index.select(F.col("chunk_id").alias("id"), *CHUNK_FIELDS)
    hints = queries.select(F.col("id").alias("qid"), "hints")
    overlap = tx.techniques_overlap(tx.split_techniques(F.col("mitre_techniques")), F.col("hints"))
    score = 1.0 - F.col("dist") + F.when(overlap, F.lit(float(boost))).otherwise(0.0)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    return (
        found.join(known, "id").join(hints, "qid")
        .withColumn("score", F.round(score, 8))
        .withColumn("chunk_rank", F.row_number().over(order))
        .filter(F.col("chunk_rank") <= top_k)
        .withColumn("section", F.nullif("section", F.lit("")))
        .select(F.col("qid"), "chunk_rank", F.col("id").alias("chunk_id"), *CHUNK_FIELDS, "score")
    )


def chunk_lists(retrieved: DataFrame) -> DataFrame:
    """Ranked chunks of each query as one short list (at most ``top_k`` entries)."""
    entry = F.struct("chunk_rank", F.struct("source_file", "section", "content", "score").alias("c"))
    packed = F.array_sort(F.collect_list(entry))
    return retrieved.groupBy("qid").agg(F.transform(packed, lambda e: e["c"]).alias("playbook_chunks"))


def first_seen_sources(chunks: str) -> Column:
    """Distinct non-blank source files of a chunk list, in rank order."""
    files = F.transform(F.coalesce(chunks, F.expr("array()")), lambda c: c["source_file"])
    return F.array_distinct(F.filter(files, lambda f: f != ""))
