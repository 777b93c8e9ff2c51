"""Registered queries: text functions, chunk index, cache, scorers and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import text as tx
from emberline.functions import vectors as vx
from emberline.operators import chunking as ck
from emberline.operators import lexical as lx
from emberline.operators import profile as pf
from emberline.operators import retrieve as rt
from emberline.operators import scoring as sc
from emberline.plans import views as v
from emberline.plans.sqlviews import (
    CENTROIDS, CLASS_NAMES, DOMINANT, LOGS, MEMBERS, PROFILE, REPRESENTATIVES, SCORED, rank_of,
)
from emberline.session import cut_lineage

LEX_DIMS = 256
DIMS = 64
HASH_DIMS = 48

# ---- DuckDB views of the playbook corpus -------------------------------------------------------------

PLAYBOOKS = """
lines AS (
  SELECT doc_id, i - 1 AS i, trim(l, ' ' || chr(9)) AS l, n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i,
      len(string_split(text, chr(10))) AS n FROM documents)),
sections AS (
  SELECT doc_id, i, n, CASE WHEN i % 3 = 2 THEN '### Step ' ELSE '## Part ' END || i AS head, l,
    'See T' || (1000 + (doc_id * 7 + i) % 60) || CASE WHEN (doc_id + i) % 3 = 0 THEN '' ELSE '.00' || ((doc_id + i) % 3) END AS see
  FROM lines),
fence AS (SELECT '```' || chr(10) || '# sample, not a heading' || chr(10) || '```' AS f),
docs AS (
  SELECT 'doc_' || doc_id || '.md' AS source_file, '# Playbook: Guide ' || doc_id || chr(10) || chr(10) || (
    SELECT string_agg(CASE WHEN i % 3 = 2 THEN '### Step ' ELSE '## Part ' END || i || chr(10) || r || chr(10) || 'See T'
      || (1000 + (doc_id * 7 + i) % 60) || CASE WHEN (doc_id + i) % 3 = 0 THEN '' ELSE '.00' || ((doc_id + i) % 3) END,
      chr(10) || chr(10) ORDER BY i)
    FROM (SELECT unnest(string_split(text, chr(10))) AS r, unnest(range(0, len(string_split(text, chr(10))))) AS i))
    || chr(10) || chr(10) || f || chr(10) AS content, doc_id
  FROM documents, fence),
chunks AS (
  SELECT 'doc_' || s.doc_id || '.md::' || i AS chunk_id, 'doc_' || s.doc_id || '.md' AS source_file, i AS chunk_no,
    'Guide ' || s.doc_id AS playbook_name, CASE WHEN i % 3 = 2 THEN 'Step ' ELSE 'Part ' END || i AS section,
    CASE WHEN i = 0 THEN '# Playbook: Guide ' || s.doc_id || '  ' || chr(10) ELSE '' END || head
      || CASE WHEN l = '' THEN '  ' || chr(10) ELSE chr(10) || l || chr(10) END || see
      || CASE WHEN i = n - 1 THEN '  ' || chr(10) || f ELSE '' END AS content,
    array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(l, '') || ' ' || see, 'T[0-9]{4}(?:\\.[0-9]{3})?'))), ',')
      AS mitre_techniques
  FROM sections s, fence)
"""

QUERY_TEXT = f"""
queries AS (
  SELECT p.cluster_id, 'event ' || p.dominant_event_type || '; activity ' || d.names || '; example ' || m.description AS query,
    m.description
  FROM profile p
  JOIN (SELECT cluster_id, string_agg(class_name, ', ' ORDER BY rank) AS names FROM dominant GROUP BY cluster_id) d USING (cluster_id)
  JOIN (SELECT cluster_id, log_idx FROM representatives WHERE rank = 1) r USING (cluster_id)
  JOIN members m ON m.log_idx = r.log_idx)
"""
INCIDENT_SQL = f"{MEMBERS},{SCORED},{PROFILE},{CENTROIDS},{REPRESENTATIVES},{DOMINANT},{QUERY_TEXT}"


def slots_sql(source: str, key: str, text: str, name: str) -> str:
    return f"""
{name}_slots AS (SELECT {key} AS id, ('0x' || substr(md5(w), 1, 4))::INT % {LEX_DIMS} AS slot, count(*)::DOUBLE AS n
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}.]+')) AS w FROM {source}) GROUP BY ALL),
{name}_norms AS (SELECT id, sqrt(sum(n * n)) AS norm FROM {name}_slots GROUP BY id)
"""


def lexical_sql(queries: str, key: str, text: str) -> str:
    """Cosines of the TF-IDF rows of all chunks and of all queries that share a word."""
    word = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}.]+')"
    return f"""
c_counts AS (SELECT id, term, count(*) AS n FROM (SELECT chunk_id AS id, unnest({word.format('content')}) AS term FROM chunks) GROUP BY ALL),
q_counts AS (SELECT id, term, count(*) AS n FROM (SELECT {key} AS id, unnest({word.format(text)}) AS term FROM {queries}) GROUP BY ALL),
total AS (SELECT count(DISTINCT id)::DOUBLE AS n_docs FROM c_counts),
rarity AS (SELECT term, count(*) AS df, ln((1 + any_value(n_docs)) / (1 + count(*))) + 1 AS idf FROM c_counts, total GROUP BY term),
c_unit AS (SELECT id, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY id)) AS w FROM c_counts JOIN rarity USING (term)),
q_weights AS (SELECT id, term, n * coalesce(idf, ln(1 + n_docs) + 1) AS w FROM q_counts LEFT JOIN rarity USING (term), total),
q_unit AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM q_weights),
by_words AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT q.id AS qid, c.id AS id, round(sum(q.w * c.w), 9) AS score FROM q_unit q JOIN c_unit c USING (term) GROUP BY ALL))
"""


FETCHED = f"""{slots_sql('queries', 'cluster_id', 'query', 'q')},{slots_sql('chunks', 'chunk_id', 'content', 'c')},
dots AS (SELECT q.id AS qid, c.id AS id, sum(q.n * c.n) AS dot FROM q_slots q JOIN c_slots c USING (slot) GROUP BY ALL),
fetched AS (SELECT * FROM (
  SELECT q.cluster_id AS qid, c.chunk_id AS id, round(1 - coalesce(d.dot / (qn.norm * cn.norm), 0), 8) AS dist,
    row_number() OVER (PARTITION BY q.cluster_id
      ORDER BY round(sqrt(greatest(2 - 2 * coalesce(d.dot / (qn.norm * cn.norm), 0), 0)), 9), c.chunk_id) AS rank
  FROM queries q CROSS JOIN chunks c LEFT JOIN dots d ON d.qid = q.cluster_id AND d.id = c.chunk_id
  JOIN q_norms qn ON qn.id = q.cluster_id JOIN c_norms cn ON cn.id = c.chunk_id) WHERE rank <= 20)
"""
BOOSTED = """
hints AS (SELECT cluster_id AS qid, [split_part(x, '.', 1) for x in regexp_extract_all(description, 'T[0-9]{4}(?:\\.[0-9]{3})?')] AS parents FROM queries),
boosted AS (SELECT * FROM (
  SELECT f.qid, f.id, f.rank, round(1 - f.dist + CASE WHEN list_has_any(h.parents,
      [split_part(x, '.', 1) for x in string_split(c.mitre_techniques, ',')]) THEN 0.3 ELSE 0 END, 8) AS score,
    row_number() OVER (PARTITION BY f.qid ORDER BY round(1 - f.dist + CASE WHEN list_has_any(h.parents,
      [split_part(x, '.', 1) for x in string_split(c.mitre_techniques, ',')]) THEN 0.3 ELSE 0 END, 8) DESC, f.rank)
      AS chunk_rank
  FROM fetched f JOIN hints h USING (qid) JOIN chunks c ON c.chunk_id = f.id) WHERE chunk_rank <= 5)
"""

PLAYBOOK_BLOCKS = """
playbook_blocks AS (SELECT b.qid AS cluster_id, string_agg('(' || b.chunk_rank || ') match ' || printf('%.2f', round_even(b.score, 2))
    || ', file ' || c.source_file || ', part ''' || c.section || '''' || chr(10) || '  | ' || replace(
      CASE WHEN length(c.content) > 500 THEN rtrim(substr(c.content, 1, 500), ' ' || chr(10)) || '…' ELSE c.content END,
      chr(10), chr(10) || '  | '), chr(10) || chr(10) ORDER BY b.chunk_rank) AS block
  FROM boosted b JOIN chunks c ON c.chunk_id = b.id GROUP BY b.qid)
"""
TEXT_BLOCKS = f"""
class_lines AS (SELECT cluster_id, string_agg(class_name || ' x' || "count" || ' (confidence ' ||
    printf('%.2f', round_even(avg_confidence, 2)) || ')', chr(10) ORDER BY rank) AS classes FROM dominant GROUP BY cluster_id),
severity_lines AS (SELECT cluster_id, string_agg(n || ' ' || severity, ', ' ORDER BY {rank_of('severity')} DESC)
    || ' (rows with a severity: ' || sum(n)::BIGINT || ')' AS severities
  FROM (SELECT cluster_id, severity, count(*) AS n FROM members WHERE severity IS NOT NULL GROUP BY ALL) GROUP BY cluster_id),
sample_lines AS (SELECT r.cluster_id, string_agg('- ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ' ' || concat_ws(' ', severity, event_type)
    || ' [' || concat_ws(', ', coalesce(src_ip, '?') || ' -> ' || coalesce(dst_ip, '?'), 'by ' || "user", 'action ' || action) || '] '
    || description, chr(10) ORDER BY rank) AS samples
  FROM representatives r JOIN members m ON m.log_idx = r.log_idx GROUP BY r.cluster_id),
blocks AS (SELECT * FROM class_lines JOIN severity_lines USING (cluster_id) JOIN sample_lines USING (cluster_id))
"""

# ---- Spark side ----------------------------------------------------------------------------------------


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    return ck.chunk_documents(v.playbook_docs(spark, sf))


def embedded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk index as a stored table."""
    vec = sc.lexical_embedding(F.col("content"), LEX_DIMS)
    return cut_lineage(chunk_table(spark, sf).withColumn("vec", vec), "index")


def profiles_with_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles as a stored table; the validated rows are stored first, since several branches read them."""
    members = cut_lineage(v.members(spark, sf), "members")
    rows = members.join(v.vectors(spark, sf).select("vec_id", "vec"), "vec_id")
    best = pf.representative_lists(pf.representative_rows(rows, pf.centroids(rows)), members)
    scored = sc.hash_classify(members.select("log_idx", "cluster_id", "description"), "description", CLASS_NAMES)
    classes = pf.class_lists(pf.dominant_classes(scored))
    whole = pf.incident_profiles(members).join(best, "cluster_id").join(classes, "cluster_id", "left")
    return cut_lineage(whole, "profiles")


def query_rows(spark: SparkSession, sf: str, profiles: DataFrame | None = None) -> DataFrame:
    asked = rt.incident_queries(profiles_with_samples(spark, sf) if profiles is None else profiles)
    vec = sc.lexical_embedding(F.col("query"), LEX_DIMS)
    return asked.select(F.col("cluster_id").alias("id"), "query", "hints", vec.alias("vec"))


def technique_lists(spark: SparkSession, sf: str) -> DataFrame:
    found = tx.techniques(F.col("description"))
    return v.logs(spark, sf).select(
        "log_idx", tx.join_techniques(found).alias("techniques"),
        F.size(tx.split_techniques(tx.join_techniques(found))).alias("n"),
        tx.parent_technique(found[0]).alias("parent"),
    )


def titles_and_hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.playbook_docs(spark, sf)
    return docs.select(
        "source_file", tx.document_title(F.col("content"), F.col("source_file")).alias("title"),
        tx.content_hash(F.col("content")).alias("file_hash"),
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_table(spark, sf).select(
        "chunk_id", "source_file", "chunk_no", "playbook_name", "section", "content", "mitre_techniques"
    )


def header_state(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_table(spark, sf).groupBy("section").agg(
        F.count("*").alias("n"), F.min("chunk_no").alias("first_no"), F.max("chunk_no").alias("last_no"),
        F.sum(F.length("content")).alias("chars"),
    )


def _stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index whose rows of every third document are stale and of every fifth document missing."""
    doc = F.regexp_extract("source_file", "[0-9]+", 0).cast("bigint")
    stale = F.when(doc % 3 == 0, F.lit("old")).otherwise(F.col("file_hash"))
    return chunk_table(spark, sf).filter(doc % 5 != 0).withColumn("file_hash", stale)


def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.playbook_docs(spark, sf)
    hashed = docs.select("source_file", tx.content_hash(F.col("content")).alias("file_hash"))
    doc = F.regexp_extract("source_file", "[0-9]+", 0).cast("bigint")
    stored = hashed.filter(doc % 5 != 0).select(
        "source_file", F.when(doc % 3 == 0, F.lit("old")).otherwise(F.col("file_hash")).alias("file_hash"),
        F.lit(0).alias("chunk_no"),
    )
    return ck.change_status(docs, stored).groupBy("status").agg(F.count("*").alias("n"))


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored_index(spark, sf)
    status = ck.change_status(v.playbook_docs(spark, sf), stored)
    touched = status.filter(F.col("status") != "unchanged")
    fresh = ck.chunk_documents(touched.select("source_file", "content"))
    after = ck.upsert_chunks(stored, fresh, touched)
    return after.groupBy("source_file").agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col("file_hash") == "old").alias("n_stale")
    )


def index_run(spark: SparkSession, sf: str) -> DataFrame:
    status = ck.change_status(v.playbook_docs(spark, sf), _stored_index(spark, sf))
    fresh = ck.chunk_documents(status.filter(F.col("status") != "unchanged").select("source_file", "content"))
    return ck.index_stats(status, fresh)


def known_hash(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored_index(spark, sf)
    return ck.known_hashes(stored).groupBy((F.col("known_hash") == "old").alias("stale")).agg(F.count("*").alias("n"))


def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against a cache that holds the texts of the labelled documents."""
    docs = v.table(spark, sf, "documents").select("doc_id", tx.cache_key(F.col("text")).alias("cache_key"))
    cached = docs.join(v.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("cache_key").distinct()
    hits, misses = sc.cache_split(docs, cached)
    return hits.select("doc_id", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", F.lit(False).alias("hit")))


def cache_rate(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id", tx.cache_key(F.col("text")).alias("cache_key"))
    cached = docs.join(v.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("cache_key").distinct()
    return sc.cache_stats(docs, cached).withColumn("hit_rate", F.round("hit_rate", 6))


def scatter_back(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors for every document row from cached and freshly scored distinct texts."""
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    embed = sc.native_embed(lambda c: sc.hash_embedding(c, HASH_DIMS))
    labelled = docs.join(v.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = embed(sc.score_distinct(labelled, "text", tx.cache_key(F.col("text"))))
    rows, _, _ = sc.embed_rows(docs, "text", embed, cache)
    return rows.select("doc_id", F.round(vx.array_sum(F.col("vec")), 6).alias("total"), F.size("vec").alias("width"))


def hash_scorers(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    scored = sc.hash_classify(docs, "text", CLASS_NAMES, 3)
    raw = sc.hash_embedding(F.col("text"), HASH_DIMS, normalise=False)
    return scored.select(
        "doc_id", "label", F.round("score", 6).alias("score"),
        F.array_join(F.transform("top_k", lambda t: t["label"]), ",").alias("top_labels"),
        F.round(vx.array_sum(raw), 6).alias("raw_total"),
        F.round(vx.norm(sc.hash_embedding(F.col("text"), HASH_DIMS)), 6).alias("unit"),
    )


KEYWORDS = [
    (("error", "tag T1001"), "brute_force", 0.92),
    (("click",), "beaconing", 0.88),
    (("purchase", "signup"), "policy_violation", 0.91),
]


def keyword_scorer(spark: SparkSession, sf: str) -> DataFrame:
    c = sc.keyword_class(F.col("description"), KEYWORDS, ("benign_activity", 0.6))
    return v.logs(spark, sf).withColumn("c", c).select("log_idx", F.col("c.label").alias("label"), F.col("c.score").alias("score"))


def vector_functions(spark: SparkSession, sf: str) -> DataFrame:
    vecs = v.vectors(spark, sf)
    shifted = F.transform("vec", lambda x: x.cast("double") * 3 + 0.1)
    probs = vx.softmax(shifted)
    return vecs.select(
        "vec_id", F.round(vx.norm(shifted), 6).alias("norm"), F.round(vx.norm(vx.l2_normalise(shifted)), 6).alias("unit"),
        F.round(vx.dot(F.col("vec"), shifted), 6).alias("dot"),
        F.round(vx.cosine_similarity(F.col("vec"), shifted), 6).alias("cosine"),
        F.round(vx.array_sum(probs), 6).alias("prob_sum"), F.round(F.array_max(probs), 6).alias("prob_max"),
    )


def top_labels(spark: SparkSession, sf: str) -> DataFrame:
    vecs = v.vectors(spark, sf)
    ranked = vx.top_labels(vx.softmax(F.col("vec")), 5, CLASS_NAMES)
    return vecs.select("vec_id", F.array_join(F.transform(ranked, lambda t: t["label"]), ",").alias("labels"))


def pooling(spark: SparkSession, sf: str) -> DataFrame:
    """Eight-value token vectors cut from each embedding, every third token masked."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("vec", t * 8 + 1, 8))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.when(t % 3 == 0, 0).otherwise(1))
    base = v.vectors(spark, sf).select("vec_id", tokens.alias("tokens"), mask.alias("mask"))
    return base.select(
        "vec_id", F.round(vx.array_sum(vx.masked_mean(F.col("tokens"), F.col("mask"), 8)), 6).alias("mean_total"),
        F.round(vx.array_sum(vx.first_token(F.col("tokens"))), 6).alias("first_total"),
    )


def nearest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    found = rt.over_fetch(query_rows(spark, sf), embedded_chunks(spark, sf), 5, 4)
    return found.select(F.col("qid").alias("cluster_id"), F.col("id").alias("chunk_id"), "rank", F.round("dist", 6).alias("dist"))


def boosted_ranking(spark: SparkSession, sf: str) -> DataFrame:
    found = rt.retrieve(query_rows(spark, sf), embedded_chunks(spark, sf))
    return found.select(
        F.col("qid").alias("cluster_id"), "chunk_rank", "chunk_id", F.round("score", 6).alias("score")
    )


def lexical_chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, lx.LexicalIndex]:
    index = cut_lineage(chunk_table(spark, sf), "index")
    return index, lx.lexical_index(index.select(F.col("chunk_id").alias("id"), F.col("content").alias("text")))


def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text against all chunks."""
    asked = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = lx.lexical_search(asked, lexical_chunks(spark, sf)[1], 5)
    return found.select(F.col("qid").alias("item_id"), F.col("id").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


def term_rarity(spark: SparkSession, sf: str) -> DataFrame:
    terms = lexical_chunks(spark, sf)[1].terms
    return terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round("top", 6).alias("top"))


def retrieval_by_words(spark: SparkSession, sf: str) -> DataFrame:
    index, lexical = lexical_chunks(spark, sf)
    asked = rt.incident_queries(profiles_with_samples(spark, sf)).withColumnRenamed("cluster_id", "id")
    found = rt.retrieve_by_words(asked, index, lexical)
    return found.select(F.col("qid").alias("cluster_id"), "chunk_rank", "chunk_id", F.round("score", 6).alias("score"))


def first_sources(spark: SparkSession, sf: str) -> DataFrame:
    lists = rt.chunk_lists(rt.retrieve(query_rows(spark, sf), embedded_chunks(spark, sf)))
    return lists.select(
        F.col("qid").alias("cluster_id"), F.array_join(rt.first_seen_sources("playbook_chunks"), ",").alias("sources")
    )


def query_texts(spark: SparkSession, sf: str) -> DataFrame:
    return query_rows(spark, sf).select(
        F.col("id").alias("cluster_id"), "query", tx.join_techniques(F.col("hints")).alias("hints")
    )


def technique_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose techniques meet those of the log row with the same number."""
    rows = v.logs(spark, sf).select("log_idx", tx.techniques(F.col("description")).alias("hints"))
    tagged = chunk_table(spark, sf).select(
        F.regexp_extract("source_file", "[0-9]+", 0).cast("bigint").alias("log_idx"), "chunk_no",
        tx.split_techniques(F.col("mitre_techniques")).alias("tags"),
    )
    overlap = tx.techniques_overlap(F.col("tags"), F.col("hints"))
    return tagged.join(rows, "log_idx").groupBy("log_idx").agg(
        F.count("*").alias("n"), F.count_if(overlap).alias("n_overlap")
    )


def blank_drop(spark: SparkSession, sf: str) -> DataFrame:
    lines = v.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(tx.strip(F.col("line")) != "").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents")
    return docs.select(
        "doc_id", tx.cache_key(F.col("text")).alias("k"),
        tx.cache_key(F.col("text"), "cls", False, "model-a").alias("k_model"),
    )


def time_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Span and range text from each row to the end of its cluster, and backwards."""
    rows = v.members(spark, sf)
    end = F.max("timestamp").over(Window.partitionBy("cluster_id", "event_type", "severity"))
    return rows.withColumn("end", end).select(
        "log_idx", tx.time_span(F.col("timestamp"), F.col("end")).alias("span"),
        tx.time_span(F.col("end"), F.col("timestamp") - F.expr("INTERVAL 1 SECOND")).alias("back"),
        tx.range_text(F.col("timestamp"), F.col("end")).alias("range"),
    )


def preview_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", tx.shorten(F.col("text")).alias("preview"))


def labels_and_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Human labels, percent and money text; the amounts are exact multiples of 1/8, where rounding rules differ."""
    events = v.table(spark, sf, "events")
    eighth = (F.col("event_id") % 1000) / 8.0
    return events.select(
        "event_id", tx.human_label(F.concat("event_type", F.lit("_of_"), "event_type")).alias("label"),
        tx.fixed(eighth, 2).alias("fixed"), tx.percent_text(eighth / 128.0).alias("percent"),
        tx.money_text(eighth / 16.0).alias("money"),
    )


def incident_text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = profiles_with_samples(spark, sf)
    return rows.select(
        "cluster_id", tx.class_table(F.col("dominant_classes")).alias("classes"),
        tx.severity_lines(F.col("severity_breakdown")).alias("severities"),
        tx.sample_rows(F.col("representative_logs")).alias("samples"),
    )


def playbook_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lists = rt.chunk_lists(rt.retrieve(query_rows(spark, sf), embedded_chunks(spark, sf)))
    return lists.select(F.col("qid").alias("cluster_id"), tx.playbook_block(F.col("playbook_chunks")).alias("block"))


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct actors of any kind: the union of distinct users and distinct addresses."""
    rows = v.logs(spark, sf)
    users = rows.select(F.lit("user").alias("kind"), F.col("user").alias("name")).filter("name IS NOT NULL").distinct()
    addresses = rows.select(F.lit("ip").alias("kind"), F.col("src_ip").alias("name")).filter("name IS NOT NULL").distinct()
    return users.unionByName(addresses)


_T = "'T[0-9]{4}(?:\\.[0-9]{3})?'"
_LAST = "(SELECT *, max(\"timestamp\") OVER (PARTITION BY cluster_id, event_type, severity) AS last FROM members)"


def span_sql(a: str, b: str) -> str:
    secs = f"(greatest(epoch_us({b}) - epoch_us({a}), 0) // 1000000)"
    return (
        f"CASE WHEN {secs} < 60 THEN {secs} || 's' WHEN {secs} < 3600 THEN ({secs} // 60) || 'm ' || ({secs} % 60) || 's' "
        f"WHEN {secs} < 86400 THEN ({secs} // 3600) || 'h ' || (({secs} % 3600) // 60) || 'm' "
        f"ELSE ({secs} // 86400) || 'd ' || (({secs} % 86400) // 3600) || 'h' END"
    )


_BYTES = f"[('0x' || substr(sha256(text), (i % 32) * 2 + 1, 2))::INT / 255.0::DOUBLE for i in range(0, {HASH_DIMS})]"
_STALE = "CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END"
_SHIFT = "[x * 3 + 0.1::DOUBLE for x in vec]"

QUERIES = {
    "h1_techniques": (
        technique_lists,
        f"""WITH {LOGS}, t AS (SELECT log_idx, list_sort(list_distinct(regexp_extract_all(description, {_T}))) AS found FROM logs)
        SELECT log_idx, array_to_string(found, ',') AS techniques, len(found)::INT AS n, split_part(found[1], '.', 1) AS parent FROM t""",
    ),
    "h2_titles_hashes": (
        titles_and_hashes,
        f"WITH {PLAYBOOKS} SELECT source_file, 'Guide ' || doc_id AS title, sha256(content) AS file_hash FROM docs",
    ),
    "h4_chunks": (
        chunks,
        f"""WITH {PLAYBOOKS} SELECT chunk_id, source_file, chunk_no::INT AS chunk_no, playbook_name, section, content,
        mitre_techniques FROM chunks""",
    ),
    "e8_header_state": (
        header_state,
        f"""WITH {PLAYBOOKS} SELECT section, count(*) AS n, min(chunk_no)::INT AS first_no, max(chunk_no)::INT AS last_no,
        sum(length(content))::BIGINT AS chars FROM chunks GROUP BY section""",
    ),
    "c5_change_detection": (
        change_detection, f"SELECT {_STALE} AS status, count(*) AS n FROM documents GROUP BY 1"
    ),
    "c6_upsert": (
        upsert,
        f"""WITH {PLAYBOOKS} SELECT source_file, count(*) AS n_chunks, 0::BIGINT AS n_stale FROM chunks GROUP BY source_file""",
    ),
    "c11_known_hashes": (
        known_hash,
        "SELECT doc_id % 3 = 0 AS stale, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1",
    ),
    "d16_index_stats": (
        index_run,
        f"""WITH {PLAYBOOKS}, s AS (SELECT doc_id, {_STALE} AS status FROM documents),
        n AS (SELECT source_file, count(*) AS n FROM chunks GROUP BY source_file)
        SELECT count(*) FILTER (status <> 'unchanged') AS indexed_files, count(*) FILTER (status = 'unchanged') AS skipped_files,
        coalesce(sum(n) FILTER (status <> 'unchanged'), 0)::BIGINT AS total_chunks
        FROM s JOIN n ON n.source_file = 'doc_' || s.doc_id || '.md'""",
    ),
    "c3_cache_lookup": (
        cache_lookup,
        """WITH cached AS (SELECT DISTINCT text FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, text IN (SELECT text FROM cached) AS hit FROM documents""",
    ),
    "d12_cache_rate": (
        cache_rate,
        """WITH cached AS (SELECT DISTINCT text FROM documents JOIN labels USING (doc_id)),
        m AS (SELECT text IN (SELECT text FROM cached) AS hit FROM documents)
        SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
        round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS hit_rate FROM m""",
    ),
    "c4_scatter_back": (
        scatter_back,
        f"""WITH b AS (SELECT doc_id, {_BYTES} AS v FROM documents)
        SELECT doc_id, round(list_sum(v) / sqrt(list_dot_product(v, v)), 6) AS total, len(v)::INT AS width FROM b""",
    ),
    "j4_hash_scorers": (
        hash_scorers,
        f"""WITH b AS (SELECT doc_id, {_BYTES} AS v, ('0x' || substr(sha256(text), 1, 4))::INT % 6 AS p FROM documents),
        n AS (SELECT *, [{", ".join(f"'{n}'" for n in CLASS_NAMES)}] AS names FROM b)
        SELECT doc_id, names[p + 1] AS label, round(0.9 / 1.4, 6) AS score,
        names[p + 1] || ',' || CASE WHEN p = 0 THEN names[2] || ',' || names[3] WHEN p = 1 THEN names[1] || ',' || names[3]
          ELSE names[1] || ',' || names[2] END AS top_labels,
        round(list_sum(v), 6) AS raw_total, 1.0::DOUBLE AS unit FROM n""",
    ),
    "j5_keyword_scorer": (
        keyword_scorer,
        f"""WITH {LOGS} SELECT log_idx, CASE WHEN contains(lower(description), 'error') OR contains(lower(description), 'tag t1001')
        THEN 'brute_force' WHEN contains(lower(description), 'click') THEN 'beaconing'
        WHEN contains(lower(description), 'purchase') OR contains(lower(description), 'signup') THEN 'policy_violation'
        ELSE 'benign_activity' END AS label,
        (CASE WHEN contains(lower(description), 'error') OR contains(lower(description), 'tag t1001') THEN 0.92
        WHEN contains(lower(description), 'click') THEN 0.88
        WHEN contains(lower(description), 'purchase') OR contains(lower(description), 'signup') THEN 0.91 ELSE 0.6 END)::DOUBLE AS score
        FROM logs""",
    ),
    "h9_vector_functions": (
        vector_functions,
        f"""WITH s AS (SELECT vec_id, vec, {_SHIFT} AS w FROM (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings)),
        e AS (SELECT *, [exp(x - list_max(w)) for x in w] AS ex FROM s)
        SELECT vec_id, round(sqrt(list_dot_product(w, w)), 6) AS norm, 1.0::DOUBLE AS unit,
        round(list_dot_product(vec, w), 6) AS dot, round(list_cosine_similarity(vec, w), 6) AS cosine,
        1.0::DOUBLE AS prob_sum, round(1.0 / list_sum(ex), 6) AS prob_max FROM e""",
    ),
    "e5_top_labels": (
        top_labels,
        f"""WITH r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rn FROM (
          SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)),
        n AS (SELECT [{", ".join(f"'{n}'" for n in CLASS_NAMES)}] AS names)
        SELECT vec_id, string_agg(coalesce(names[i + 1], 'LABEL_' || i), ',' ORDER BY rn) AS labels FROM r, n
        WHERE rn <= 5 GROUP BY vec_id""",
    ),
    "h11_pooling": (
        pooling,
        """WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) // 8 AS t FROM embeddings)
        SELECT vec_id, round(sum(x) FILTER (t % 3 <> 0) / 5, 6) AS mean_total, round(sum(x) FILTER (t = 0), 6) AS first_total
        FROM x GROUP BY vec_id""",
    ),
    "h14_query_texts": (
        query_texts,
        f"""WITH {INCIDENT_SQL} SELECT cluster_id, query,
        array_to_string(list_sort(list_distinct(regexp_extract_all(description, {_T}))), ',') AS hints FROM queries""",
    ),
    "c7_nearest_chunks": (
        nearest_chunks,
        f"""WITH {INCIDENT_SQL},{PLAYBOOKS},{FETCHED} SELECT qid AS cluster_id, id AS chunk_id, rank::INT AS rank,
        round(dist, 6) AS dist FROM fetched""",
    ),
    "j6_lexical_search": (
        lexical_search,
        f"""WITH {PLAYBOOKS},{lexical_sql('benchmark', 'item_id', 'text')}
        SELECT qid AS item_id, id AS chunk_id, rank::INT AS rank, round(score, 6) AS score FROM by_words WHERE rank <= 5""",
    ),
    "j6_term_rarity": (
        term_rarity,
        f"""WITH {PLAYBOOKS},{lexical_sql('benchmark', 'item_id', 'text')}
        SELECT term, df, round(idf, 6) AS idf, round(max(w), 6) AS top FROM c_unit JOIN rarity USING (term) GROUP BY ALL""",
    ),
    "j8_retrieval_by_words": (
        retrieval_by_words,
        f"""WITH {INCIDENT_SQL},{PLAYBOOKS},{lexical_sql('queries', 'cluster_id', 'query')},
        fetched AS (SELECT qid, id, 1 - score AS dist, rank FROM by_words WHERE rank <= 20),{BOOSTED} SELECT qid AS cluster_id,
        chunk_rank::INT AS chunk_rank, id AS chunk_id, round(score, 6) AS score FROM boosted""",
    ),
    "e4_boosted_ranking": (
        boosted_ranking,
        f"""WITH {INCIDENT_SQL},{PLAYBOOKS},{FETCHED},{BOOSTED} SELECT qid AS cluster_id, chunk_rank::INT AS chunk_rank,
        id AS chunk_id, round(score, 6) AS score FROM boosted""",
    ),
    "d10_first_sources": (
        first_sources,
        f"""WITH {INCIDENT_SQL},{PLAYBOOKS},{FETCHED},{BOOSTED},
        f AS (SELECT qid, split_part(id, '::', 1) AS s, min(chunk_rank) AS r FROM boosted GROUP BY ALL)
        SELECT qid AS cluster_id, string_agg(s, ',' ORDER BY r) AS sources FROM f GROUP BY qid""",
    ),
    "h20_playbook_block": (
        playbook_blocks,
        f"WITH {INCIDENT_SQL},{PLAYBOOKS},{FETCHED},{BOOSTED},{PLAYBOOK_BLOCKS} SELECT cluster_id, block FROM playbook_blocks",
    ),
    "c8_technique_overlap": (
        technique_overlap,
        f"""WITH {LOGS},{PLAYBOOKS}, h AS (SELECT log_idx, [split_part(x, '.', 1) for x in regexp_extract_all(description, {_T})] AS p FROM logs)
        SELECT log_idx, count(*) AS n, count(*) FILTER (list_has_any(p, [split_part(x, '.', 1) for x in string_split(mitre_techniques, ',')])) AS n_overlap FROM h JOIN chunks ON source_file = 'doc_' || log_idx || '.md' GROUP BY log_idx""",
    ),
    "b17_blank_drop": (
        blank_drop,
        """SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY doc_id""",
    ),
    "h28_cache_keys": (
        cache_keys,
        """SELECT doc_id, 'mean:1:' || sha256(text) AS k, 'model-a:cls:0:' || sha256(text) AS k_model FROM documents""",
    ),
    "h16_time_spans": (
        time_spans,
        f"""WITH {MEMBERS} SELECT log_idx, {span_sql('"timestamp"', 'last')} AS span, {span_sql('last', '"timestamp" - INTERVAL 1 SECOND')} AS back,
        strftime("timestamp", '%Y-%m-%d %H:%M') || ' → ' || CASE WHEN "timestamp"::DATE = last::DATE THEN strftime(last, '%H:%M')
        ELSE strftime(last, '%Y-%m-%d %H:%M') END AS "range" FROM {_LAST}""",
    ),
    "h20_preview": (
        preview_texts,
        """SELECT doc_id, CASE WHEN length(t) > 500 THEN regexp_replace(substr(t, 1, 500), '\\s+$', '') || '…' ELSE t END AS preview
        FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)""",
    ),
    "h30_labels_numbers": (
        labels_and_numbers,
        """SELECT event_id, upper(event_type[1]) || event_type[2:] || ' Of ' || upper(event_type[1]) || event_type[2:] AS label,
        printf('%.2f', round_even((event_id % 1000) / 8.0, 2)) AS fixed,
        printf('%.1f', round_even((event_id % 1000) / 8.0 / 128.0 * 100, 1)) || '%' AS percent,
        '$' || printf('%.4f', round_even((event_id % 1000) / 8.0 / 16.0, 4)) AS money FROM events""",
    ),
    "h17_text_blocks": (
        incident_text_blocks,
        f"WITH {INCIDENT_SQL},{TEXT_BLOCKS} SELECT cluster_id, classes, severities, samples FROM blocks",
    ),
    "f1_set_operations": (
        set_operations,
        f"""WITH {LOGS} SELECT DISTINCT 'user' AS kind, "user" AS name FROM logs WHERE "user" IS NOT NULL
        UNION ALL SELECT DISTINCT 'ip', src_ip FROM logs WHERE src_ip IS NOT NULL""",
    ),
}
