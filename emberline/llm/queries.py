"""The registered queries of the corpus operators, each over its whole table, with DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import (
    block_names, chat_windows, hamming_search, licences, merkle, minhash_forest, mixing, packing, passages, periodic_runs, secrets, toxicity,
    url_filter,
)
from emberline.llm.common import table
from emberline.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_duplicates(table(spark, sf_dir, "documents"))


OP3 = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


def op4_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign codes of all embeddings; the rows with vec_id divisible by 100 are the queries."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming_search.sign_code(F.col("embedding")).alias("code"))
    return hamming_search.top_k(codes, codes.filter("vec_id % 100 = 0"))


OP4 = """
WITH c AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: coalesce(x, 0) > 0) AS bits FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM c q, c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_families(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), F.expr("all_tokens div 2"))


def _mixing_sql() -> str:
    """Water filling level by level, as in the operator, and one running sum per leaf instead of buckets."""
    weights = {
        "domain": "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END",
        "lang": "CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END",
        "source": "1",
    }
    sql = """
WITH d AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    CASE WHEN regexp_extract(source, '([0-9]+)', 1) <> '' THEN 'domain' || (CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 4)
      ELSE 'other' END AS domain
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, 4 * sum(n_tokens) AS capacity FROM d GROUP BY ALL),
b0 AS (SELECT CAST(least(sum(tokens) // 2, sum(capacity)) AS HUGEINT) AS budget FROM leaf)"""
    parents: list[str] = []
    for k, level in enumerate(mixing.LEVELS):
        keys = ", ".join([*parents, level])
        by = f"PARTITION BY {', '.join(parents)} " if parents else ""
        same = " AND ".join(f"n.{p} IS NOT DISTINCT FROM b.{p}" for p in parents) or "true"
        sql += f""",
n{k} AS (SELECT {keys}, sum(capacity) AS capacity, CAST({weights[level]} AS HUGEINT) AS w FROM leaf GROUP BY {keys}),
f{k} AS (
  SELECT n.*, b.budget, capacity * sum(w) OVER ({by}ORDER BY capacity / w, {level} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (b.budget - coalesce(sum(capacity) OVER ({by}ORDER BY capacity / w, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS filled
  FROM (SELECT {', '.join('n.' + x for x in [*parents, level])}, n.capacity, n.w, b.budget FROM n{k} n JOIN b{k} b ON {same}) n, LATERAL (SELECT n.budget) b),
r{k} AS (
  SELECT *, budget - coalesce(sum(capacity) FILTER (WHERE filled) OVER ({by[:-1]}), 0) AS rest,
    sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by[:-1]}) AS open_w,
    sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({by}ORDER BY capacity / w, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM (SELECT {keys}, capacity, w, budget, filled FROM f{k})),
b{k + 1} AS (
  SELECT {keys}, CASE WHEN filled THEN capacity ELSE rest * upto // greatest(open_w, 1) - rest * (upto - w) // greatest(open_w, 1) END AS budget FROM r{k})"""
        parents.append(level)
    return sql + """,
plan AS (
  SELECT l.domain, l.lang, l.source, l.tokens, b.budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS part
  FROM leaf l JOIN b3 b ON l.domain = b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
placed AS (
  SELECT d.*, p.whole, p.part, p.budget, p.tokens,
    CAST('0x' || substr(md5('17:' || p.whole || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(budget AS BIGINT) AS budget, CAST(tokens AS BIGINT) AS leaf_tokens,
  CAST(whole + CASE WHEN part > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= part THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM placed
"""


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are full of the template's own marks."""
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_windows.read_back(chat_windows.chat_windows(turns))


#: (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


OP11 = f"""
WITH rules(r_host, r_path, verdict) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM pages),
f AS (
  SELECT u.*, r_host || r_path AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(r_host) DESC, length(r_path) DESC) AS place
  FROM u LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE place = 1
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree a language; where 7 divides crc32 of the doc_id, the leaf that is folded has one more in n_chars."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*fields[:3], F.col("n_chars").cast("bigint") + 1, fields[4]]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaves = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", merkle.fields_digest(*fields).alias("leaf"), F.when(tampered, merkle.fields_digest(*changed)).alias("other")
    )
    found = merkle.manifest(leaves, "lang", ["doc_id"], "leaf").withColumn("folded_root", merkle.fold(F.coalesce("row.other", "row.leaf"), F.col("path")))
    return found.select(
        "row.doc_id", "row.leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: crc32 in SQL: each byte of the text is mixed in, and eight bits are shifted out after it.
_CRC = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda crc, b: CASE WHEN b < 0 THEN xor(crc >> 1, 3988292384 * (crc & 1)) ELSE xor(crc, b) END))"""
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _merkle_sql() -> str:
    """Levels by recursion, and a walk up from every leaf, through its language's tree and then the tree of subroots."""
    digest = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    changed = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text")) + ")"

    def levels(name: str, start: str) -> str:
        return f"""{name} AS (
  SELECT tree, 0 AS level, k, h, count(*) OVER (PARTITION BY tree) AS m FROM {start}
  UNION ALL
  SELECT tree, level, k, h, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, level + 1 AS level, k // 2 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM {name} WHERE m > 1 GROUP BY tree, level, k // 2))"""

    def walk(name: str, start: str, nodes: str, tops: str) -> str:
        return f"""{name} AS (
  SELECT id, tree, k, 0 AS level, proof, f FROM {start}
  UNION ALL
  SELECT w.id, w.tree, w.k // 2, w.level + 1, w.proof || coalesce(s.h, ''),
    sha256(CASE WHEN w.k % 2 = 0 THEN w.f || coalesce(s.h, '') ELSE s.h || w.f END)
  FROM {name} w JOIN {tops} t ON t.tree = w.tree AND w.level < t.level
  LEFT JOIN {nodes} s ON s.tree = w.tree AND s.level = w.level AND s.k = xor(w.k, 1))"""

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {digest} AS leaf, CASE WHEN {_CRC.format('doc_id')} % 7 = 0 THEN {changed} END AS other FROM documents),
l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, row_number() OVER () AS id, leaf AS h FROM d),
{levels('lv', 'l')},
sub AS (SELECT tree, level, h FROM lv WHERE m = 1),
u AS (SELECT 0 AS tree, tree AS of, row_number() OVER (ORDER BY tree) - 1 AS k, h FROM sub),
{levels('uv', 'u')},
top AS (SELECT tree, level, h FROM uv WHERE m = 1),
low AS (SELECT id, tree, k, '' AS proof, coalesce(other, leaf) AS f FROM l),
{walk('w', 'low', 'lv', 'sub')},
mid AS (SELECT w.id, 0 AS tree, u.k, w.proof, w.f FROM w JOIN sub ON sub.tree = w.tree AND sub.level = w.level JOIN u ON u.of = w.tree),
{walk('x', 'mid', 'uv', 'top')}
SELECT l.doc_id, l.leaf, sub.h AS subroot, top.h AS root, sha256(x.proof) AS proof_sha256, x.f AS folded_root, x.f = top.h AS verified
FROM l JOIN sub ON sub.tree = l.tree JOIN x ON x.id = l.id JOIN top ON x.level = top.level
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; where 10 divides crc32 of the doc_id, the words from a place on repeat a period, as the contract says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    split = docs.withColumn("g", F.expr("h div 10")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n = F.size("words")
    placed = split.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.expr("(size(words) - a) div (3 + g % 8)"))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    repeated = placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    best = periodic_runs.greatest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")
    )), "")
    return periodic_runs.periodic_runs(repeated).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_best_fit_packing": (op2_best_fit_packing, None),
    "op3_exact_dedup": (op3_exact_dedup, OP3),
    "op4_hamming_top_k": (op4_hamming_top_k, OP4),
    "op5_passage_dedup": (op5_passage_dedup, None),
    "op6_licence_scan": (op6_licence_scan, None),
    "op7_minhash_near_dedup": (op7_minhash_near_dedup, None),
    "op8_secret_scan": (op8_secret_scan, None),
    "op9_mixing": (op9_mixing, _mixing_sql()),
    "op10_chat_windows": (op10_chat_windows, None),
    "op11_url_filter": (op11_url_filter, OP11),
    "op12_merkle_manifest": (op12_merkle_manifest, _merkle_sql()),
    "op13_periodic_runs": (op13_periodic_runs, None),
}


def _prepared(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def catalogue() -> dict[str, tuple[Query, str | None]]:
    return {name: (_prepared(query), sql) for name, (query, sql) in QUERIES.items()}
