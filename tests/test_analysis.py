"""Playbooks, retrieval, recommendations, reports and the whole analysis on small inputs."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions import text as tx
from emberline.operators import chunking as ck
from emberline.operators import recommend as rc
from emberline.operators import report as rp
from emberline.operators import retrieve as rt
from emberline.operators import scoring as sc
from emberline.plans import queries_model
from emberline.plans.analyse import _embedded, analyse, index_playbooks, refresh_index
from emberline.sources import tables

DOC = (
    "# Playbook: Alpha\n\n## Overview\nline one\n\n  line two \n```\n# no\n\n## no\n```\nafter\n### Deep\n"
    "T1110.004 and T1059\n# Second\ntext\n## Empty\n## Next\nx"
)


def test_chunking_rules(spark):
    docs = [("a.md", DOC), ("b.md", "no headers\n\njust text T1001"), ("c.md", "\n \n"), ("d.md", "#nothead\n# H\n"), ("e.md", "# A\r\n```sh\r\n## x\r\n")]
    rows = ck.chunk_documents(spark.createDataFrame(docs, "source_file string, content string")).orderBy("chunk_id").collect()
    got = [(r["chunk_id"], r["section"], r["content"]) for r in rows]
    assert got == [
        ("a.md::0", "Overview", "# Playbook: Alpha  \n## Overview\nline one  \nline two\n```\n# no\n\n## no\n```\nafter"),
        ("a.md::1", "Deep", "### Deep\nT1110.004 and T1059"), ("a.md::2", "Second", "# Second\ntext"),
        ("a.md::3", "Empty", "## Empty"), ("a.md::4", "Next", "## Next\nx"),
        ("b.md::0", "", "no headers  \njust text T1001"), ("d.md::0", "", "#nothead"), ("d.md::1", "H", "# H"),
        ("e.md::0", "A", "# A\n```sh\n## x"),
    ]
    assert {r["source_file"]: r["playbook_name"] for r in rows} == {"a.md": "Alpha", "b.md": "b", "d.md": "H", "e.md": "A"}
    assert rows[1]["mitre_techniques"] == "T1059,T1110.004"


def embed(texts):
    return texts.select("cache_key", sc.lexical_embedding(F.col("text"), 64).alias("vec"))


def test_index_lifecycle(spark, tmp_path):
    folder, root = tmp_path / "books", str(tmp_path / "index")
    folder.mkdir()
    (folder / "one.md").write_text("# Playbook: One\n\n## Passwords\nreset the password T1110.004\n")
    (folder / "two.md").write_text("# Two\n## Tunnels\nblock the dns tunnel T1071.004\n## Hosts\nisolate the host\n")
    row = lambda **kw: tuple(index_playbooks(spark, str(folder), root, embed, **kw).first())
    assert row() == (2, 0, 3)
    assert row() == (0, 2, 0)
    (folder / "two.md").write_text("# Two\n## Tunnels\nblock it T1071\n")
    assert row() == (1, 1, 1)
    assert tables.latest_index(spark, root).count() == 2
    assert row(rebuild=True) == (2, 0, 2)
    (folder / "two.md").unlink()
    assert row() == (0, 1, 0) and tables.latest_index(spark, root).count() == 2
    assert row(prune_missing=True) == (0, 1, 0) and tables.latest_index(spark, root).count() == 1
    (folder / "one.md").unlink()
    assert row(prune_missing=True) == (0, 0, 0) and tables.latest_index(spark, root).count() == 0
    assert row(rebuild=True) == (0, 0, 0) and tables.latest_index(spark, root).count() == 0
    (folder / "one.md").write_text("# One\n## Passwords\nreset\n")
    assert row() == (1, 0, 1) and row() == (0, 1, 0) and tables.latest_index(spark, root).count() == 1


def test_index_writes_only_changed_buckets(spark, tmp_path):
    root, files = str(tmp_path / "index"), lambda: {p for p in (tmp_path / "index").rglob("*.parquet")}
    docs = lambda changed: spark.createDataFrame([(f"d{i}.md", f"# D\n## A\ntext {i}{' new' * (i in changed)}\n") for i in range(40)], "source_file string, content string")
    refresh_index(docs(()), root, embed)
    first, (version, named) = files(), tables.manifest(spark, root)
    assert version == 0 and len(first) == len(named) > 10
    refresh_index(docs(()), root, embed)
    assert files() == first and tables.manifest(spark, root) == (0, named)
    refresh_index(docs((3,)), root, embed)
    assert len(files() - first) == 1 and first <= files()
    version, after = tables.manifest(spark, root)
    assert version == 1 and sum(after[b] != named[b] for b in named) == 1
    refresh_index(docs((3, 4)), root, embed)
    assert tables.latest_index(spark, root).count() == 40
    rows = {r["source_file"]: r["content"] for r in tables.latest_index(spark, root).collect()}
    assert rows["d3.md"].endswith("new") and rows["d4.md"].endswith("new") and not rows["d5.md"].endswith("new")
    assert len(first - files()) == 1  # the bucket that neither of the two newest versions names


def test_index_rows_make_their_own_vectors(spark, tmp_path):
    native = sc.native_embed(lambda text: sc.hash_embedding(text, 8))
    made = lambda rows: spark.createDataFrame(rows, "source_file string, content string")
    plain = [(f"d{i}.md", f"# D\n## A\ntext {i}\n## B\n{i}") for i in range(6)]
    told = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in told(_embedded(made([*plain, (None, "# N")]), native))
    odd = [*plain, (None, "# N"), ("n.md", None), ("e.md", ""), ("twice.md", "# T\n## A\none"), ("twice.md", "# T\n## A\ntwo")]
    later = [*plain[2:], (None, "# M"), ("n.md", None), ("e.md", "now"), ("twice.md", "# T\n## A\none"), ("twice.md", "# T\n## A\nnew"), ("d0.md", "# D\nother")]
    for rows, then in ((plain, plain[1:5] + [("d0.md", "other")]), (odd, later)):
        seen = []
        for name, embed_texts in (("own", native), ("joined", lambda texts: native(texts))):
            root = str(tmp_path / f"{name}{len(rows)}")
            stats = [tuple(refresh_index(made(r), root, embed_texts, prune_missing=True).first()) for r in (rows, then, then)]
            seen.append((stats, sorted(map(str, tables.latest_index(spark, root).collect()))))
        assert seen[0] == seen[1]
        assert len(rows) > 6 or seen[0][0] == [(6, 0, 12), (1, 4, 1), (0, 5, 0)]


def test_json_extraction(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', 'so: {"a": {"b": 2}} ok': '{"a": {"b": 2}}', '```json\n{"a": 1}\n``` {': '{"a": 1}', '```{"a": 1}```': '{"a": 1}',
        '```\nnone\n``` then {"a": 1}': '{"a": 1}', "```json {": "```json {", " } x { ": "} x {", "  plain ": "plain", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.extract_json(F.col("t")).alias("got")).collect()
    assert {r["t"]: r["got"] for r in rows} == cases


def test_texts_are_scored_once(spark):
    logs = spark.createDataFrame([(k, f"text {k % 5}") for k in range(20)], "log_idx bigint, description string")
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf.assign(vec=[[1.0]] * len(pdf))[["cache_key", "vec"]]

    once = lambda texts: texts.mapInPandas(counted, "cache_key string, vec array<double>")
    embedded, fresh, _ = sc.embed_rows(logs, "description", once)
    assert embedded.count() == 20 and fresh.count() == 5 and calls.value == 5


def test_retrieval_boost(spark):
    docs = [("cred.md", "# C\n## Reset\nreset password for stuffing T1110.001"), ("dns.md", "# D\n## Block\nblock dns tunnel domain T1071.004")]
    index = ck.chunk_documents(spark.createDataFrame(docs, "source_file string, content string")).withColumn(
        "vec", sc.lexical_embedding(F.col("content"), 64)
    )
    asked = spark.createDataFrame(
        [(1, "dns tunnel domain", []), (2, "dns tunnel domain", ["T1110.004"]), (3, "", ["T1071"])],
        "id bigint, query string, hints array<string>",
    ).withColumn("vec", sc.lexical_embedding(F.col("query"), 64))
    rows = rt.retrieve(asked, index, top_k=2, boost=0.9).collect()
    ranks = {q: [r["source_file"] for r in sorted((r for r in rows if r["qid"] == q), key=lambda r: r["chunk_rank"])] for q in (1, 2, 3)}
    assert ranks == {1: ["dns.md", "cred.md"], 2: ["cred.md", "dns.md"], 3: ["dns.md", "cred.md"]}
    assert rt.retrieve(asked, index, top_k=0).count() == 0
    assert rt.retrieve(asked, index.limit(0), top_k=3).count() == 0


GOOD = {
    "summary": "A summary long enough", "threat_assessment": "An assessment long enough", "relevant_playbooks": ["cited.md"],
    "immediate_actions": ["a"], "investigation_steps": ["b"], "mitre_techniques": ["T1110"], "priority": " HIGH ",
}


def test_response_parsing(spark):
    variants = {
        "plain": json.dumps(GOOD), "fenced": f"text\n```json\n{json.dumps(GOOD)}\n```", "prose": f"so {json.dumps(GOOD)} done",
        "extra": json.dumps({**GOOD, "x": 1}), "short": json.dumps({**GOOD, "summary": "short"}),
        "many": json.dumps({**GOOD, "immediate_actions": ["a"] * 16}), "none": "nothing", "number": json.dumps({**GOOD, "mitre_techniques": [1]}),
        "priority": json.dumps({**GOOD, "priority": "urgent"}), "bare fence": "```\nno braces\n```",
    }
    df = spark.createDataFrame(list(variants.items()), "name string, response string")
    got = {r["name"]: (r["rec"], set(r["rec_errors"])) for r in rc.parse_responses(df).collect()}
    assert all(got[n][0]["priority"] == "high" and not got[n][1] for n in ("plain", "fenced", "prose"))
    assert got["extra"][1] == {"unknown key"} and got["short"][1] == {"summary length"}
    assert got["many"][1] == {"immediate_actions count"} and got["priority"][1] == {"priority unknown"}
    assert got["number"][1] == {"mitre_techniques not a list of texts"}
    assert "not an object" in got["none"][1] and got["bare fence"][0] is None


def test_response_errors_are_listed_without_parsing_each_text_again(spark):
    df = spark.createDataFrame([("a", json.dumps(GOOD)), ("b", "nothing"), ("c", json.dumps({**GOOD, "x": 1})), ("d", None)], "name string, response string")
    listed = rc.parse_responses(df).select("name", F.explode("rec_errors").alias("problem"))
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 4  # the raw text and the extracted one, once each
    got = {(r["name"], r["problem"]) for r in listed.collect()}
    assert ("b", "not an object") in got and {p for n, p in got if n == "c"} == {"unknown key"} and not [1 for n, _ in got if n == "a"]


class Model:
    model_id = "model-a"

    def generate(self, prompt):
        if "cluster: 0\n" in prompt:
            return [rc.Attempt("bad", None, 10, 1, None), rc.Attempt(json.dumps(GOOD), None, 10, 2, 0.25)]
        if "cluster: 1\n" in prompt:
            raise TimeoutError("slow")
        return [rc.Attempt("no object", None, 5, 5, 0.5)]


class Scorer:
    model_id, ready, supports_classification, class_labels = "m", True, True, ["a", "b"]

    def embed(self, texts, pooling, normalise):
        return [[float(len(t)), 1.0] for t in texts]

    def classify(self, texts, top_k):
        return [[("a", 0.75), ("b", 0.25)] for _ in texts]


def scenario(spark):
    """Rows of three scenarios near one-hot vectors, and scattered rows."""
    rng = np.random.default_rng(4)
    kinds = [("ids_alert", "high", "credential stuffing on ssh T1110.004", 40), ("network", "medium", "dns tunnel query", 30),
             ("endpoint", "critical", "container escape pivot", 20)]
    rows, vecs = [], {}
    for k, (kind, severity, text, n) in enumerate(kinds):
        for _ in range(n):
            i = len(rows)
            rows.append((i, f"e{i}", kind, severity, f"{text} {i}", f"10.0.{k}.{i % 5}", f"u{i % 4}"))
            vecs[i] = np.eye(4)[k] + rng.normal(0, 0.01, 4)
    for _ in range(10):
        i = len(rows)
        rows.append((i, f"e{i}", "auth", "low", f"other {i}", None, None))
        vecs[i] = rng.normal(0, 1, 4)
    logs = spark.createDataFrame(
        rows, "log_idx bigint, event_id string, event_type string, severity string, description string, src_ip string, user string"
    ).selectExpr("*", "timestamp_seconds(1700000000 + log_idx * 10) AS timestamp", "cast(null AS STRING) AS dst_ip", "'x' AS action")
    stored = spark.createDataFrame([(rows[i][4], [float(v) for v in x / np.linalg.norm(x)]) for i, x in vecs.items()], "text string, vec array<double>")
    return logs, lambda texts: texts.join(stored, "text").select("cache_key", "vec")


def keyword(rows):
    rules = [(("credential", "ssh"), "credential_stuffing", 0.92), (("dns",), "dns_tunneling", 0.88), (("container",), "container_escape", 0.91)]
    c = sc.keyword_class(F.col("description"), rules, ("benign", 0.6))
    return rows.withColumn("label", c["label"]).withColumn("score", c["score"])


def test_end_to_end(spark):
    logs, embed_logs = scenario(spark)
    docs = [("cred.md", "# C\n## Reset\nreset credential stuffing ssh T1110.001"), ("dns.md", "# D\n## Block\nblock dns tunnel T1071.004")]
    index = ck.chunk_documents(spark.createDataFrame(docs, "source_file string, content string")).withColumn(
        "vec", sc.lexical_embedding(F.col("content"), 64)
    )
    done = analyse(logs, embed_logs, 4, classify=keyword, index=index, embed_query=embed, generator=Model, model="model-a", run_id="r1")
    rows = {r["cluster_id"]: r for r in done.incidents.collect()}
    assert [rows[i]["dominant_event_type"] for i in range(3)] == ["ids_alert", "network", "endpoint"]
    sizes = [rows[i]["cluster_size"] for i in range(3)]
    assert all(size >= n for size, n in zip(sizes, (40, 30, 20)))
    assert {r["dominant_classes"][0]["class_name"]: r["dominant_classes"][0]["count"] for r in rows.values()} == {
        "credential_stuffing": 40, "dns_tunneling": 30, "container_escape": 20}
    assert [rows[i]["recommendation_unavailable"] for i in range(3)] == [False, True, True]
    assert rows[0]["recommendation"]["relevant_playbooks"][0] == "cred.md" and rows[0]["recommendation"]["priority"] == "high"
    assert rows[1]["fallback_reason"] == "TimeoutError: slow" and rows[1]["recommendation"]["priority"] == "medium"
    assert rows[2]["fallback_reason"].startswith("InvalidResponse") and rows[2]["recommendation"]["priority"] == "critical"
    stats = done.stats.first()
    assert (stats["total_logs"], stats["n_clusters"], stats["n_noise"] + sum(sizes)) == (100, 3, 100)
    assert (stats["total_tokens_in"], stats["total_tokens_out"], stats["total_cost_usd"]) == (25, 8, 0.75)
    text = "\n".join(r["value"] for r in rp.report_rows(done.incidents, done.stats, "2026-01-01 00:00:00", "rows.jsonl").collect())
    for part in ("# SOC Incident Report", "🔴 Critical | 1", "🟡 Medium | 1", f"Noise (outlier points) | {stats['n_noise']}", "placeholder recommendations",
                 f"Incident #0 — Credential Stuffing ({sizes[0]} events)", "(92% confidence)", "**Recommendation unavailable**", "Input:** rows.jsonl",
                 f"Representative logs (3 of {sizes[0]})", "`cred.md`", "1. a", "40 high", "Total incidents** | **3**", "$0.7500"):
        assert part in text, part
    assert text.index("Critical Incidents") < text.index("High Incidents") < text.index("Medium Incidents")
    assert "🔵 Low" not in text
    first = json.loads(rp.report_json(done.incidents).first()[0])
    assert first["dominant_classes"][0]["class"] == "container_escape"


def test_skip_and_noise(spark):
    logs, embed_logs = scenario(spark)
    done = analyse(logs, embed_logs, 4, include_noise=True, skip_recommendations=True)
    rows = {r["cluster_id"]: r for r in done.incidents.collect()}
    assert set(rows) == {-1, 0, 1, 2} and all(r["fallback_reason"] == "skipped_by_user" for r in rows.values())
    assert rows[0]["dominant_classes"] == [] and done.stats.first()["model"] == "(skipped)"
    empty = analyse(logs.limit(0), embed_logs, 4, skip_recommendations=True)
    assert empty.incidents.count() == 0 and empty.stats.first()["total_logs"] == 0


def test_cache_and_model_scorers(spark, tmp_path):
    rows = spark.createDataFrame([(0, "aa"), (1, "bbb"), (2, "aa")], "log_idx bigint, description string")
    step = lambda texts: sc.model_embed(texts, Scorer)
    path = str(tmp_path / "cache")
    first, fresh, stats = sc.embed_rows(rows, "description", step, tables.read_cache(spark, path))
    assert tuple(stats.first()) == (0, 3, 0.0) and fresh.count() == 2
    tables.append_cache(path, fresh)
    again, fresh, stats = sc.embed_rows(rows, "description", step, tables.read_cache(spark, path))
    assert tuple(stats.first()) == (3, 0, 1.0) and fresh.count() == 0
    assert {r["log_idx"]: r["vec"] for r in again.collect()} == {0: [2.0, 1.0], 1: [3.0, 1.0], 2: [2.0, 1.0]}
    texts = rows.selectExpr("cast(log_idx AS STRING) AS cache_key", "description AS text")
    assert {r["label"] for r in sc.model_classify(texts, Scorer).collect()} == {"a"}

    class Short(Scorer):
        def embed(self, texts, pooling, normalise):
            return []

    with pytest.raises(Exception, match="returned 0 vectors"):
        sc.model_embed(texts, Short).collect()


class Counting(Scorer):
    """Answers calls of bounded size only, and fails once on each new call."""

    failed: set[str] = set()

    def embed(self, texts, pooling, normalise):
        assert len(texts) <= 4 and (len(texts) == 1 or len(texts) * max(map(len, texts)) <= 60)
        key = "|".join(texts)
        if key not in self.failed:
            self.failed.add(key)
            raise OSError("busy")
        return [[float(len(t)), 1.0] for t in texts]

    def classify(self, texts, top_k):
        assert len(texts) <= 4
        return [[("a" if len(t) % 2 else "b", 1.0)] for t in texts]


def test_calls_are_bounded_and_repeated(spark):
    texts = ["x" * n for n in (1, 70, 3, 12, 12, 5, 30, 2, 9, 9, 200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "log_idx bigint, description string")
    vectors, _, _ = sc.embed_rows(rows, "description", sc.model_embedder(Counting, most=4, chars=60))
    assert {r["log_idx"]: r["vec"] for r in vectors.collect()} == {i: [float(len(t)), 1.0] for i, t in enumerate(texts)}
    classed = sc.model_classifier(Counting, most=4)(rows).collect()
    assert {(r["log_idx"], r["label"]) for r in classed} == {(i, "a" if len(t) % 2 else "b") for i, t in enumerate(texts)}

    class Down(Scorer):
        ready = False

    with pytest.raises(Exception, match="not ready"):
        sc.model_embed(rows.selectExpr("'k' AS cache_key", "description AS text"), Down).collect()


def test_long_texts_in_the_analysis(spark):
    logs, _ = scenario(spark)
    grown = logs.withColumn("description", F.when(F.col("log_idx") < 4, F.concat("description", F.repeat(F.lit(" x"), F.lit(2000)))).otherwise(F.col("description")))
    seen = []

    def embed_texts(texts):
        seen.append(texts.agg(F.max(F.length("text"))).first()[0])
        return texts.select("cache_key", sc.hash_embedding(F.col("text"), 8).alias("vec"))

    cut = analyse(grown, embed_texts, 8, skip_recommendations=True, text_limit=300)
    assert seen[-1] <= 300 and cut.membership.count() == grown.count()
    left = analyse(grown, embed_texts, 8, skip_recommendations=True, text_limit=300, long_texts="quarantine")
    assert left.membership.count() == grown.count() - 4


@pytest.mark.parametrize("kept", [True, False])
def test_run_document(spark, tmp_path, kept):
    """The written lines are one JSON document, also without incidents."""
    sf = "/root/testdata/sf0.001"
    incidents = queries_model.plain_incidents(spark, sf)
    stats = queries_model.run_stats(spark, sf)
    path = tmp_path / "report"
    rp.write_run_json(rp.run_json(incidents if kept else incidents.limit(0), stats), str(path))
    said = json.loads("".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*"))))
    assert said["correlation_id"] == "run0" and said["stats"]["total_logs"] == stats.first()["total_logs"]
    want = [json.loads(r["value"]) for r in rp.report_json(incidents).collect()] if kept else []
    assert said["incidents"] == want and bool(want) == kept
    assert all("class" in c for i in want for c in i["dominant_classes"])
