"""The corpus pipeline, stage by stage on what the stage before kept, against plain versions and planted rows."""

from __future__ import annotations

import corpus_pipeline as cp
import pytest

from emberline.llm.common import stored, table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _shingles(text):
    words = _lower(text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _near_kept(rows):
    """doc_ids that are the smallest of their component of Jaccard at least 0.75."""
    sets, top = {i: _shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                one, two = sorted((root(a), root(b)))
                top[two] = one
    return {i for i in ids if root(i) == i}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = table(spark, SF, "documents").select(*COLUMNS)
    words = [f"w{i}" for i in range(120)]
    near = " ".join([*words[:60], "changed", *words[61:]])
    planted = [(10_001, " ".join(words)), (10_002, " ".join(words).upper()), (10_003, near), (10_004, None), (10_005, ""), (10_006, near.upper())]
    own = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in planted], docs.schema)
    docs.unionByName(own).write.parquet(f"{path}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    assert [name for name, _ in cp.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "best_fit_packing"]
    given = table(spark, folder, "documents")
    plain = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before = plain(given)
        given = stored(stage(spark, given, folder), f"test-{name}")
        kept[name] = plain(given)
        assert sorted(given.columns) == sorted(COLUMNS)
        assert set(kept[name]) <= set(before)
        if name == "toxicity":
            toxic = {r["doc_id"] for r in table(spark, folder, "labels").filter("toxic = 1").collect()}
            gone = {i for i, _ in before} - {i for i, _ in kept[name]}
            assert len(gone - toxic) <= 0.1 * len(before) and {i for i, _ in kept[name]} >= {10_001, 10_002, 10_003}
        if name == "exact_dedup":
            last = {}
            for i, t in before:
                last[_lower(t)] = max(i, last.get(_lower(t), i))
            assert sorted(i for i, _ in kept[name]) == sorted(last.values())
        if name == "minhash_near_dedup":
            assert {i for i, _ in kept[name]} == _near_kept(before)
            assert len({i for i, _ in kept[name]} & {10_001, 10_002, 10_003, 10_006}) == 1
    name, stage = cp.STAGES[-1]
    pieces = stage(spark, given, folder).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in kept["mixing"]}
    room = {}
    for r in pieces:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 4096
