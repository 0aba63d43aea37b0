"""The pipeline stage by stage over a small folder of tables, against what each stage promises for its own input."""

import hashlib
import random
import zlib

import corpus_pipeline as cp
import public_tokenizers
import pytest
import tiktoken

from wellspan.llm import bpe, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = []
    for k in range(240):
        text = " ".join("###" + w for w in prose(40).split(" ")) if k % 4 == 0 else prose(60)
        if k % 4 == 1:
            text += f" write to person{k}@host{k}.org now"
        rows.append((k, text, "en", ["a", "b", None][k % 3], len(text)))
    base = prose(100).split(" ")
    rows += [(1000 + k, " ".join([*base[:k], "edit", *base[k + 1 :]]), "en", "a", 1) for k in range(20, 30)]
    rows += [(1100 + k, rows[1][1], "en", "b", 1) for k in range(5)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (None, prose(50), None, "b", None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 0 if k % 4 == 0 else 1, 0) for k in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/stage{k}.parquet")
        docs = spark.read.parquet(f"{folder}/stage{k}.parquet")
        if k < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS, name
        out.append(docs.collect())
    return out


def test_quality_drops_rejected_documents_only(stages):
    kept = {r["doc_id"] for r in stages[1]}
    assert not any(k % 4 == 0 for k in kept if k is not None and k < 240)
    assert {k for k in range(240) if k % 4} <= kept and None in kept


def test_one_document_of_each_group_stays(stages):
    before, after = {r["doc_id"] for r in stages[1]}, [r["doc_id"] for r in stages[2]]
    gone = before - set(after)
    assert len(after) == len(set(after)) and gone == {*range(1021, 1030), *range(1100, 1105)} and 1020 in after and 1 in after


def test_personal_data_gives_way(spark, stages):
    texts = {r["doc_id"]: r["text"] for r in stages[3]}
    assert len(texts) == len(stages[2]) and all("write to <email> now" in texts[k] for k in range(1, 240, 4))
    assert all(texts[r["doc_id"]] == r["text"] for r in stages[2] if "@" not in (r["text"] or ""))
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3] if r["text"] is not None)
    left = pii.found(spark.createDataFrame([tuple(r) for r in stages[3]], DOCS)).filter("size(base) > 0")
    assert left.count() == 0


def test_mix_takes_each_document_twice_at_most(stages):
    size = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    counts = {}
    for r in stages[4]:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts) <= {r["doc_id"] for r in stages[3]} and max(counts.values()) <= 2
    assert size(stages[4]) == pytest.approx(1.5 * size(stages[3]), rel=0.05)


def test_tokens_are_those_of_the_library(stages):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = []
    for r in stages[4]:
        ids = library.encode_ordinary(r["text"] or "")
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages[5])


def test_run_is_the_stages_in_turn(spark, folder, stages):
    key = lambda r: zlib.crc32(str(tuple(r)).encode())
    assert sorted(map(key, cp.run(spark, folder).collect())) == sorted(map(key, stages[5]))


def test_mix_leaves_texts_where_they_are_and_near_duplicates_leave_no_tables(spark, tmp_path):
    import os
    import uuid
    from collections import Counter

    from wellspan.llm import mixing
    from wellspan.llm.common import keep_result, keep_table

    r = random.Random(3)
    ids = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(4000)]
    rows = [(k, "w " * r.randint(0, 9), "en", r.choice(["a", "b", "c", None]), 1) for k in [*ids, *ids[:50], None, None]]
    spark.createDataFrame(rows, DOCS.replace("doc_id long", "doc_id string")).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    times = {(x["doc_id"], x["source"]): x["times"] for x in mixing.mixed(docs).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        out = cp.to_target_weights(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = Counter(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = Counter()
    for x in map(tuple, docs.collect()):
        expected[x] += times[x[0], x[3]]
    assert got == +expected and len(got) > 3000
    assert "Exchange hashpartitioning" not in plan  # texts are not shuffled

    kept, paths = None, []

    def build():
        inner = keep_table(spark.range(5))
        paths.extend(p.removeprefix("file:") for p in inner.inputFiles())
        return inner.selectExpr("id + 1 as id")

    kept = keep_result(spark, build)
    assert sorted(x["id"] for x in kept.collect()) == [1, 2, 3, 4, 5]
    assert paths and not any(os.path.exists(p) for p in paths)
