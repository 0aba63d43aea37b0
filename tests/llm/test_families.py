"""Families of op3 meet by marks, and chance does not hide which n-grams are frequent."""

import numpy as np
from pyspark.sql import functions as F

from wellspan.llm import jaccard
from wellspan.llm.bpe import pack

SCHEMA = "family long, id long, digest binary, component long, n long, marks binary"


def family(spark, sets):
    rows = [(0, k, k.to_bytes(16, "big"), c, len(s), jaccard.marks_of(s).tobytes(), s.tobytes()) for k, (c, s) in enumerate(sets)]
    table = spark.createDataFrame(rows, SCHEMA + ", grams binary")
    return table.drop("grams"), table.select("id", "digest", "grams")


def random_set(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))


def test_sets_that_cannot_be_similar_are_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 1000)
    monkeypatch.setattr(jaccard, "WIDE", 2)
    rng = np.random.default_rng(3)
    common = random_set(rng, 100)
    sets = [(k, np.unique(np.append(common[:40], random_set(rng, 60 + k)))) for k in range(80)]
    like = [(80, common), (81, common[:90]), (82, common[5:]), (82, common[6:])]
    dealt = jaccard.dealt_blocks(*family(spark, sets + like)).toPandas()
    assert set(dealt["id"]) == {80, 81, 82, 83}
    pairs = set()
    for key, rows in dealt.groupby(["family", "first", "second"]):
        pairs |= {tuple(x) for x in jaccard.verify_blocks(key, rows)[["a", "b"]].to_numpy().tolist()}
    assert {a for a, _ in pairs} == {81, 82, 83} and {b for _, b in pairs} <= {80, 81, 82}


def test_alike_keeps_all_similar_sets(spark):
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 4, 5, 30, 63, 64, 65, 127, 128, 129, 300):
        base = random_set(rng, n)
        sets += [base, base[: n - n // 10], np.unique(np.append(base, random_set(rng, n // 8))), np.unique(np.append(base[n // 20 :], random_set(rng, n // 10))), random_set(rng, n)]
    n, marks = np.array([len(s) for s in sets]), [jaccard.marks_of(s).view(np.uint64) for s in sets]
    found = {(k, j) for k, others in jaccard.alike(n, marks, n, marks) for j in others.tolist()}
    similar = {(k, j) for k, a in enumerate(sets) for j, b in enumerate(sets) if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))}
    assert similar <= found and len(similar) > 100
    pairs = [(k, j) for k in range(len(sets)) for j in range(len(sets))]
    side = spark.createDataFrame([(k, len(s), len(s), jaccard.marks_of(s).tolist()) for k, s in enumerate(sets)], "id long, low long, high long, marks array<long>")
    assert found == {(r["a"], r["b"]) for r in jaccard.worth_reading(spark.createDataFrame(pairs, "a long, b long"), side).collect()}


def test_a_frequent_gram_shows_above_what_chance_adds(spark):
    counts = np.full((jaccard.RANGES, (1 << jaccard.SKETCH_BITS) // jaccard.RANGES), 155)
    counts[3, 7] += 64
    counts[5, 1] = 0xFFFFFFFF
    table = spark.createDataFrame([(k, pack(c)) for k, c in enumerate(counts)], "range int, counts binary").withColumn("part", F.lit(0))
    level = jaccard.rarity(table, "part").reshape(counts.shape)
    assert level[0, 0] < level[3, 7] < level[5, 1]


def test_near_duplicates_deal_only_like_members_of_a_family(spark, monkeypatch):
    from corpus_pipeline import one_of_each_group

    monkeypatch.setattr(jaccard, "LISTED", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    dealt, real = [], jaccard.dealt_blocks

    def counted(gathered, sets):
        out = real(gathered, sets)
        dealt.append((gathered.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "dealt_blocks", counted)
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 40)) for _ in range(20)]
    texts = [" ".join(lines[k] for k in rng.choice(20, 5, replace=False)) for _ in range(60)]  # of stock lines alone, so they share even their rarest n-grams
    texts += [texts[0] + " more"] * 2
    docs = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in one_of_each_group(spark, docs, "").collect()) == list(range(60))
    assert all(members >= 60 and rows <= members for members, rows in dealt) and dealt
