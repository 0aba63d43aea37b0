"""Token alignment, decontamination and phrases against brute force; equal blocks stay apart."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wellspan.llm import align, bpe, decontaminate, phrases, repeats

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item string, f long, block string"


def some_texts():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(40)]
    prose = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(n))
    shared = prose(30)
    return [
        None, "", " ", "  \n\t", "one", prose(40), prose(40) + shared, shared + " " + prose(300), shared.upper(), shared, "a a a a a a a. a a", "x" * 3000, prose(4000),
        "naïve Über 日本語 🙂 it's we'll <|endoftext|> <s> don't  x\n\n y", "a▁b holds a piece sign", "՘ ꟎ new letters", "\x00 nul \x1c sep", "9 8 7,6;5:4!3?2 1\r0\x0b\x0c", "word " * 500,
    ]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, ["en", None, "de"][k % 3], "s", None, "x", 7, "b") for k, t in enumerate(some_texts())]
    return [*out, (None, "without id " + out[9][1], "en", "s", None, "x", 7, "b"), out[6], out[6]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def aligned_by_hand(rows):
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    bytes_a, bytes_b = align.first_tokenizer(A).table, align.second_tokenizer(B).table
    facts, counts = [], Counter()
    for name, text in rows:
        a, b, groups, pairs = [], [], [], []
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            if not b"".join(bytes_a[i] for i in a) == b"".join(bytes_b[i] for i in b) == (" " + text).encode():
                a, b = [], []
        ends = [[sum(len(t[i]) for i in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 1500 else None for t, ids in ((bytes_a, a), (bytes_b, b))]
        for k, (t, ids) in enumerate(((bytes_a, a), (bytes_b, b))):
            if ends[k] is None:
                total, ends[k] = 0, []
                for i in ids:
                    total += len(t[i])
                    ends[k].append(total)
        i = j = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            group = ([], [])
            while i < len(a) and ends[0][i] <= end:
                group[0].append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= end:
                group[1].append(b[j])
                j += 1
            groups.append(group)
            pairs += [(x, y) for x in group[0] for y in group[1]]
        counts.update(set(pairs))
        facts.append((name, a, b, groups, pairs))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    shown = lambda gs: hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in g) for g in gs).encode()).hexdigest()
    return [(n, len(a), len(b), len(g), len(p), sum(counts[x] == best[x[0]] for x in p), sum(counts[x] for x in p), shown(g) if a else "") for n, a, b, g, p in facts]


def test_alignment(docs, nothing, rows, monkeypatch):
    found = sorted_rows(align.alignment(docs, A, B))
    assert found == sorted(aligned_by_hand([(r[0], r[1]) for r in rows]), key=key)
    assert align.alignment(nothing, A, B).count() == 0
    assert [x for x in found if x[0] == 14][0][1:] == (0, 0, 0, 0, 0, 0, "")  # the piece sign comes back as a space


def test_products(spark, docs):
    r = random.Random(3)
    size_a, size_b = [[r.randint(1, 5) for _ in range(60)] for _ in range(2)]
    size_b = [*size_b, max(0, sum(size_a) - sum(size_b))]
    size_a = [*size_a, max(0, sum(size_b) - sum(size_a))]
    size_a, size_b = ([x for x in s if x] for s in (size_a, size_b))
    owner = [[k for k, n in enumerate(s) for _ in range(n)] for s in (size_a, size_b)]
    want = sorted(Counter(zip(*owner)).items())
    import numpy as np

    a, b, n = align.overlaps(np.array(size_a), np.array(size_b))
    assert [((x, y), z) for x, y, z in zip(a.tolist(), b.tolist(), n.tolist())] == want
    dense = np.array([[r.choice([0, 0, 1, 2]) for _ in range(7)] for _ in range(9)])
    other = np.array([[r.choice([0, 0, 1, 3]) for _ in range(5)] for _ in range(7)])
    rows_of = lambda m: align.Rows.of(np.nonzero(m)[0], np.nonzero(m)[1], m[np.nonzero(m)], len(m))
    product = np.zeros((9, 5), int)
    for i, j, v in rows_of(dense).times(rows_of(other), at_once=6):
        product[i, j] += v
    assert (product == dense @ other).all()
    for row in align.links(docs.filter("doc_id in (5, 13)"), A, B).collect():
        assert sum(x["bytes"] for x in row["overlaps"]) > 0
        assert {(x["a"], x["b"]) for x in row["overlaps"]} <= {(g["a"] + i, g["b"] + j) for g in row["groups"] for i in range(g["n_a"]) for j in range(g["n_b"])}


def hit_by_hand(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for name, text in rows:
        own, hit, ids, longest, first = words(text), set(), set(), 0, None
        for item_id, item in items:
            w = words(item)
            wide = min(window, len(w))
            for i in range(len(w) - wide + 1) if w else ():
                for p in range(len(own) - wide + 1):
                    if own[p : p + wide] == w[i : i + wide]:
                        hit.update(range(p, p + wide))
                        ids |= {str(item_id)} if item_id is not None else set()
                        n = wide
                        while p + n < len(own) and i + n < len(w) and own[p + n] == w[i + n]:
                            n += 1
                        if item_id is not None and n > longest or n == longest and p < first:
                            longest, first = n, p
        out.append((name, len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit), longest, first))
    return out


@pytest.mark.parametrize("how", [decontaminate.Search(), decontaminate.Search(shard=500, slice_bytes=150, pairs=5)])
def test_decontamination(spark, docs, nothing, rows, how):
    t = some_texts()
    tail = " ".join(t[9].split()[12:26])
    items = [(1, t[9]), (20, "Foo bar " + tail), (3, "one"), (3, "nothing of this"), (4, None), (5, " ,. "), (6, "word word word"), (7, t[9]), (8, " ".join(t[12].split()[100:180])), (9, "a a a a a a a a a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.report(docs, bench, how).drop("digest")
    assert sorted_rows(found) == sorted(hit_by_hand([(r[0], r[1]) for r in rows], items), key=key)
    kept = decontaminate.decontaminated(docs, bench, how)
    clean = [x for x, h in zip(rows, hit_by_hand([(r[0], r[1]) for r in rows], items)) if not h[5]]
    assert kept.columns == docs.columns and sorted_rows(kept) == sorted(clean, key=key)
    assert decontaminate.report(nothing, bench, how).count() == 0
    assert decontaminate.report(docs, bench.limit(0), how).filter("contaminated").count() == 0


def phrases_by_hand(rows, support, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        inside = [q for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not inside:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("how", [phrases.Mining(support=4, top=30), phrases.Mining(support=3, top=500, fragment=300, shard=60)])
def test_phrases(docs, nothing, rows, how, monkeypatch):
    monkeypatch.setattr(phrases, "SPELLED", 3)
    found = sorted_rows(phrases.collocations(docs, how))
    assert found == phrases_by_hand([(r[1], r[2]) for r in rows], how.support, how.top)
    assert phrases.collocations(nothing, how).count() == 0
    assert phrases.collocations(docs.limit(3), phrases.Mining()).count() == 0


def test_scores_are_exact(spark):
    numbers = [(10**12 + 7, 3 * 10**13 + 1, 10**12 + 9, 2 * 10**12 + 3), (3, 10, 7, 7), (9_999_999_999, 99_999_999_999_999, 10**10, 10**10 + 1)]
    out = spark.createDataFrame(numbers, "a long, n long, l long, r long").select("*", phrases.score().alias("score")).collect()
    assert [r["score"] for r in out] == [1000 * a * n // (l * r) for a, n, l, r in numbers]


def test_shards_mined_at_their_share_hold_every_frequent_phrase():
    import numpy as np

    r = random.Random(9)
    shards = [np.array([r.choice([0, 1, 1, 2, 3, 4]) for _ in range(r.randint(5, 200))]) for _ in range(9)]
    every, support = Counter(), 25
    for s in shards:
        every.update(tuple(s[i : i + m]) for m in (1, 2, 3) for i in range(len(s) - m + 1) if all(s[i : i + m]))
    total, mined = sum((s > 0).sum() for s in shards), set()
    for s in shards:
        for m, at in phrases.levels(s, 3, max(1, -(-support * int((s > 0).sum()) // int(total)))):
            mined |= {tuple(s[i : i + m]) for i in at}
    assert {p for p, n in every.items() if n >= support} <= mined


def test_equal_blocks_give_back_all_rows(spark, tmp_path):
    rows = [(k, f"word{k} " + "the same passage of some length " * 5, "en", "s", None, "x", 1, "b") for k in range(20)]
    for _ in range(2):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "twice"))
    twice = spark.read.option("maxPartitionBytes", "1").parquet(str(tmp_path / "twice")).repartition(1).limit(0).unionByName(spark.read.parquet(str(tmp_path / "twice")))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for out in (bpe.encoded(twice, path, public_tokenizers.PATTERN), repeats.without_repeats(twice), align.alignment(twice, A, B)):
        counts = Counter(r["doc_id"] for r in out.collect())
        assert counts == Counter({k: 2 for k in range(20)})
