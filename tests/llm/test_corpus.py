"""Corpus operators against brute force on a small fixture with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wellspan.llm import bpe, counting, jaccard, mixing, pii, quality, repeats, rules, sharding, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _n long, part string"
PASSAGE = " ".join(f"shared{k}" for k in range(60))


def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = prose(120).split(" ")
    near = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in range(0, 120, 3)]
    return [
        None, "", "  \n\t ", "one two three", "One two THREE", prose(50), *near, " ".join(base), " ".join(base), prose(80) + PASSAGE + prose(9), PASSAGE + " " + prose(70), "for " * 4000, prose(3000),
        "naïve Über 日本語 🙂 it's we'll <|endoftext|> don't  x\n\n y", "mail a.b@c.de and 4111 1111 1111 1111 or +1 (212) 555-0100 at 192.168.0.1, 999.1.1.1 x@y", "9" * 3000, "a line\na line\nb line\n\n", "\x00 nul   sep",
    ]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, "en", ["a", "b", None, "c"][k % 4], None, "x", 1, "p") for k, t in enumerate(texts())]
    return [*out, (None, "without id " + PASSAGE, None, "a", None, "x", 1, "p"), out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sharding(docs, nothing, rows):
    out = sharding.shard(docs).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    got = by_id(sharding.shard(docs))
    assert all(got[k]["text_crc32"] == zlib.crc32((t or "").encode()) and got[k]["size"] == len((t or "").encode()) + 1 for k, t, *_ in rows)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, sharding.shard(docs.repartition(5)).collect()), key=str)
    assert sharding.shard(nothing).count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000, 1013):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
        assert sorted(got) == list(range(n))


def test_mixing(docs, nothing, rows):
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    for r in out:
        assert r["target"] <= 2 * r["source_size"]
    total = sum(r["size"] for r in out)
    targets = {r["source"]: r["target"] for r in out}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))
    assert mixing.mixed(nothing).count() == 0


def test_rules(docs, nothing, rows):
    got = by_id(rules.judged(rules.ledger(docs)))
    for k, text, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    table = {(r["policy"], r["rule"]): r for r in rules.ablations(rules.ledger(docs)).collect()}
    assert table["base-1", "too_few_words"]["n_failed"] == sum(len(WORD.findall(r[1] or "")) < 20 for r in rows)
    assert rules.ledger(nothing).count() == 0


def test_lasso_meets_its_optimality_conditions():
    random = np.random.default_rng(5)
    fires = (random.random((200, 30)) < 0.3).astype(float)
    fires[:, 15:] = fires[:, :15] * fires[:, [1]]
    label, n = (random.random(200) < 1 / (1 + np.exp(1 - 3 * fires[:, 0]))).astype(float), random.integers(1, 50, 200).astype(float)
    intercept, weights = quality.lasso_weights(fires, label, n, 0.01)
    rest = n / n.sum() * (1 / (1 + np.exp(-(intercept + fires @ weights))) - label)
    slope = fires.T @ rest
    assert abs(rest.sum()) < 1e-6 and abs(slope).max() < 0.01 + 1e-6
    assert abs(slope + 0.01 * np.sign(weights))[weights != 0].max() < 1e-6 and 0 < (weights != 0).sum() < 30


def test_quality(spark, docs, nothing):
    r = random.Random(3)
    many = [(k, " ".join(("###" if k % 3 == 0 else "") + "w" + str(r.randint(0, 99)) for _ in range(40)), "x") for k in range(300)]
    table = spark.createDataFrame(many, "doc_id long, text string, upper string")
    labels = spark.createDataFrame([*[(k, 0 if k % 3 == 0 else 1, 0) for k in range(300)], (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.classified(table, labels))
    assert all(got[k]["predicted"] == (0 if k % 3 == 0 else 1) for k in range(300)) and all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(300))
    assert quality.classified(nothing, labels).count() == 0
    alone = quality.classified(docs, labels.limit(0)).collect()
    assert {x["score"] for x in alone} == {0.5}


def test_tokens(docs, nothing, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = by_id(bpe.encoded(docs, path, public_tokenizers.PATTERN, with_ids=True))
    for k, text, *_ in rows:
        ids = want.encode_ordinary(text or "")
        assert list(got[k]["ids"]) == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encoded(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_token_counts(docs, nothing, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_id(counting.counted(docs, path))
    assert all(got[k]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids) and got[k]["n_bytes"] == len((t or "").encode()) for k, t, *_ in rows)
    assert counting.counted(nothing, path).count() == 0
    r = random.Random(1)
    bits = ["'s", "'ll", "'", " ", "  ", "\n", "x", "É", "12", "!", "<|endoftext|>", "\t", "日", "=="]
    mixed = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(500)]
    assert counting.count_texts(mixed, path).tolist() == [len(e.ids) for e in library.encode_batch(mixed, add_special_tokens=False)]


def components(ids, links):
    least = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_jaccard(docs, nothing, rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, t, *_ in rows:
        w = WORD.findall((t or "").translate(lower))
        if k is not None:
            sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    out = jaccard.joined(docs).collect()
    assert len(out) == len(rows) and len(links) > 40
    for r in out:
        assert r["component_id"] == want.get(r["doc_id"]) and (r["doc_id"] is None or r["n_shingles"] == len(sets[r["doc_id"]]))
    assert jaccard.joined(nothing).count() == 0


def test_jaccard_by_blocks(docs, rows, monkeypatch):
    want = {r["doc_id"]: r["component_id"] for r in jaccard.joined(docs).collect()}
    monkeypatch.setattr(jaccard, "LISTED", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 500)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.joined(docs).collect()} == want


def test_repeats(docs, nothing, rows):
    seen, want = set(), {}
    for k, t, *_ in sorted((r for r in rows[:-1] if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        late = []
        for s in range(len(raw) - 99):
            (late.append(s) if raw[s : s + 100] in seen else seen.add(raw[s : s + 100]))
        for s in late:
            gone[s : s + 100] = b"\1" * 100
        left = bytes(c for c, g in zip(raw, gone) if not g)
        want[k] = (len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest())
    got = by_id(repeats.without_repeats(docs))
    assert sum(w[1] > 0 for w in want.values()) > 5
    for k, w in want.items():
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == w
    assert got[None]["n_removed"] == 0 and repeats.without_repeats(nothing).count() == 0


def test_crowded_names_are_dealt(docs, rows):
    r = random.Random(3)
    noise = lambda: "".join(r.choice("abcdefgh ") for _ in range(150)).encode()
    texts = [noise() + PASSAGE.encode() + noise() for _ in range(60)]
    facts = (list(range(60)), texts, *(lambda f: (f[:4], *np.unique(f[4], return_counts=True)))(repeats.fragments_of(texts)))
    asked = pd.DataFrame({"block": ["x"], "bucket": [0], "values": [repeats.pack64(facts[3])], "places": [repeats.pack_counts(facts[4])]})
    groups = lambda crowd: repeats.chosen_fragments(facts, repeats.repeated_values(crowd)(asked), 1)
    names = lambda crowd: Counter(v for part in groups(crowd).values() for v, _ in part.values() if v is not None)
    assert max(names(10**6).values()) > 40 and max(names(40).values(), default=0) <= 40
    assert len(groups(40)) > 4 and max(len(p) for b, p in groups(40).items() if b) < 0.5 * sum(len(p) for p in groups(40).values())
    whole = {(x["doc_id"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.without_repeats(docs).collect()}
    dealt = repeats.without_repeats(docs, crowd=1).collect()
    assert len(dealt) == len(rows) and {(x["doc_id"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in dealt} == whole


def test_maximal_repeats():
    found = {(n, len(p)) for n, p in repeats.maximal_repeats([b"xabcabcdy", b"zabcdw"], 3)}
    assert found == {(4, 2), (3, 3)}


def test_personal_data(docs, nothing, rows):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, value):
        d = [int(c) for c in value if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    got = by_id(pii.report(pii.found(docs)))
    for k, t, *_ in rows:
        spans = sorted((m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if passes(kind, m.group()))
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[k][f"n_{kind}"] for kind in patterns] == [sum(s[3] == kind for s in spans) for kind in patterns]
    assert pii.found(nothing).count() == 0


def test_contexts_reveal_identifiers(spark):
    known = [(k, f"please write to user{k}@host{k}.org today") for k in range(8)]
    table = spark.createDataFrame([*known, (100, "please write to hidden7@intranet today"), (101, "version 7@beta of it")], "doc_id long, text string")
    got = by_id(pii.report(pii.found(table)))
    assert got[100]["spans"] == "email:16:32" and got[100]["n_email"] == 0 and got[101]["spans"] == ""
    clean = pii.found(table, pii.Bootstrap(), "text").select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert "please write to <email> today" in {r["t"] for r in clean} and not any("user3" in r["t"] for r in clean)


def test_contexts_reveal_identifiers_with_blanks(spark):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "3000 0000 0000 04", "6011 0000 0000 0004", "4012 8888 8888 1881"]
    known = [(k, f"please call me on +1 (212) 555-010{k} today") for k in range(10)] + [(20 + k, f"charge the card {c} now") for k, c in enumerate(cards)]
    more = [(100, "please call me on 555 123 4567, today"), (101, "charge the card 1234 5678 9012 3456 now"), (102, "in all 555 123 4567 of them"), (103, "call me on 5551234568 10.0.0.1 12")]
    got = by_id(pii.report(pii.found(spark.createDataFrame([*known, *more], "doc_id long, text string"))))
    counts = lambda k: tuple(got[k][f"n_{kind}"] for kind in pii.KINDS)
    assert {counts(k) for k in range(10)} == {(0, 0, 0, 1)} and {counts(20 + k) for k in range(6)} == {(0, 0, 1, 0)} and counts(103) == (0, 1, 0, 0)
    assert got[100]["spans"] == "phone:18:31" and got[100]["n_phone"] == 0
    assert got[101]["spans"] == "card:16:35" and got[101]["n_card"] == 0
    assert got[102]["spans"] == "" and got[103]["spans"] == "phone:11:21,ip:22:30"


def test_vectors(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=48)
    data = [(k, (centre + 0.12 * r.normal(size=48)).tolist(), 1) for k in range(40)] + [(100 + k, r.normal(size=48).tolist(), k % 3) for k in range(80)]
    data += [(300, data[0][1], 1), (301, data[0][1], 2), (302, [0.0] * 48, 1), (303, None, 1), (304, [float("nan")] * 48, 1), (305, data[1][1], None), (306, [], 1), (307, data[2][1][:10], 1), (None, data[3][1], 1)]
    table = spark.createDataFrame([(*x, "n") for x in data], "vec_id long, embedding array<double>, label int, n string")
    usable = [x for x in data if x[0] is not None and x[1] and len(x[1]) == 48 and x[2] is not None and np.isfinite(x[1]).all() and np.any(x[1])]
    links = {(a[0], b[0]) for a in usable for b in usable if a[0] < b[0] and a[2] == b[2] and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93}
    want = components([x[0] for x in data if x[0] is not None], links)
    out = vectors.linked(table, vectors.Hashing(block=16)).collect()
    assert len(out) == len(data)
    degree = Counter(x for pair in links for x in pair)
    assert sum(r["n_links"] for r in out) >= 0.9 * sum(degree.values()) and all(r["n_links"] <= degree[r["vec_id"]] for r in out)
    assert all(r["component_id"] == want.get(r["vec_id"]) and r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in out)
    assert vectors.linked(table.limit(0)).count() == 0


def test_marks_never_part_similar_sets(spark):
    r = random.Random(5)
    cases = []
    for n in [1, 2, 5, 9, 60, 64, 65, 100, 128, 129, 500, 1000]:
        for share in [0.0, 0.3, 0.6, 0.79, 0.8, 0.81, 0.9, 1.0]:
            common = [r.getrandbits(64) for _ in range(n)]
            left = set(common) | {r.getrandbits(64) for _ in range(r.randint(0, int(n * (1 - share)) + 1))}
            right = set(common) | {r.getrandbits(64) for _ in range(r.randint(0, int(n * (1 - share)) + 1))}
            if share == 0.0:
                right = {r.getrandbits(64) for _ in range(n)}
            cases.append((np.array(sorted(left), np.uint64), np.array(sorted(right), np.uint64)))
    sizes = spark.createDataFrame([(k, len(s), len(s), jaccard.marks_of(s).tolist()) for k, s in enumerate(x for pair in cases for x in pair)], "id long, low long, high long, marks array<long>")
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(cases))], "a long, b long")
    kept = {row["a"] // 2 for row in jaccard.worth_reading(pairs, sizes).collect()}
    similar = {k for k, (a, b) in enumerate(cases) if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))}
    assert similar <= kept and len(similar) > 20
    assert not any(k in kept for k, (a, b) in enumerate(cases) if len(a) >= 60 and not len(np.intersect1d(a, b)))


def test_hashes_find_pairs_at_the_threshold_for_every_number_of_vectors():
    r, how = np.random.default_rng(1), vectors.Hashing()
    assert [how.joined(n, 64) for n in (10, 5_000, 500_000, 50_000_000)] == [2, 3, 4, 5]
    x, z = r.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for joined in (2, 3, 4, 5):
        a, b = vectors.bucket_codes(x, how, joined), vectors.bucket_codes(y, how, joined)
        assert ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2)).mean() > 0.97
