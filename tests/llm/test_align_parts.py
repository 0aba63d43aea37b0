"""Parts of texts have the tokens of their text, and each is encoded and multiplied once."""

import pickle
import random

import numpy as np
import public_tokenizers
import pytest

from wellspan.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", " ", " ", "  ", "   ", "\n", "\n\n", " \n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "a", "It's", "we'LL", "'s", "12", "3", ".", ",", "--", "_", "\xe9", "e\u0301", "日本", "🙂", "नम", "ꟑ", "<s>", "<|endoftext|>"]


def odd_texts(n):
    r = random.Random(5)
    return ["".join(r.choice(ODD) for _ in range(r.randint(1, 25))) for _ in range(n)]


@pytest.fixture
def nothing_known():
    align.remembered.cache_clear()
    yield
    align.remembered.cache_clear()


def test_parts_have_the_tokens_of_their_text():
    texts = odd_texts(1500)
    assert all("".join(" " + p for p in align.parts_of(t)) == " " + t for t in texts)
    assert sum(len(align.parts_of(t)) > 1 for t in texts) > 500
    for encoder in (align.first_tokenizer(A), align.second_tokenizer(B)):
        for text, whole in zip(texts, encoder.exact([" " + t for t in texts])):
            parts = encoder.exact([" " + p for p in align.parts_of(text)])
            assert (None if None in parts else b"".join(parts)) == whole
            ids, n = encoder.tokens(list(align.runs(align.parts_of(text))))
            assert [len(p or b"") // 4 for p in parts] == n.tolist()
            assert ids.astype(np.uint32).tobytes() == b"".join(p or b"" for p in parts)


def test_a_part_is_multiplied_once(nothing_known, monkeypatch):
    r, seen, overlaps = random.Random(2), [], align.overlaps
    words = [f"word{k}" for k in range(50)]
    texts = [" ".join(r.choice(words) for _ in range(200)) for _ in range(40)]
    monkeypatch.setattr(align, "overlaps", lambda a, b: seen.append(int(a.sum())) or overlaps(a, b))
    first = align.block_rows(list(range(40)), texts, A, B)
    assert 0 < sum(seen) <= sum(len(w) + 1 for w in words)  # all bytes of all texts before
    again = align.block_rows(list(range(40)), texts, A, B)
    assert sum(seen) <= sum(len(w) + 1 for w in words)
    assert first[0] == again[0] and (first[1] == again[1]).all() and (first[2] == again[2]).all()


def test_what_is_forgotten_is_learnt_again(nothing_known, monkeypatch):
    texts = [None, "", *odd_texts(300), "a▁b", "fine " * 300]
    keys = list(range(len(texts)))
    want = align.block_rows(keys, texts, A, B)
    monkeypatch.setattr(align, "MEMORY", 2000)
    monkeypatch.setattr(align, "BATCH", 100)
    found = align.block_rows(keys, texts, A, B)
    assert pickle.loads(found[0])[2] == pickle.loads(want[0])[2] and (pickle.loads(found[0])[1] == pickle.loads(want[0])[1]).all()
    assert (found[1] == want[1]).all() and (found[2] == want[2]).all()
    assert align.remembered(A, B).size < 100_000
