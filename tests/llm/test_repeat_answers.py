"""Answers of hash buckets are read back in time that grows with the block, not with buckets times values."""

import time

import numpy as np
import pandas as pd

from wellspan.llm import repeats


def test_answers_of_many_buckets_in_any_order():
    rng = np.random.default_rng(1)
    n_buckets, values = 3000, np.unique(rng.integers(0, 1 << 63, 1_500_000, dtype=np.uint64) * np.uint64(2))
    hit, crowded = rng.random(len(values)) < 0.3, rng.random(len(values)) < 0.1
    cuts = np.searchsorted(repeats.bucket_of(values, n_buckets), np.arange(n_buckets + 1))
    packed = lambda marks, b: np.packbits(marks[cuts[b] : cuts[b + 1]]).tobytes()
    rows = [(b, packed(hit, b), packed(crowded, b)) for b in rng.permutation(n_buckets).tolist()]
    asked = rng.permutation(len(values))[:1000]
    facts = [], [], (values[asked], None, None, None), values, None
    replies, start = pd.DataFrame(rows, columns=["bucket", "hits", "crowded"]), time.process_time()
    found = repeats.replied(facts, replies, n_buckets)
    assert time.process_time() - start < 0.8  # some seconds if every bucket goes through all values
    assert (found[0] == hit[asked]).all() and (found[1] == crowded[asked]).all()


def test_fragments_are_runs_of_windows_inside_a_text():
    rng = np.random.default_rng(2)
    texts = [rng.bytes(n) for n in (0, 99, 100, 101, 131, 400, 1500)] + [b"ab" * 300]
    value, text, start, count, places = repeats.fragments_of(texts)
    seen = sorted((t, k) for t, s, n in zip(text.tolist(), start.tolist(), count.tolist()) for k in range(s, s + n))
    assert seen == [(t, k) for t, raw in enumerate(texts) for k in range(len(raw) - repeats.LENGTH + 1)]
    assert set(value.tolist()) == set(places.tolist())
    again = repeats.fragments_of([texts[6]])
    assert again[0].tolist() == value[text == 6].tolist() and again[3].tolist() == count[text == 6].tolist()
