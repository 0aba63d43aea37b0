"""Hashing a batch of texts takes memory for a part of it, whatever its length."""

import tracemalloc

import numpy as np
import pyarrow as pa

from wellspan.llm import shingles


def test_parts_of_a_batch_are_small_and_change_no_set():
    texts = [" ".join(f"w{(k * 31 + j) % 977}" for j in range(2000)) for k in range(400)]  # some 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        at = {first + k: s for first, sets in shingles.in_batches(batch, 1) for k, s in enumerate(sets)}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6
    assert len(at) == len(texts) and all(np.array_equal(at[k], shingles.sets_of([texts[k]])[0]) for k in (0, 199, 399))
