"""The encoder's memory of words costs what a call brings, and digests are written as before."""

import time
from array import array

import numpy as np

from wellspan.llm import align


def test_a_call_does_not_go_through_all_remembered_words():
    table = [bytes([k]) for k in range(256)]
    encoder = align.Encoder(lambda texts: [list(t.encode()) for t in texts], table, lambda t: [" " + w for w in t.split(" ")[1:]])
    encoder.known.update((f" {k}", b"") for k in range(align.REMEMBERED - 1000))
    start = time.process_time()
    for k in range(200):
        assert encoder([f"new{k} words"]) == [array("I", list(f" new{k} words".encode())).tobytes()]
    assert time.process_time() - start < 0.5  # some seconds if all are gone through


def test_group_texts_of_several_texts():
    number = lambda *x: np.array(x, np.int64)
    x = align.Aligned(
        texts=number(0, 1), a_ids=number(12, 3, 40000, 7), b_ids=number(5, 65535, 0, 8, 9), a_text=number(0, 0, 0, 1), b_text=number(0, 0, 0, 1, 1),
        a_groups=number(0, 0, 1, 2), b_groups=number(0, 1, 1, 2, 2), overlap=(),
    )
    assert align.group_texts(x, align.id_signs(1 << 16)) == [b"12,3|5;40000|65535,0", b"7|8,9"]
