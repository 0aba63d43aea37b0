"""Sets of hashed word n-grams, computed on whole batches of texts."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial over a word's bytes, of the mix of words, and the finaliser's.
BYTE, WORDS, FIRST, SECOND = np.uint64(0x9E6C63D0876A9A47), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Characters of texts hashed at once; a worker holds some 80 bytes for each.
BATCH = 1_000_000


def finalised(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * FIRST
    x = (x ^ (x >> np.uint64(29))) * SECOND
    return x ^ (x >> np.uint64(32))


def byte_class() -> tuple[np.ndarray, np.ndarray]:
    lower, blank = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
    lower[65:91] += 32
    blank[[32, 9, 10, 11, 12, 13]] = True
    return lower, blank


LOWER, BLANK = byte_class()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BYTE to the power 0 .. n-1 and the inverses, modulo 2^64."""
    inverse = np.uint64(pow(int(BYTE), -1, 1 << 64))
    up, down = np.full(n, BYTE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, text it belongs to); ASCII capitals are lowered, words end at blanks."""
    raw = [t.encode() for t in texts]
    stream = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    blank = BLANK[stream]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(stream) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((LOWER[stream].astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        hashes = finalised((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.searchsorted(borders, starts, side="right")


def sets_of(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; of fewer words, one hash of all; without words, none."""
    if not texts:
        return []
    hashes, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        n = len(hashes) - width + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for k in range(width):
            if n > 0:
                grams = finalised(grams * WORDS + hashes[k : k + n])
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for x in hashes[a:b]:
                    whole = finalised(whole * WORDS + x)
                out.append(whole)
            else:
                out.append(grams[:0])
    return out


def in_batches(batch, text_column: int):
    """(first row, sets) for parts of a record batch with bounded text; a longer text is a part of its own."""
    part, size, first = [], 0, 0
    for k, text in enumerate(batch.column(text_column).to_pylist()):
        text = text or ""
        if part and size + len(text) > BATCH:
            yield first, sets_of(part)
            part, size, first = [], 0, k
        part.append(text)
        size += len(text)
    if part:
        yield first, sets_of(part)
