"""Alignment of two tokenizers: sparse incidence matrices of tokens, bytes and groups, multiplied row by row."""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wellspan.llm.bpe import pack, splitter, unpack
from wellspan.llm.common import keep_table

#: Characters of text in a block and encoded at once (a longer text is one of its own), and entries of a product made at once.
BLOCK, BATCH, ENTRIES = 8_000_000, 1_000_000, 4_000_000
#: A pair's number holds two ids of so many bits.
ID_BITS = 16


@dataclass(frozen=True)
class Rows:
    """A sparse matrix by rows: row i holds ``values`` at the columns ``columns[ends[i]:ends[i + 1]]``."""

    ends: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int) -> Rows:
        """From entries in the order of their rows."""
        return Rows(np.searchsorted(rows, np.arange(n_rows + 1)), columns, values)

    def times(self, other: Rows, at_once: int = ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, values) of the product, some rows at a time.

        Gustavson's way: row i of the product is the sum of the rows k of ``other`` for the entries (i, k) of this matrix. All
        those rows are laid out side by side and summed by column.
        """
        sizes = other.ends[self.columns + 1] - other.ends[self.columns]
        before = np.concatenate(([0], np.cumsum(sizes)))
        row_work = before[self.ends]
        first = 0
        while first < len(self.ends) - 1:
            last = max(first + 1, int(np.searchsorted(row_work, row_work[first] + at_once, side="right")) - 1)
            a, b = self.ends[first], self.ends[last]
            n = sizes[a:b]
            spread = np.repeat(np.arange(a, b), n)
            inner = np.arange(len(spread)) - np.repeat(before[a:b] - before[a], n) + np.repeat(other.ends[self.columns[a:b]], n)
            row = np.repeat(np.arange(first, last), row_work[first + 1 : last + 1] - row_work[first:last])
            yield summed(row, other.columns[inner], self.values[spread] * other.values[inner])
            first = last


def summed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order, with those of one place added."""
    key = rows.astype(np.int64) << 32 | columns
    if (key[1:] < key[:-1]).any():
        by = np.argsort(key)
        key, values = key[by], values[by]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    total = np.add.reduceat(values, head) if len(head) else values[:0]
    return key[head] >> 32, key[head] & 0xFFFFFFFF, total


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, bytes they share): the product of the token-byte matrix of A and that of B, turned.

    Both cut the same bytes; every byte is in one token of each.
    """
    n = int(a_sizes.sum())
    a = Rows(np.concatenate(([0], np.cumsum(a_sizes))), np.arange(n), np.ones(n, np.int64))
    b_turned = Rows(np.arange(n + 1), np.repeat(np.arange(len(b_sizes)), b_sizes), np.ones(n, np.int64))
    parts = list(a.times(b_turned))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def groups(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B: a link whose two tokens are both new begins one."""
    new = (np.diff(a, prepend=-1) != 0) & (np.diff(b, prepend=-1) != 0)
    number = np.cumsum(new) - 1
    of_a, of_b = np.empty(n_a, np.int64), np.empty(n_b, np.int64)
    of_a[a], of_b[b] = number, number
    return of_a, of_b


def group_links(a_ids: np.ndarray, a_groups: np.ndarray, b_ids: np.ndarray, b_groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, id of A, id of B, links) for all tokens that share a group: the product of A's group matrix and that of B, turned.

    Tokens of one id in a group are one row with their number as value, so a group that repeats few ids has few entries.
    """
    n = int(a_groups[-1]) + 1 if len(a_groups) else 0
    ga, ia, ca = summed(a_groups, a_ids, np.ones(len(a_ids), np.int64))
    gb, ib, cb = summed(b_groups, b_ids, np.ones(len(b_ids), np.int64))
    by_row = Rows(np.arange(len(ga) + 1), ga, ca)
    for row, id_b, links in by_row.times(Rows.of(gb, ib, cb, n)):
        yield ga[row], ia[row], id_b, links


#: Characters that both regular expression engines class alike; a text with others is cut into words by the tokenizer itself.
CLASSED = re.compile("[^\x00-\u052F\u2010-\u2027\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]")
#: Words that an encoder remembers, and bytes (about) that a worker remembers of the parts of texts.
REMEMBERED, MEMORY = 400_000, 192_000_000
#: Characters that may be white space or nothing to see; no tokenizer's expression takes any other for white space.
BLANK = "\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
#: A space behind such a character, and one at the end; the parts of a text that begins with a space.
UNEVEN, LAST_BLANK = re.compile(f" (?<=[{BLANK}] )"), re.compile(f"[{BLANK}]\\Z")
PARTS = re.compile(f" +[^ ]+(?:(?<=[{BLANK}]) +[^ ]+)*(?: +\\Z)?| +\\Z")
#: Characters of parts that are encoded as one string.
RUN = 1000


def parts_of(text: str) -> list[str]:
    """A text behind one space, cut before each space that stands behind something visible; its parts, each without its first space.

    A pattern of words goes on over no such place, and looks ahead over none. Spaces at the end go with the last part.
    """
    if text[0] == " " or text[-1] == " " or UNEVEN.search(text):
        return [p[1:] for p in PARTS.findall(" " + text)]
    return text.split(" ")


def runs(parts: list[str]) -> Iterator[list[str]]:
    """Parts behind their first space, in lists that are encoded as one string. A list ends where a part ends in a blank, whose tokens
    may depend on what follows."""
    run, size = [], 0
    for part in parts:
        run.append(" " + part)
        size += len(part)
        if size > RUN or LAST_BLANK.search(part, len(part) - 1):
            yield run
            run, size = [], 0
    if run:
        yield run


class Encoder:
    """Ids of texts behind one space as bytes of 32-bit numbers, None where the ids' bytes are not the text's.

    ``whole`` encodes a list of strings that begin with a space or stand where a text was cut, ``table`` has the bytes of each id, and ``cut``
    gives the parts of a text between which the tokenizer never merges, or None. Each distinct part is encoded once. ``at_spaces`` says
    that the parts of ``parts_of`` have the same tokens alone as in their text.
    """

    def __init__(self, whole, table: list[bytes], cut, at_spaces: bool = False):
        self.whole, self.table, self.cut, self.known, self.at_spaces = whole, table, cut, {}, at_spaces
        self.sizes = np.array([len(x) for x in table], np.int64)

    def exact(self, texts: list[str]) -> list[bytes | None]:
        table = self.table
        return [array("I", ids).tobytes() if b"".join([table[i] for i in ids]) == text.encode() else None for text, ids in zip(texts, self.whole(texts))]

    def tokens(self, together: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings, how many each has) for lists of strings that are encoded as one; a string that its ids do not give back has none."""
        table, flat, sizes = self.table, [], []
        joined = ["".join(run) for run in together]
        for run, text, ids in zip(together, joined, self.whole(joined)):
            lengths = list(map(len, run if text.isascii() else map(str.encode, run)))
            if b"".join([table[i] for i in ids]) != text.encode():
                found = [np.frombuffer(x or b"", np.uint32).tolist() for x in self.exact(run)]
                ids = [i for x in found for i in x]
                lengths = [n if x else 0 for n, x in zip(lengths, found)]
            flat += ids
            sizes += lengths
        ids, ends = np.array(flat, np.int64), np.cumsum(sizes)
        reached = np.append(0, np.cumsum(self.sizes[ids]))
        upto = np.searchsorted(reached, ends)
        if not np.array_equal(reached[upto], ends):  # a token lies over a border
            return self.tokens([[x] for run in together for x in run])
        return ids, np.diff(upto, prepend=0)

    def __call__(self, texts: list[str]) -> list[bytes | None]:
        texts = [" " + t for t in texts]
        parts = [self.cut(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in set().union(*(ws for ws in parts if ws)) if w not in known]  # a difference of sets would go through all that is known
        known.update(zip(new, self.exact(new)))
        rest = iter(self.exact([t for t, ws in zip(texts, parts) if ws is None]))
        out = []
        for ws in parts:
            if ws is None:
                out.append(next(rest))
            else:
                try:
                    out.append(b"".join(map(known.__getitem__, ws)))
                except TypeError:  # a part is None
                    out.append(None)
        return out


@lru_cache(maxsize=2)
def first_tokenizer(path: str) -> Encoder:
    """The encoder of a byte-level tokenizers file; special strings are plain text, and merges stay inside words."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    table = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
        table[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    stages = json.loads(tokenizer.to_str())
    by_word = stages["normalizer"] is None and (stages["pre_tokenizer"] or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
    words = splitter(public_tokenizers.PATTERN)
    whole = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    at_spaces = by_word and all(x["special"] for x in stages["added_tokens"])
    return Encoder(whole, table, lambda text: words(text) if by_word and not CLASSED.search(text) else None, at_spaces)


@lru_cache(maxsize=2)
def second_tokenizer(path: str) -> Encoder:
    """The encoder of a sentencepiece model; U+2581 in a piece is a space, a byte piece its byte. The model adds the first space.

    Where no piece has a space behind another character, nothing is merged over the border before a space.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in enumerate(pieces)]
    by_word = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
    words = re.compile(r" +[^ ]+(?: +\Z)?| +\Z").findall  # a last space goes with its word: the model gives none for an empty text
    return Encoder(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), table, words if by_word else lambda text: None, by_word)


def in_batches(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of the texts that hold something, in runs of bounded size."""
    part, size = [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if part and size + len(text) > BATCH:
            yield part
            part, size = [], 0
        part.append(k)
        size += len(text)
    if part:
        yield part


@dataclass
class Aligned:
    """Some texts with their tokens of both kinds: ids, text and group of each token, and the overlap links."""

    texts: np.ndarray
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_text: np.ndarray
    b_text: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    overlap: tuple[np.ndarray, np.ndarray, np.ndarray]


def aligned(texts: list[str | None], a_path: str, b_path: str) -> Iterator[Aligned]:
    """The texts that both tokenizers give back byte for byte behind one space, aligned batch by batch."""
    encode_a, encode_b = first_tokenizer(a_path), second_tokenizer(b_path)
    for part in in_batches(texts):
        raw = [texts[k] for k in part]
        kept = [(k, a, b) for k, a, b in zip(part, encode_a(raw), encode_b(raw)) if a is not None and b is not None]
        if not kept:
            continue
        a_ids, b_ids = (np.frombuffer(b"".join([x[side] for x in kept]), np.uint32).astype(np.int64) for side in (1, 2))
        a_text, b_text = (np.repeat(np.arange(len(kept)), [len(x[side]) // 4 for x in kept]) for side in (1, 2))
        yield aligned_tokens(np.array([x[0] for x in kept]), a_ids, b_ids, a_text, b_text, encode_a.sizes, encode_b.sizes)


def aligned_tokens(texts: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, a_text: np.ndarray, b_text: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """The alignment of texts whose tokens on both sides have the same bytes."""
    links = overlaps(a_sizes[a_ids], b_sizes[b_ids])
    return Aligned(texts, a_ids, b_ids, a_text, b_text, *groups(links[0], links[1], len(a_ids), len(b_ids)), links)


def group_texts(x: Aligned, signs: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """For each text ``a1,a2|b1;a3|b2,b3``: the decimal ids of its groups."""
    shown, lengths = signs
    n = len(lengths) // 3
    a_ends, b_ends = (np.cumsum(np.bincount(g)) for g in (x.a_groups, x.b_groups))
    a_at = np.arange(len(x.a_ids)) + np.append(0, b_ends)[x.a_groups]  # A's tokens of a group come first
    b_at = np.arange(len(x.b_ids)) + a_ends[x.b_groups]
    sign = np.empty(len(a_at) + len(b_at), np.int64)
    sign[a_at] = x.a_ids + n * np.append(np.diff(x.a_groups) != 0, True)
    sign[b_at] = x.b_ids + 2 * n * np.append(np.diff(x.b_groups) != 0, True)
    counts = np.bincount(x.a_text, minlength=len(x.texts)) + np.bincount(x.b_text, minlength=len(x.texts))
    size = lengths[sign]
    flat = shown[sign][np.arange(shown.shape[1]) < size[:, None]].tobytes()
    ends = np.append(0, np.cumsum(size, dtype=np.int64))[np.append(0, np.cumsum(counts))].tolist()
    return [flat[first : last - 1] for first, last in zip(ends, ends[1:])]


@lru_cache(maxsize=1)
def id_signs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below ``n`` with what follows them, as rows of bytes, and their lengths: a comma, the bar after A's last of a group, the
    semicolon after B's last."""
    signs = [b"%d%s" % (k, mark) for mark in (b",", b"|", b";") for k in range(n)]
    width = max(map(len, signs))
    return np.frombuffer(b"".join(s.ljust(width) for s in signs), np.uint8).reshape(-1, width), np.array([len(s) for s in signs], np.uint8)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.room, self.n = np.empty(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            self.room = np.append(self.room[: self.n], np.empty(n, self.room.dtype))
        self.room[self.n : n] = values
        self.n = n

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.n]


class Numbers(dict):
    """The number of each part, given when it is first asked for; ``new`` lists those that nothing else is known of yet."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.new.append(part)
        return number


class Parts:
    """What a worker knows of distinct parts of texts: their groups as text, numbers of tokens and groups, and links by id pair.

    Both tokenizers cut a text between its parts, so groups and links lie inside parts, and a part is encoded and multiplied once.
    A part that one tokenizer does not give back has no tokens.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = first_tokenizer(a_path), second_tokenizer(b_path)
        n_ids = max(len(self.a.table), len(self.b.table))
        if n_ids > 1 << ID_BITS:
            raise ValueError(f"ids of {ID_BITS} bits at most, found {n_ids}")
        self.id_signs = id_signs(n_ids)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.shown, self.size = Numbers(), [], 0
        self.facts = [Grown(np.int64) for _ in range(3)]
        self.ends, self.pairs, self.links = Grown(np.int64), Grown(np.uint32), Grown(np.int64)
        self.ends.add(np.zeros(1, np.int64))

    def of(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's parts, of which all is known then; numbers of earlier calls may be void."""
        if self.size > MEMORY:
            self.forget()
        cut = parts_of if self.a.at_spaces and self.b.at_spaces else lambda text: [text]
        number = self.numbers.__getitem__
        out = [list(map(number, cut(text))) for text in texts]
        if self.numbers.new:
            self.learn(self.numbers.new)
            self.numbers.new = []
        return out

    def learn(self, parts: list[str]) -> None:
        together = list(runs(parts)) if self.a.at_spaces and self.b.at_spaces else [[" " + p] for p in parts]
        (a_ids, n_a), (b_ids, n_b) = self.a.tokens(together), self.b.tokens(together)
        exact = (n_a > 0) & (n_b > 0)
        a_ids, b_ids = a_ids[np.repeat(exact, n_a)], b_ids[np.repeat(exact, n_b)]
        n_a, n_b, texts = n_a * exact, n_b * exact, np.flatnonzero(exact)
        shown, n_groups, entries = [b""] * len(parts), np.zeros(len(parts), np.int64), []
        if len(texts):
            own = np.arange(len(texts))
            x = aligned_tokens(texts, a_ids, b_ids, np.repeat(own, n_a[texts]), np.repeat(own, n_b[texts]), self.a.sizes, self.b.sizes)
            text_of_group = np.empty(int(x.a_groups[-1]) + 1, np.int64)
            text_of_group[x.a_groups] = x.a_text
            n_groups[texts] = np.bincount(text_of_group, minlength=len(texts))
            for k, s in zip(texts.tolist(), group_texts(x, self.id_signs)):
                shown[k] = s
            for group, a, b, links in group_links(x.a_ids, x.a_groups, x.b_ids, x.b_groups):
                entries.append(summed(texts[text_of_group[group]], a << ID_BITS | b, links))
        part, pair, links = summed(*(np.concatenate(c) for c in zip(*entries))) if entries else (np.zeros(0, np.int64),) * 3  # a part may lie in two parts of a product
        self.shown += shown
        for known, new in zip(self.facts, (n_a, n_b, n_groups)):
            known.add(new)
        self.ends.add(self.pairs.n + np.cumsum(np.bincount(part, minlength=len(parts))))
        self.pairs.add(pair)
        self.links.add(links)
        self.size += sum(map(len, parts)) + sum(map(len, shown)) + 12 * len(pair) + 250 * len(parts)


@lru_cache(maxsize=1)
def remembered(a_path: str, b_path: str) -> Parts:
    return Parts(a_path, b_path)


def block_rows(keys: list, texts: list[str | None], a_path: str, b_path: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(what is known of the block's documents, distinct linked id pairs, in how many of the documents each is linked).

    The links of documents are the product of their matrix of parts and the parts' matrix of id pairs.
    """
    facts = np.zeros((len(texts), 4), np.int64)
    digests = [""] * len(texts)
    entries = []
    known = remembered(a_path, b_path)
    for batch in in_batches(texts):
        numbers = known.of([texts[k] for k in batch])
        sizes = np.array([len(x) for x in numbers])
        first = np.cumsum(sizes) - sizes
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
        counts = [x.held[flat] for x in known.facts]
        exact = np.minimum.reduceat(counts[0], first) > 0
        if not exact.any():
            continue
        docs = np.array(batch)[exact]
        for column, x in enumerate(counts):
            facts[docs, column] = np.add.reduceat(x, first)[exact]
        shown = known.shown.__getitem__
        for k, whole, of_text in zip(batch, exact.tolist(), numbers):
            if whole:
                digests[k] = hashlib.sha256(b";".join(map(shown, of_text))).hexdigest()
        flat = flat[np.repeat(exact, sizes)]
        row, part, times = summed(np.repeat(np.arange(len(docs)), sizes[exact]), flat, np.ones(len(flat), np.int64))
        for doc, pair, links in Rows.of(row, part, times, len(docs)).times(Rows(known.ends.held, known.pairs.held, known.links.held)):
            entries.append((docs[doc], pair, links))
    doc, pair, links = (np.concatenate(c) for c in zip(*entries)) if entries else (np.zeros(0, np.int64),) * 3
    facts[:, 3] = np.bincount(doc, weights=links, minlength=len(texts))
    pairs, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
    payload = pickle.dumps((keys, facts, digests, pack(np.bincount(doc, minlength=len(texts))), pack(place), pack(links)))
    return payload, pairs, docs


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each block of documents, with its list of distinct linked id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            payload, pairs, counts = block_rows(keys, texts, a_path, b_path)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary()), pa.array([pack(pairs)], pa.binary()), pa.array([pack(counts)], pa.binary())], ["block", "payload", "pairs", "docs"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(text or "") > BLOCK:
                    yield row()
                    number, keys, texts, size = number + 1, [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text or "")
        if texts:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, payload binary, pairs binary, docs binary")


def listed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, docs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            p = unpack(pairs).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), block)), pa.array(np.arange(len(p), dtype=np.int32)), pa.array((p >> ID_BITS).astype(np.int32)), pa.array((p & (1 << ID_BITS) - 1).astype(np.int32)), pa.array(unpack(docs).astype(np.int64))],
                ["block", "k", "a", "b", "docs"],
            )


def weigh(block: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """For one block: its documents' rows of links times the pairs' counts."""
    out = []
    for payload in block["payload"]:
        keys, facts, digests, sizes, place, links = pickle.loads(payload)
        place, links = unpack(place), unpack(links).astype(np.int64)
        n, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), bool)
        n[counts["k"]], best[counts["k"]] = counts["n"], counts["best"]
        text = np.repeat(np.arange(len(keys)), unpack(sizes))
        total = lambda x: np.add.reduceat(np.append(links * x, 0), np.searchsorted(text, np.arange(len(keys)))) * (facts[:, 3] > 0)
        frame = pd.DataFrame(facts, columns=["n_a", "n_b", "n_groups", "n_links"]).assign(n_best=total(best[place]), count_sum=total(n[place]), groups_sha256=digests)
        frame.insert(0, "doc_id", pd.Series(keys, dtype=object))
        out.append(frame)
    return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((block, k, a, b) of every block's pairs, (a, b, n, best): in how many documents a pair is linked, and whether no pair of its
    id of A is linked in more)."""
    listed = kept.select("block", "pairs", "docs").mapInArrow(listed_pairs, "block long, k int, a int, b int, docs long")
    counts = keep_table(listed.groupBy("a", "b").agg(F.sum("docs").alias("n")))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return listed.drop("docs"), counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How the tokens of two tokenizers meet in every text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizers file and reads a space and the text, B a sentencepiece model that adds the space itself. The
    product of the token-byte matrices gives the overlaps, these the groups of tokens with common ends, and the product of the
    group matrices all links inside groups. Blocks of documents are encoded once and written with their list of distinct id
    pairs; those lists are summed over all blocks, and a block gets back one count for each of its pairs.

    Texts that are null or empty, or that one tokenizer does not give back byte for byte, have no tokens: zeros, and '' for the
    digest. Null and repeated ids are rows like any other, and count as documents. An empty table gives no rows. Other columns are
    ignored. A text and its tokens fit in one task. Ids of more than 16 bits raise an error.
    """
    kept = keep_table(blocks(docs, a_path, b_path))
    listed, counts = pair_counts(kept)
    answers = listed.join(counts, ["a", "b"]).select("block", "k", "n", "best")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows = kept.select("block", "payload")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(weigh, schema)


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For every text with tokens: ``overlaps`` (tokens of A and B by place, bytes they share) and ``groups`` (first token and number of
    tokens on both sides; all pairs of them are linked)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pair, group = pa.list_(pa.struct([(n, pa.int32()) for n in ("a", "b", "bytes")])), pa.list_(pa.struct([(n, pa.int32()) for n in ("a", "n_a", "b", "n_b")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in aligned(batch.column(1).to_pylist(), a_path, b_path):
                a_first, b_first = np.searchsorted(x.a_text, np.arange(len(x.texts))), np.searchsorted(x.b_text, np.arange(len(x.texts)))
                a, b, shared = x.overlap
                n_groups = int(x.a_groups[-1]) + 1
                ga, gb = np.searchsorted(x.a_groups, np.arange(n_groups + 1)), np.searchsorted(x.b_groups, np.arange(n_groups + 1))
                found: list[tuple[list, list]] = [([], []) for _ in x.texts]
                for t, i, j, n in zip(x.a_text[a].tolist(), (a - a_first[x.a_text[a]]).tolist(), (b - b_first[x.a_text[a]]).tolist(), shared.tolist()):
                    found[t][0].append({"a": i, "b": j, "bytes": n})
                owner = x.a_text[ga[:-1]]
                for t, i, n, j, m in zip(owner.tolist(), (ga[:-1] - a_first[owner]).tolist(), np.diff(ga).tolist(), (gb[:-1] - b_first[owner]).tolist(), np.diff(gb).tolist()):
                    found[t][1].append({"a": i, "n_a": n, "b": j, "n_b": m})
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x.texts)), pa.array([f[0] for f in found], pair), pa.array([f[1] for f in found], group)], ["doc_id", "overlaps", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, overlaps array<struct<a:int,b:int,bytes:int>>, groups array<struct<a:int,n_a:int,b:int,n_b:int>>")
