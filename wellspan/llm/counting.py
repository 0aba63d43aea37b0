"""Token counts from two compiled transducers: one cuts text into words, one counts the tokens of a word byte by byte."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Kinds of characters, and what the cutting transducer reads: kinds with what their neighbours decide.
LETTER, ONE, RV, E, ELL, NUMBER, SPACE, BLANK, MARK, OTHER = range(10)
READ_LETTER, READ_NUMBER, READ_OTHER, READ_SHORT, READ_LONG, READ_LAST_SPACE, READ_LAST_BLANK, READ_INNER_BLANK, READ_END = range(9)
#: States: a word must begin; within letters, numbers, others, blanks; after a space that joins what follows; one or two more characters of a contraction.
START, LETTERS, NUMBERS, OTHERS, BLANKS, JOINED, ONE_MORE, TWO_MORE = range(8)
CHUNK = 256
#: Characters that are counted at once, and remembered words and states before the memory starts anew.
BATCH, MOST_WORDS, MOST_STATES = 1_000_000, 1_000_000, 200_000


def cutting_table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 if a word begins here) for every state and symbol."""
    to, begins = np.zeros((8, 9), np.uint8), np.zeros((8, 9), np.uint8)
    for state in range(8):
        for symbol in range(9):
            if symbol == READ_END:
                at = START, 0
            elif state in (ONE_MORE, TWO_MORE):
                at = (START if state == ONE_MORE else ONE_MORE), 0
            elif symbol in (READ_LETTER, READ_NUMBER, READ_OTHER) or state in (OTHERS, JOINED) and symbol in (READ_SHORT, READ_LONG):
                target = {READ_LETTER: LETTERS, READ_NUMBER: NUMBERS}.get(symbol, OTHERS)
                at = target, state not in (target, JOINED)
            elif symbol in (READ_SHORT, READ_LONG):
                at = (ONE_MORE if symbol == READ_SHORT else TWO_MORE), 1
            elif symbol == READ_LAST_SPACE:
                at = JOINED, 1
            elif symbol == READ_LAST_BLANK:
                at = BLANKS, 1
            else:
                at = BLANKS, state != BLANKS
            to[state, symbol], begins[state, symbol] = at
    return to, begins


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    for chars, kind in (("stmd", ONE), ("rv", RV), ("e", E), ("l", ELL), (" ", SPACE), ("'", MARK)):
        for c in chars:
            table[ord(c)] = kind
    return table


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the transducer reads at each code point; ``ends`` marks the separators between texts."""
    kind = kinds()[points]
    kind[ends] = OTHER
    n = len(kind)
    ahead = np.full(n + 2, 255, np.uint8)
    ahead[:n] = kind
    ahead[:n][ends] = 255
    one, two = ahead[1 : n + 1], ahead[2 : n + 2]
    out = np.full(n, READ_LETTER, np.uint8)
    out[kind == NUMBER] = READ_NUMBER
    out[kind == OTHER] = READ_OTHER
    mark = kind == MARK
    out[mark] = READ_OTHER
    out[mark & (one == ONE)] = READ_SHORT
    out[mark & ((one == RV) & (two == E) | (one == ELL) & (two == ELL))] = READ_LONG
    blank = (kind == SPACE) | (kind == BLANK)
    inner = (one == SPACE) | (one == BLANK) | (one == 255)
    out[blank & inner] = READ_INNER_BLANK
    out[blank & ~inner] = READ_LAST_BLANK
    out[(kind == SPACE) & ~inner] = READ_LAST_SPACE
    out[ends] = READ_END
    return out


def word_starts(read: np.ndarray) -> np.ndarray:
    """Where words begin: state maps of chunks, composed by a parallel prefix scan, then all chunks run from their true state."""
    to, begins = cutting_table()
    n = len(read)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, READ_END, np.uint8)
    padded[:n] = read
    columns = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    flat = to.reshape(-1)
    maps = np.repeat(np.arange(8, dtype=np.uint8)[None, :], rows, axis=0)
    for column in columns:
        maps = flat[maps.astype(np.intp) * 9 + column[:, None]]
    reach = 1
    while reach < rows:  # maps[i] becomes the map of all chunks up to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.zeros(rows, np.intp)
    state[1:] = maps[:-1, START]
    found = np.empty((CHUNK, rows), np.uint8)
    flat_begins = begins.reshape(-1)
    for k, column in enumerate(columns):
        key = state * 9 + column
        found[k] = flat_begins[key]
        state = flat[key].astype(np.intp)
    return np.flatnonzero(found.T.reshape(-1)[:n])


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class WordCounter:
    """A deterministic transducer over the bytes of a word; its transitions carry the change in the number of tokens.

    After each byte the encoding of the bytes so far ends in one certain token: the one that, behind the last token of what
    precedes it, stands unmerged. A state holds the starts from which a token may still grow, each as its node in the
    trie of tokens, the last token before it and the count there relative to the current one. States are compiled when first reached.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in model["added_tokens"]]
        special = set(self.special)
        self.tokens = {raw(t) for t in model["model"]["vocab"] if t not in special}
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.made = {a + b: (k, a, b) for (a, b), k in self.ranks.items()}
        self.child, self.is_token, self.text = {}, [False], [b""]
        for token in self.tokens:
            node = 0
            for byte in token:
                if (key := node << 8 | byte) not in self.child:
                    self.child[key] = len(self.text)
                    self.text.append(self.text[node] + bytes([byte]))
                    self.is_token.append(False)
                node = self.child[key]
            self.is_token[node] = True
        self.grows = [False] * len(self.text)
        for key in self.child:
            self.grows[key >> 8] = True
        self.fits: dict[int, bool] = {}
        self.words: dict[str, int] = {}
        self.restart()

    def restart(self) -> None:
        first = ((0, 0, 0),)
        self.states, self.numbers, self.moves = [first], {first: 0}, {}

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """Byte pair merges of a short word, the least rank first."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether two neighbouring tokens stay apart: undo the later of their merges again and again; a pair across the border
        that ranks before the merge undone would have been merged first (of equal ranks, the left one)."""
        below = len(self.ranks)
        while True:
            if self.ranks.get((left, right), below) < below:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                below, left = a[0], a[2]
            else:
                below, right = b[0] + 1, b[1]

    def stands(self, before: int, node: int) -> bool:
        key = before << 32 | node
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > MOST_WORDS:
                self.fits.clear()
            token = self.text[node]
            known = self.fits[key] = self.apart(self.text[before], token) if before else self.merged([bytes([b]) for b in token]) == [token]
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        grown, own, last = [], None, 0
        for node, before, count in self.states[state]:
            if (node := self.child.get(node << 8 | byte)) is None:
                continue
            if own is None and self.is_token[node] and self.stands(before, node):
                own, last = count + 1, node
            if self.grows[node]:
                grown.append((node, before, count))
        after = (*[(node, before, count - own) for node, before, count in grown], (0, last, 0))
        if (number := self.numbers.get(after)) is None:
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
        return number, own

    def count(self, word: str) -> int:
        if len(self.states) > MOST_STATES:
            self.restart()
        state, total, moves = 0, 0, self.moves
        for byte in word.encode():
            key = state << 8 | byte
            if (step := moves.get(key)) is None:
                step = moves[key] = self.move(state, byte)
            state, change = step
            total += change
        return total

    def counts(self, words: list[str]) -> list[int]:
        known = self.words
        if len(known) > MOST_WORDS:
            known.clear()
        found = list(map(known.get, words))
        for k, n in enumerate(found):
            if n is None:
                word = words[k]
                if (n := known.get(word)) is None:
                    n = known[word] = self.count(word)
                found[k] = n
        return found


@lru_cache(maxsize=2)
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text. Special tokens are cut out first and count one each, as the tokenizer's library has it."""
    counter = word_counter(path)
    pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        parts = [text]
        for mark in counter.special:
            parts = [p for part in parts for p in part.split(mark)] if mark in text else parts
        extra[k] = len(parts) - 1
        pieces += parts
        owner += [k] * len(parts)
    stream = "\n".join(pieces) + "\n"
    points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    starts = word_starts(symbols(points, ends))
    piece = np.searchsorted(ends, starts)
    stops = np.append(starts[1:], len(points))
    stops = np.minimum(stops, ends[piece])
    tokens = counter.counts([stream[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
    return extra + np.bincount(np.asarray(owner, np.intp)[piece], weights=np.asarray(tokens, np.float64), minlength=len(texts)).astype(np.int64)


def counted(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every whole text, by the byte-level BPE file at ``path``.

    Nothing is shuffled: a long text is cut into chunks whose state maps compose, inside the task that reads the row.
    Null and empty texts have 0 tokens. Null and repeated ids are rows like any other. An empty table gives no rows. Other
    columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, part, size = batch.column(2).to_pylist(), [], [], 0
            for text in texts:
                if part and size + len(text) > BATCH:
                    counts.append(count_texts(part, path))
                    part, size = [], 0
                part.append(text)
                size += len(text)
            if part:
                counts.append(count_texts(part, path))
            tokens = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
