"""Exact repeats of 100 bytes and more: enhanced suffix arrays over the pieces of text that can repeat."""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wellspan.llm.shingles import finalised, powers

#: Bytes of a repeat, of the grams that stand for windows, and grams in a window.
LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1
#: Bytes of text in a block (a longer document is one of its own), hashed at once, and for each bucket of hashes.
BLOCK, BATCH, BUCKET_BYTES = 16_000_000, 2_000_000, 2_000_000
#: A name with more places than this in all texts is crowded: its windows are compared one by one, dealt to this many times the buckets.
CROWD, DEALT = 20_000, 8


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = least(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return least(x[: len(x) - rest], x[rest:]) if rest else x


@lru_cache(maxsize=1)
def usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(BATCH + 1)


def fragments_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, text, first window, windows) of fragments and the value of every place where a window's least gram stands.

    The least gram hash of a window depends on its bytes alone, so equal windows have equal values. A fragment is a longest run of
    windows with one value inside a text.
    """
    long = [k for k, t in enumerate(texts) if len(t) >= LENGTH]
    none = np.zeros(0, np.int64)
    if not long:
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, np.uint64)
    lengths = np.array([len(texts[k]) for k in long])
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    stream = np.frombuffer(b"".join(texts[k] for k in long), np.uint8)
    up, down = (x[: len(stream) + 1] for x in (usual_powers() if len(stream) <= BATCH else powers(len(stream) + 1)))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((stream.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        grams = finalised((total[GRAM:] - total[:-GRAM]) * down[: len(stream) - GRAM + 1])
    least = sliding(grams, GRAMS, np.minimum)
    inside = np.ones(len(stream), bool)
    inside[((begins + lengths)[:, None] - np.arange(1, LENGTH)).ravel()] = False  # these windows would leave their text
    inside = inside[: len(least)]
    starts = np.flatnonzero(inside)
    value = least[starts]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)))  # between texts there is a gap
    at = np.flatnonzero(new)
    text = np.searchsorted(begins, starts[at], side="right") - 1
    count = np.diff(np.append(at, len(starts)))
    masked = np.where(inside, least, np.uint64(0))
    reach = sliding(np.concatenate((np.zeros(GRAMS - 1, np.uint64), masked, np.zeros(GRAMS - 1, np.uint64))), GRAMS, np.maximum)
    places = grams[grams == reach[: len(grams)]]
    # least hashes crowd near zero; mixed once more they fill all buckets evenly
    return finalised(value[at]), np.array(long)[text], starts[at] - begins[text], count, finalised(places)


@lru_cache(maxsize=2)
def block_facts(payload: bytes):
    """(ids, texts, fragments, sorted distinct values, number of places of each in the block) of a block."""
    ids, joined, lengths = pickle.loads(zstandard.decompress(payload))
    ends = np.cumsum(lengths).tolist()
    texts = [joined[e - n : e] for e, n in zip(ends, lengths)]
    parts, places, first = [], [], 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + lengths[last] <= BATCH):
            size += lengths[last]
            last += 1
        value, text, start, count, place = fragments_of(texts[first:last])
        parts.append((value, text + first, start, count))
        places.append(place)
        first = last
    fragments = tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    values, counts = np.unique(np.concatenate(places) if places else np.zeros(0, np.uint64), return_counts=True)
    return ids, texts, fragments, values, counts


def pack64(sorted_values: np.ndarray) -> bytes:
    planes = np.diff(sorted_values, prepend=np.zeros(1, np.uint64)).view(np.uint8).reshape(-1, 8).T
    return zlib.compress(planes.tobytes(), 1)


def unpack64(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)


def bucket_of(values: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)


def pack_blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, number = [], [], 0, 0

        def row() -> pa.RecordBatch:
            payload = zstandard.compress(pickle.dumps((ids, b"".join(texts), [len(t) for t in texts])), 3)
            name = f"{TaskContext.get().partitionId()}-{number}-{hashlib.md5(payload).hexdigest()}"  # equal blocks stay apart
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([payload])], ["block", "payload"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                if texts and size + len(raw) > BLOCK:
                    yield row()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(key)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, "block string, payload binary")


def asked_values(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                *_, values, places = block_facts(payload)
                bucket = bucket_of(values, n_buckets)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                rows = [(block, int(bucket[a]), pack64(values[a:b]), pack_counts(places[a:b])) for a, b in zip(cuts, [*cuts[1:], len(values)])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["block", "bucket", "values", "places"])

    return run


def repeated_values(crowd: int):
    """For one bucket of hashes: which of each block's values stand at two places or more of all texts, and which are crowded."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack64(v) for v in rows["values"]]
        every, which = np.unique(np.concatenate(lists), return_inverse=True)
        places = np.bincount(which, weights=np.concatenate([unpack_counts(c) for c in rows["places"]]))
        ends = np.cumsum([len(v) for v in lists])[:-1]
        marks = lambda least: [np.packbits(x).tobytes() for x in np.split((places > least)[which], ends)]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "hits": marks(1), "crowded": marks(crowd)})

    return run


def replied(facts, replies: pd.DataFrame, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each fragment of the block whether its value is repeated, and whether it is crowded."""
    *_, (value, _, _, _), values, _ = facts
    bucket, asked = bucket_of(values, n_buckets), replies["bucket"].to_numpy(np.int32)
    firsts, ends = (np.searchsorted(bucket, asked, side=side).tolist() for side in ("left", "right"))
    marks = np.zeros((2, len(values)), bool)
    for a, b, *both in zip(firsts, ends, replies["hits"], replies["crowded"]):
        for mark, bits in zip(marks, both):
            mark[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    here = np.searchsorted(values, value)
    return marks[0][here], marks[1][here]


def chosen_fragments(facts, replies: pd.DataFrame, n_buckets: int) -> dict[int, dict[bytes, tuple]]:
    """By bucket the distinct contents of the block's fragments that may repeat: content -> (value, least (id, start)).

    Fragments of crowded values have as many contents as documents, in one bucket. Their windows stand for them, dealt by
    digest to buckets of their own: digest -> (None, least (id, start)), one for each block and window.
    """
    ids, texts, (value, text, start, count), *_ = facts
    hit, crowded = replied(facts, replies, n_buckets)
    keep = np.flatnonzero(hit)
    found: dict[int, dict[bytes, tuple]] = {}
    for v, t, s, n, crowd in zip(*(x[keep].tolist() for x in (value, text, start, count, crowded))):
        if ids[t] is None:
            continue
        if crowd:
            named = [(n_buckets + int.from_bytes(d[:4]) % (DEALT * n_buckets), d, None, k) for k, d in enumerate(digests(texts[t], s, n), s)]
        else:
            named = [((v >> 32) * n_buckets >> 32, texts[t][s : s + n + LENGTH - 1], v, s)]
        for bucket, content, name, at in named:
            part = found.setdefault(bucket, {})
            now = part.get(content)
            if now is None or (ids[t], at) < now[1]:
                part[content] = (name, (ids[t], at))
    return found


def digests(raw: bytes, start: int, count: int) -> list[bytes]:
    """128-bit digests of ``count`` windows from ``start`` on."""
    return [hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest() for k in range(start, start + count)]


def windows_in(value: int | None, content: bytes) -> int:
    """Windows that a content stands for: one if it is a digest."""
    return 1 if value is None else len(content) - LENGTH + 1


def send_fragments(n_buckets: int):
    def run(key: tuple, block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, payload in zip(block["block"][:1], block["payload"][:1]):
            for bucket, part in chosen_fragments(block_facts(payload), replies, n_buckets).items():
                out.append((name, bucket, zlib.compress(pickle.dumps([(v, where, content) for content, (v, where) in part.items()]), 1)))
        return pd.DataFrame(out, columns=["block", "bucket", "fragments"])

    return run


def suffix_array(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in suffix order, common prefix with the one before, content of each place, byte left of each place).

    Ranks by doubling; suffixes end with their content, ends differ from all bytes and sort first. Common prefixes
    come from the stored ranks, from the longest power of two down.
    """
    lengths = np.array([len(c) for c in contents])
    owner = np.repeat(np.arange(len(contents)), lengths + 1)
    codes = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(lengths + 1) - 1
    codes[ends] = 0
    n, levels, reach = len(codes), [codes], 1
    while reach < lengths.max():
        now = levels[-1]
        ahead = np.zeros(n, np.int64)
        ahead[:-reach] = now[reach:]
        ahead[np.arange(n) + reach > ends[owner]] = 0
        levels.append(np.unique(now * (now.max() + 1) + ahead, return_inverse=True)[1] + 1)
        reach *= 2
    order = np.lexsort((np.arange(n), levels[-1]))
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        whole = (a + step <= ends[owner[order[:-1]]]) & (b + step <= ends[owner[order[1:]]])
        same = whole & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        common[same] += step
        a[same] += step
        b[same] += step
    left = np.concatenate(([0], codes[:-1]))
    return order, np.concatenate(([0], common)), owner, left


def repeat_runs(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) leaf of the outermost intervals of the tree: longest runs of leaves whose neighbours share ``least`` bytes."""
    deep = np.concatenate((common >= least, [False])).astype(np.int8)
    step = np.diff(deep, prepend=0)
    return np.flatnonzero(step == 1) - 1, np.flatnonzero(step == -1) - 1


def maximal_repeats(contents: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of every maximal repeat of ``least`` bytes or more with all its occurrences in the joined contents.

    A stack scan over the common prefixes builds the tree of their intervals from the leaves up; an interval is reported if the
    bytes left of its places differ (the start of a content differs from everything), else a longer repeat reports it.
    """
    order, common, _, left = suffix_array(contents)
    merge = lambda x, y: x if x == y and x > 0 else 0  # noqa: E731  0: the left bytes differ
    for low, last in zip(*(x.tolist() for x in repeat_runs(common, least))):
        depth, sides = [*common[low + 1 : last + 1].tolist(), 0], left[order[low : last + 1]].tolist()
        stack: list[list[int]] = []  # length, first leaf, left byte of all its leaves
        for k, height in enumerate(depth):
            start, side = k, sides[k]
            while stack and stack[-1][0] > height:
                length, start, own = stack.pop()
                side = merge(own, side)
                if side == 0:
                    yield length, order[low + start : low + k + 1]
            if height and stack and stack[-1][0] == height:
                stack[-1][2] = merge(stack[-1][2], side)
            elif height:
                stack.append([height, start, side])


def window_order(contents: list[bytes], least: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of all windows that lie inside a content, cut at ``least`` bytes, and where neighbours share that much."""
    lengths = np.array([len(c) for c in contents])
    stream = np.frombuffer(b"\0".join(contents) + bytes(least + 8), np.uint8)
    n = int(lengths.sum() + len(lengths))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    windows = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths - least + 1)[:-1])), lengths - least + 1) + np.arange(int((lengths - least + 1).sum()))
    ranks = np.zeros(n + least, np.uint64)
    for k in range(8):  # eight bytes are one number already
        ranks[:n] = ranks[:n] << np.uint64(8) | stream[k : k + n]
    reach = 8
    while reach < least:
        step = min(reach, least - reach)
        used = np.unique(ranks, return_inverse=True)[1]
        ranks = np.zeros(n + least, np.uint64)
        ranks[: n] = used[:n].astype(np.uint64) << np.uint64(32) | used[step : n + step].astype(np.uint64)
        reach += step
    order = windows[np.argsort(ranks[windows], kind="stable")]
    return order, np.concatenate(([0], np.where(ranks[order[1:]] == ranks[order[:-1]], least, 0)))


def later_windows(contents: list[bytes], first: list[tuple], least: int = LENGTH) -> list[np.ndarray]:
    """For each content which of its windows also start earlier, given where each content stands first.

    Equal windows are the leaves of one outermost interval; all but the earliest of them are later ones.
    """
    order, common = window_order(contents, least)
    owner = np.repeat(np.arange(len(contents)), [len(c) + 1 for c in contents])
    starts = np.concatenate(([0], np.cumsum([len(c) + 1 for c in contents])[:-1]))
    rank = {key: k for k, key in enumerate(sorted({x[0] for x in first}))}
    document = np.array([rank[x[0]] for x in first])[owner]
    place = np.arange(len(owner)) - starts[owner] + np.array([x[1] for x in first])[owner]
    flags = np.zeros(len(owner), bool)
    low, last = repeat_runs(common, least)
    sizes = last - low + 1
    group = np.repeat(np.arange(len(low)), sizes)
    leaves = order[np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(group))] if len(low) else order[:0]
    by = np.lexsort((place[leaves], document[leaves], group))
    sorted_ = leaves[by]
    head = np.concatenate(([True], np.diff(group[by]) > 0)) if len(by) else np.zeros(0, bool)
    at = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0)) if len(by) else np.zeros(0, np.int64)
    lead = sorted_[at]
    flags[sorted_] = (document[sorted_] != document[lead]) | (place[sorted_] != place[lead])
    return [flags[s : s + len(c) - least + 1] for c, s in zip(contents, starts.tolist())]


def repeats_inside(content: bytes) -> bool:
    """Whether a fragment may hold a window twice: of at most GRAMS windows, all hold the gram that ends with the first window."""
    if len(content) < LENGTH + GRAMS:
        at = LENGTH - GRAM
        return content.find(content[at:LENGTH]) < at or content.find(content[at:LENGTH], at + 1) >= 0
    return True


def resolve(rows: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: which windows of each block's fragments also start earlier. A bucket of digests has one place for each block and window."""
    sent = [pickle.loads(zlib.decompress(f)) for f in rows["fragments"]]
    first: dict[bytes, tuple] = {}
    by_value: dict[int, list[bytes]] = {}
    for part in sent:
        for value, where, content in part:
            if content not in first:
                if value is not None:
                    by_value.setdefault(value, []).append(content)
                first[content] = where
            elif where < first[content]:
                first[content] = where
    dup: dict[bytes, np.ndarray] = {}
    shared = [c for group in by_value.values() for c in group if len(group) > 1 or repeats_inside(c)]
    if shared:
        dup = dict(zip(shared, later_windows(shared, [first[c] for c in shared])))
    answers = []
    for part in sent:
        masks = []
        for value, where, content in part:
            n = windows_in(value, content)
            masks.append(np.ones(n, bool) if where != first[content] else dup.get(content, np.zeros(n, bool)))
        answers.append(zlib.compress(np.packbits(np.concatenate(masks)).tobytes(), 1))
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "hits": answers})


def cut_out(n_buckets: int, with_text: bool):
    """For one block: mark the windows that start earlier elsewhere, and report what is left of each text."""

    def run(key: tuple, block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        ids_out, out = [], []
        first_round, second = replies[~replies["resolved"]], replies[replies["resolved"]]
        for payload in block["payload"][:1]:
            facts = block_facts(payload)
            ids, texts, (value, text, start, count), *_ = facts
            chosen = chosen_fragments(facts, first_round, n_buckets)
            masks: dict[bytes, np.ndarray] = {}
            for bucket, hits in zip(second["bucket"], second["hits"]):
                flat, at = np.unpackbits(np.frombuffer(zlib.decompress(hits), np.uint8)).astype(bool), 0
                for content, (v, _) in chosen[bucket].items():
                    n = windows_in(v, content)
                    masks[content] = flat[at : at + n]
                    at += n
            where = {content: w for part in chosen.values() for content, (_, w) in part.items()}
            marked: dict[int, list[tuple[int, np.ndarray | None, int]]] = {}
            hit, crowded = replied(facts, first_round, n_buckets)
            for k in np.flatnonzero(hit).tolist():
                t, s, n = int(text[k]), int(start[k]), int(count[k])
                if ids[t] is None:
                    continue
                if crowded[k]:
                    names = digests(texts[t], s, n)
                    mask = np.array([masks[d][0] or where[d] != (ids[t], at) for at, d in enumerate(names, s)])
                else:
                    content = texts[t][s : s + n + LENGTH - 1]
                    mask = masks[content] if where[content] == (ids[t], s) else None
                marked.setdefault(t, []).append((s, mask, n))
            for t, (name, raw) in enumerate(zip(ids, texts)):
                gone = 0
                spans, left = 0, raw
                if t in marked:
                    windows = np.zeros(len(raw), bool)
                    for s, mask, n in marked[t]:
                        windows[s : s + n] |= True if mask is None else mask
                    step = np.zeros(len(raw) + LENGTH, np.int32)
                    at = np.flatnonzero(windows)
                    step[at] += 1
                    step[at + LENGTH] -= 1
                    removed = np.cumsum(step)[: len(raw)] > 0
                    gone, spans = int(removed.sum()), int((np.diff(removed.astype(np.int8), prepend=0) == 1).sum())
                    left = np.frombuffer(raw, np.uint8)[~removed].tobytes()
                ids_out.append(name)
                row = (len(raw), gone, spans, hashlib.sha256(left).hexdigest())
                out.append((*row, left) if with_text else row)
        frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])
        frame.insert(0, "doc_id", pd.Series(ids_out, dtype=object))
        return frame

    return run


def without_repeats(docs: DataFrame, with_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """Remove every byte inside a 100-byte string that also starts earlier: in a smaller doc_id, or earlier in the same text.

    Every window of 100 bytes is named by its least gram hash. 1. Blocks of documents ask, by hash, which names occur twice.
    2. Only runs of windows with such names travel, each distinct content once for a block; where one name has several
    contents, a suffix array with its interval tree finds the maximal repeats and all their places. A name at more than ``crowd``
    places is not one group: 128-bit digests of its windows travel, one for each block, and are dealt to many tasks. 3. Answers
    return to the blocks. The blocks' texts are shuffled once, compressed, and all readers share that exchange. Returns doc_id, n_bytes,
    n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept.

    Null and empty texts and texts below 100 bytes lose nothing. A null doc_id has no order: its text is left whole and is nobody's
    earlier copy. Rows that repeat a doc_id and a text are one document and lose what that document loses, so both stay;
    a repeat between different texts of one id counts from the smaller start. An empty table gives no rows. Other columns
    are ignored.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = 1 + int(total // BUCKET_BYTES)
    blocks = pack_blocks(docs).repartition("block")
    asked = blocks.mapInArrow(asked_values(n_buckets), "block string, bucket int, values binary, places binary")
    hits = asked.groupBy("bucket").applyInPandas(repeated_values(crowd), "block string, bucket int, hits binary, crowded binary")
    sent = blocks.groupBy("block").cogroup(hits.groupBy("block")).applyInPandas(send_fragments(n_buckets), "block string, bucket int, fragments binary")
    answers = sent.groupBy("bucket").applyInPandas(resolve, "block string, bucket int, hits binary")
    replies = hits.withColumn("resolved", F.lit(False)).unionByName(answers.withColumn("resolved", F.lit(True)), allowMissingColumns=True)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(cut_out(n_buckets, with_text), schema)
