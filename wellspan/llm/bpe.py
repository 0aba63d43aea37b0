"""Byte-level BPE: every distinct word is encoded once, ids go back to the positions, decoding joins the token bytes."""

from __future__ import annotations

import base64
import hashlib
import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Characters of text in a block; a longer document is a block of its own.
BLOCK = 16_000_000
#: Bytes of text for each bucket of words, and blocks whose words meet in one group at most (about).
BUCKET_BYTES, GROUP_BLOCKS = 2_000_000, 4096


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def token_table(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


@lru_cache(maxsize=4)
def word_encoder(path: str) -> Callable[[str], list[int]]:
    """Encodes one word; the pattern takes any text as a single match, so only the merges are applied."""
    import tiktoken

    whole = tiktoken.Encoding("word", pat_str=r"(?s:.+)", mergeable_ranks=load_ranks(path), special_tokens={})
    return whole.encode_ordinary


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return regex.compile(pattern).findall


def pack(numbers: Sequence[int] | np.ndarray) -> bytes:
    """Compressed unsigned integers, laid out by byte so that the many zero bytes lie together."""
    planes = np.asarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def make_block(ids: list, texts: list[str], find, n_buckets: int) -> tuple[str, bytes]:
    """(name, payload): the documents as ordinals into the block's list of distinct words, and that list cut by bucket."""
    known: dict[str, int] = {}
    counts, ordinals, take = [], [], known.setdefault
    for text in texts:
        found = find(text)
        counts.append(len(found))
        ordinals.extend([take(w, len(known)) for w in found])
    parts: list[tuple[list[bytes], list[int]]] = [([], []) for _ in range(n_buckets)]
    for k, raw in enumerate(map(str.encode, known)):
        part = parts[zlib.crc32(raw) % n_buckets]
        part[0].append(raw)
        part[1].append(k)
    packed = {b: (pack(list(map(len, ws))), zlib.compress(b"".join(ws), 1), pack(np.diff(ks, prepend=0))) for b, (ws, ks) in enumerate(parts) if ws}
    payload = pickle.dumps((ids, pack(counts), pack(ordinals), packed))
    return hashlib.md5(payload).hexdigest(), payload


def blocks(docs: DataFrame, pattern: str, n_buckets: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ids, texts, size, number = splitter(pattern), [], [], 0, 0

        def row() -> pa.RecordBatch:
            name, payload = make_block(ids, texts, find, n_buckets)
            return pa.RecordBatch.from_arrays([pa.array([f"{TaskContext.get().partitionId()}-{number}-{name}"]), pa.array([payload])], ["block", "payload"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(text) > BLOCK:
                    yield row()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(key)
                texts.append(text)
                size += len(text)
        if texts:
            yield row()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, "block string, payload binary")


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of distinct words that the blocks send away, one row for each bucket."""
    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = pickle.loads(payload)[3]
            columns = [pa.array([block] * len(parts), pa.string()), pa.array(list(parts), pa.int32()), pa.array([p[0] for p in parts.values()], pa.binary()), pa.array([p[1] for p in parts.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "lengths", "text"])


def encode_words(path: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For one bucket of words of many blocks: encode what is distinct, answer each block with the ids of its words."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        encode, seen, out = word_encoder(path), {}, []
        for block, bucket, lengths, text in zip(rows["block"], rows["bucket"], rows["lengths"], rows["text"]):
            blob, at, sizes, flat = zlib.decompress(text), 0, [], []
            for n in unpack(lengths).tolist():
                word = blob[at : at + n]
                at += n
                if (tokens := seen.get(word)) is None:
                    tokens = seen[word] = encode(word.decode())
                sizes.append(len(tokens))
                flat.extend(tokens)
            out.append((block, bucket, pack(sizes), pack(flat)))
        return pd.DataFrame(out, columns=["block", "bucket", "lengths", "tokens"])

    return run


def reassemble(path: str, with_ids: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For one block: put the ids of the words at the words' places and decode them by the token table."""

    def run(block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for payload in block["payload"][:1]:
            keys, counts, data, parts = pickle.loads(payload)
            table = token_table(path)
            words: dict[int, list[int]] = {}
            for bucket, lengths, tokens in zip(replies["bucket"], replies["lengths"], replies["tokens"]):
                flat, start = unpack(tokens).tolist(), 0
                for k, n in zip(np.cumsum(unpack(parts[bucket][2])).tolist(), unpack(lengths).tolist()):
                    words[k] = flat[start : start + n]
                    start += n
            ordinals, start = unpack(data), 0
            ids = [words[k] for k in range(len(words))]
            numbers = [" ".join(map(str, x)) for x in ids]
            raw = [b"".join([table[i] for i in x]) for x in ids]
            sizes = np.array([len(x) for x in ids] or [0])
            for key, n in zip(keys, unpack(counts).tolist()):
                own = ordinals[start : start + n]
                start += n
                n_tokens = int(sizes[own].sum()) if n else 0
                own = own.tolist()
                row = (key, n_tokens, hashlib.sha256(" ".join([numbers[k] for k in own]).encode()).hexdigest(), hashlib.sha256(b"".join([raw[k] for k in own])).hexdigest())
                out.append((*row, [i for k in own for i in ids[k]]) if with_ids else row)
        frame = pd.DataFrame([x[1:] for x in out], columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        frame.insert(0, "doc_id", pd.Series([x[0] for x in out], dtype=object))  # large ids beside nulls stay exact
        return frame

    return run


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode whole texts by the ranks file at ``path`` and decode the ids again.

    Documents are cut into words by ``pattern`` in blocks; a block keeps its documents as ordinals into its own list of distinct
    words, and only those lists are shuffled by word. So a word is encoded once for each group of blocks, not once
    for each place, and what moves is small. Ids then join the block and fill the places. Returns doc_id, n_tokens,
    ids_sha256, decoded_sha256 and, if asked for, the ids.

    Blocks are named by their place and content: equal blocks stay apart, both readers below share one exchange, and should a lost part
    come back cut in another way, the names do not meet and the job fails rather than mixing two cuts.

    Null and empty texts have no tokens. Null and repeated ids are rows like any other. An empty table gives no rows. Other
    columns are ignored.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = blocks(docs, pattern, 1 + int(total // BUCKET_BYTES)).repartition("block")
    group_of_blocks = F.pmod(F.xxhash64("block"), F.lit(1 + int(total // (BLOCK * GROUP_BLOCKS))))
    asked = kept.mapInArrow(word_lists, "block string, bucket int, lengths binary, text binary").withColumn("group", group_of_blocks)
    replies = asked.groupBy("bucket", "group").applyInPandas(encode_words(path), "block string, bucket int, lengths binary, tokens binary")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return kept.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(reassemble(path, with_ids), schema)
