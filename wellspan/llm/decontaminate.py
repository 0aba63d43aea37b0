"""Benchmark decontamination: suffix arrays of training shards, searched with every suffix of the test items."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wellspan.llm.common import keep_table


@dataclass(frozen=True)
class Search:
    """Words of a window, characters of text in a shard (a longer document is one of its own), bytes of test text that
    one broadcast holds (about), and pairs of places looked at together."""

    window: int = 10
    shard: int = 8_000_000
    slice_bytes: int = 4_000_000
    pairs: int = 2_000_000


def _blank_table() -> bytes:
    word = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    return bytes(c if c in word else 0x20 for c in range(256))


#: Everything that is no letter, digit or byte of a longer character becomes a blank.
TABLE = _blank_table()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(TABLE).split()


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, compared on ``depth`` words at least.

    Several words make up the first key; then ranks double their reach, and only places that still tie are sorted again.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(seq.max()).bit_length())
    reach = max(1, 63 // bits)
    padded = np.concatenate((seq.astype(np.int64), np.zeros(reach, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=-1) != 0
    rank = np.empty(n, np.int64)  # the first place of its group in the order
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while reach < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if len(tied) == 0:
            break
        places = order[tied]
        ahead = np.where(places + reach < n, rank[np.minimum(places + reach, n - 1)] + 1, 0)
        key = rank[places] * (n + 1) + ahead
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[tied] = places
        head = np.diff(key, prepend=-1) != 0
        new[tied] = head
        rank[places] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        reach *= 2
    return order


def narrowed(seq: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each interval, whose suffixes agree on ``depth`` words, the part that has ``word`` next: two binary searches."""
    ends = []
    for after in (False, True):
        a, b = low.copy(), high.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) >> 1
            found = seq[order[middle] + depth]
            less = found <= word[open_] if after else found < word[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        ends.append(a)
    return ends[0], ends[1]


def suffix_matches(seq: np.ndarray, order: np.ndarray, items: list[np.ndarray], how: Search) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, length, item, place in the item) of the verbatim matches of a window or more, none of which can be longer.

    ``seq`` are the shard's words as numbers from 1, with 0 between documents; ``items`` use the same numbers, -1 for words the shard
    lacks. Every suffix of an item that holds a window is searched word by word in the suffix array; the interval left at the
    window's end holds all its places. A place whose word before agrees with the item's belongs to a longer match and is
    passed by; the others are followed to their last common word.
    """
    lengths = np.array([len(x) for x in items], np.int64)
    if not len(items) or not len(seq):
        return
    ends = np.cumsum(lengths + 1)
    flat = np.concatenate([np.append(x, -2) for x in items])  # -2 equals no word
    need = np.minimum(lengths, how.window)
    counts = np.where(lengths > 0, lengths - need + 1, 0)
    item = np.repeat(np.arange(len(items)), counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - lengths - 1, counts)
    wide = need[item]
    reach = int(wide.max(initial=0))
    padded = np.concatenate((seq, np.zeros(max(reach, 1), seq.dtype)))
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    for depth in range(reach):
        live = np.flatnonzero((wide > depth) & (low < high))
        if not live.size:
            break
        low[live], high[live] = narrowed(padded, order, low[live], high[live], depth, flat[at[live] + depth])
    met = np.flatnonzero(low < high)
    size = (high - low)[met]
    part = np.cumsum(size) // how.pairs
    for some in np.split(met, np.flatnonzero(np.diff(part)) + 1) if met.size else ():
        n = (high - low)[some]
        suffix = np.repeat(some, n)
        place = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)]
        first = at[suffix] == (ends - lengths - 1)[item[suffix]]
        before = np.where(place > 0, seq[np.maximum(place - 1, 0)], 0)
        left = first | (before != flat[np.maximum(at[suffix] - 1, 0)])
        suffix, place = suffix[left], place[left]
        length = wide[suffix].copy()
        live = np.arange(len(suffix))
        while live.size:
            spot = place[live] + length[live]
            same = (spot < len(seq)) & (seq[np.minimum(spot, len(seq) - 1)] == flat[at[suffix[live]] + length[live]])
            live = live[same]
            length[live] += 1
        yield place, length, item[suffix], at[suffix] - (ends - lengths - 1)[item[suffix]]


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def shards(docs: DataFrame, depth: int, how: Search = Search()) -> DataFrame:
    """One row for each shard: its documents as numbers of the shard's words, and their suffix array, ordered on ``depth`` words."""

    def packed_shard(keys: list, texts: list[str | None]) -> bytes:
        known: dict[bytes, int] = {}
        numbers, counts, take = [], [], known.setdefault
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            numbers.extend([take(w, len(known) + 1) for w in words])
            numbers.append(0)
        seq = np.array(numbers, np.int64)
        digests = [None if t is None else hashlib.md5(t.encode()).hexdigest() for t in texts]
        return pickle.dumps((keys, digests, counts, zstandard.compress(b"\n".join(known), 1), _packed(seq), _packed(suffix_array(seq, depth))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([packed_shard(keys, texts)], pa.binary())], ["shard", "payload"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(text or "") > how.shard:
                    yield row()
                    number, keys, texts, size = number + 1, [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text or "")
        if texts:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, "shard long, payload binary")


def searched(index: DataFrame, items, with_clean: bool, id_type: str, how: Search) -> DataFrame:
    """For each document of the shards: the stretches that ``items``, a broadcast list of (name, words), hit, and each item's longest match.

    Documents without a hit are given ``with_clean`` only.
    """
    schema = f"shard long, at int, doc_id {id_type}, digest string, n_words long, stretches array<struct<first:int,after:int>>, met array<struct<item:string,longest:int,doc_word:int,item_word:int>>"

    def search(shard: int, payload: bytes):
        keys, digests, counts, names, seq, order = pickle.loads(payload)
        seq = _unpacked(seq)
        known = {w: k for k, w in enumerate(zstandard.decompress(names).split(b"\n"), 1)} if len(names) else {}
        listed = [np.array([known.get(w, -1) for w in words], np.int64) for _, words in items.value]
        starts = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
        step = np.zeros(len(seq) + 1, np.int64)
        found = []
        for place, length, item, spot in suffix_matches(seq, _unpacked(order), listed, how):
            step += np.bincount(place, minlength=len(step)) - np.bincount(place + length, minlength=len(step))
            doc = np.searchsorted(starts, place, side="right") - 1
            by = np.lexsort((place, -length, item, doc))
            doc, item, length, place, spot = doc[by], item[by], length[by], place[by], spot[by]
            best = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(item) != 0)))[: len(doc)]
            found.append(np.stack([doc, item, -length, place - starts[doc], spot], 1)[best])
        stretches: dict[int, list] = {}
        met: dict[int, list] = {}
        if found:
            covered = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
            first, after = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
            doc = np.searchsorted(starts, first, side="right") - 1
            for d, a, b in zip(doc.tolist(), (first - starts[doc]).tolist(), (after - starts[doc]).tolist()):
                stretches.setdefault(d, []).append({"first": a, "after": b})
            seen = set()
            for d, i, length, place, spot in sorted(np.concatenate(found).tolist()):
                if (d, i) not in seen:
                    seen.add((d, i))
                    met.setdefault(d, []).append({"item": items.value[i][0], "longest": -length, "doc_word": place, "item_word": spot})
        rows = range(len(keys)) if with_clean else sorted(met)
        return (
            [shard] * len(rows), list(rows), [keys[k] for k in rows], [digests[k] for k in rows], [counts[k] for k in rows],
            [stretches.get(k, []) for k in rows], [met.get(k, []) for k in rows],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns = search(shard, payload)
                types = [pa.int64(), pa.int32(), None, pa.string(), pa.int64(), STRETCHES, MET]
                arrays = [pa.array(c, KEY_TYPES.get(id_type)) if t is None else pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "at", "doc_id", "digest", "n_words", "stretches", "met"])

    return index.mapInArrow(run, schema)


STRETCHES = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
MET = pa.list_(pa.struct([("item", pa.string()), ("longest", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())]))
KEY_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def matches(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> tuple[DataFrame, DataFrame]:
    """(documents with the words that are hit, longest match of each document with each item).

    The suffix arrays of the shards are built once and written. Equal test texts are one item; they are dealt by hash to slices of
    bounded size, and each slice is broadcast by itself and searched in all shards, so a benchmark of any size is searched whole.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    named = keep_table(benchmark.select("item_id", F.md5("text").alias("item"), "text").filter("text is not null"))
    texts = keep_table(named.groupBy("item").agg(F.first("text").alias("text")))
    split = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    size, longest = texts.agg(F.sum(F.octet_length("text")), F.max(F.size(split))).first()
    index = keep_table(shards(docs, longest or 0, how))
    n_slices = 1 + (size or 0) // how.slice_bytes
    hits = None
    for k in range(n_slices):  # one job for each slice of test text
        rows = texts.filter(F.pmod(F.xxhash64("item"), F.lit(n_slices)) == k).collect()
        items = spark.sparkContext.broadcast([(r["item"], words) for r in rows if (words := words_of(r["text"]))])
        part = keep_table(searched(index, items, k == 0, id_type, how))
        items.destroy()
        hits = part if hits is None else hits.unionByName(part)
    found = hits.select("shard", "at", "doc_id", F.explode("met").alias("met")).select("shard", "at", "doc_id", "met.*").join(named.select("item", "item_id"), "item")
    return hits, found


def report(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """For every document how many of its words lie in a window that an item also holds, and which items those are.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lowered. A window is ten words of an item in a row, or the
    whole of a shorter one. Returns doc_id, digest (of the text), n_words, n_hit, n_items, items_sha256 (of the sorted item_ids,
    joined by commas), contaminated, and the longest verbatim match in words with its first place.

    Null and empty texts have no words and are clean; items without words hit nothing. Items with one text are all named;
    an item_id that repeats counts once, one that is null is not named, though its words are hit. Rows that repeat a doc_id
    are documents of their own. An empty benchmark leaves all clean, an empty table gives no rows. Other columns are ignored. A text and its
    numbers fit in one task.
    """
    hits, found = matches(docs, benchmark, how)
    stretches = F.array_sort(F.flatten(F.collect_list("stretches")))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("after"))
    step = lambda now, x: F.struct((now["n"] + F.greatest(F.lit(0), x["after"] - F.greatest(x["first"], now["after"]))).alias("n"), F.greatest(now["after"], x["after"]).alias("after"))
    rows = hits.groupBy("shard", "at").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"), F.aggregate(stretches, start, step, lambda x: x["n"]).cast("long").alias("n_hit"))
    best = F.max(F.struct("longest", (-F.col("doc_word")).alias("place")))
    of_doc = found.groupBy("shard", "at").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"), best.alias("best"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(of_doc, ["shard", "at"], "left").select(
        "doc_id", "digest", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.coalesce("best.longest", F.lit(0)).cast("long").alias("longest_match"), (-F.col("best.place")).cast("long").alias("longest_at"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """The documents, with all their columns, none of whose words are hit."""
    hit = report(docs, benchmark, how).filter("contaminated").select(F.col("doc_id").alias("_hit_id"), F.col("digest").alias("_hit_text")).distinct()
    same = F.md5(docs["text"]) == F.col("_hit_text")
    return docs.join(hit, same & docs["doc_id"].eqNullSafe(F.col("_hit_id")), "left_anti")


#: The same rows by a join of all windows.
REPORT_SQL = r"""
with item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null
), windows as materialized (
  select distinct item_id, least(len(w), 10) wide, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') gram
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from item_words where len(w) > 0)
), texts as materialized (
  select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), places as (
  select rid, i, wide, array_to_string(w[i:i + wide - 1], ' ') gram
  from (select rid, w, unnest(range(1, len(w) - wide + 2)) i, wide from texts, (select distinct wide from windows) x where len(w) >= wide)
), hits as materialized (
  select rid, i, wide, item_id from places join windows using (wide, gram)
), words_hit as (
  select rid, count(distinct i + k) n_hit from (select distinct rid, i, wide, unnest(range(0, wide)) k from hits) group by rid
), items as (
  select rid, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct rid, cast(item_id as varchar) id from hits where item_id is not null) group by rid
), runs as (  -- windows in a row on one diagonal are one match
  select rid, count(*) + any_value(wide) - 1 longest, min(i) place from (
    select rid, i, wide, item_id, spot, i - row_number() over (partition by rid, item_id, i - spot order by i) run
    from (select h.rid, h.i, h.wide, h.item_id, s.spot from hits h join places p on h.rid = p.rid and h.i = p.i and h.wide = p.wide
          join (select item_id, wide, spot, array_to_string(w[spot:spot + wide - 1], ' ') gram
                from (select item_id, w, least(len(w), 10) wide, unnest(range(1, len(w) - least(len(w), 10) + 2)) spot from item_words where len(w) > 0)) s
          on s.item_id = h.item_id and s.wide = h.wide and s.gram = p.gram))
  group by rid, item_id, i - spot, run
), longest as (
  select rid, max(longest) longest, arg_min(place, (-longest, place)) place from runs group by rid
)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, cast(coalesce(longest, 0) as bigint) longest_match, cast(place - 1 as bigint) longest_at
from texts left join words_hit using (rid) left join items using (rid) left join longest using (rid)
"""
