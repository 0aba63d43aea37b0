"""Phrases that hang together: candidates from shards mined at a lowered support, counted exactly in all shards."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.llm.bpe import pack, unpack
from wellspan.llm.common import keep_table
from wellspan.llm.decontaminate import _packed, _unpacked
from wellspan.llm.repeats import pack64, unpack64
from wellspan.llm.shingles import WORDS, finalised, word_hashes

#: Characters that end a piece of text, and what they become; a blank that is no space becomes one.
PIECE_END = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(0x20 if c == 9 else 0x0A if c in PIECE_END else c for c in range(256))
#: Bits of the tables that name candidates and frequent phrases (2^24 bytes go to every executor), of a range they are put together
#: in, parts whose ranges meet at once, and of how many fragments one spells a phrase at first.
TABLE_BITS, RANGE_BITS, PARTS, SPELLED = 27, 19, 256, 16
#: Sums that a task gathers before it sends them, and words of all texts for each range of names.
GATHERED, RANGE_WORDS = 3_000_000, 2_000_000


@dataclass(frozen=True)
class Mining:
    """Least occurrences, words of a phrase, rows for each lang, percent of a phrase's places that a longer one must hold to
    replace it; characters of text in a fragment and words in a shard (about)."""

    support: int = 100
    longest: int = 5
    top: int = 2000
    covered: int = 100
    fragment: int = 8_000_000
    shard: int = 2_500_000


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, all words as numbers from 1 with 0 between pieces)."""
    known: dict[bytes, int] = {b".": 0}
    numbers: list[int] = []
    take = known.setdefault
    for raw in texts:
        numbers.extend([take(w, len(known)) for w in raw.lower().translate(TABLE).replace(b"\n", b" . ").split()])
        numbers.append(0)
    return list(known)[1:], np.array(numbers, np.int64)


def cut_text(raw: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut where a piece ends."""
    start = 0
    while len(raw) - start > size:
        end = re.compile(b"[" + PIECE_END + b"]").search(raw, start + size)
        if end is None:
            break
        yield raw[start : end.end()]
        start = end.end()
    yield raw[start:]


def fragments(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """(lang, n, fragment): runs of text of one lang as numbered words; n counts the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def row(lang: str) -> pa.RecordBatch:
            words, seq = numbered(waiting.pop(lang))
            del size[lang]
            payload = pickle.dumps((zstandard.compress(b"\n".join(words), 1), _packed(seq)))
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int((seq > 0).sum())], pa.int64()), pa.array([payload], pa.binary())], ["lang", "n", "fragment"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for raw in cut_text(text.encode(), how.fragment):
                    waiting.setdefault(lang, []).append(raw)
                    size[lang] = size.get(lang, 0) + len(raw)
                    if size[lang] > how.fragment:
                        yield row(lang)
                    elif sum(size.values()) > 2 * how.fragment:  # many langs at once
                        yield row(max(size, key=size.get))
        for lang in list(waiting):
            yield row(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, n long, fragment binary")


def opened(payload: bytes) -> tuple[list[bytes], np.ndarray]:
    words, seq = pickle.loads(payload)
    raw = zstandard.decompress(words)
    return raw.split(b"\n") if raw else [], _unpacked(seq)


def merged(payloads: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Fragments as one shard with one numbering."""
    known: dict[bytes, int] = {}
    parts = []
    for payload in payloads:
        words, seq = opened(payload)
        numbers = np.array([0, *[known.setdefault(w, len(known) + 1) for w in words]], np.int64)
        parts.append(numbers[seq])
    return list(known), np.concatenate([np.append(x, 0) for x in parts])


def hashes(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words by their number, of unlike making and mixed with the lang; together they name a phrase by 96 bits."""
    first = lang.encode().hex().encode() + b"."
    own, _ = word_hashes([b"\n".join([first, *words]).decode()])
    other = finalised(np.array([zlib.crc32(w) for w in (first, *words)], np.uint64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((x[:1], finalised(x[1:] * WORDS + x[0]))) for x in (own, other))


def joined_hash(of_word: np.ndarray, seq: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each place."""
    h = of_word[seq[at]]
    with np.errstate(over="ignore"):
        for k in range(1, width):
            h = finalised(h * WORDS + of_word[seq[at + k]])
    return h


def place_in_table(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def has(table: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return (table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0


def levels(seq: np.ndarray, longest: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, first places of the phrases found ``least`` times): a phrase grows from two that overlap and are frequent too."""
    own = seq
    for n in range(1, longest + 1):
        if n == 1:
            at = np.flatnonzero(own > 0)
            key = own[at]
        else:
            at = np.flatnonzero((own[:-1] > 0) & (own[1:] > 0))
            key = own[at] * (int(own.max(initial=0)) + 1) + own[at + 1]
        if not at.size:
            return
        _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        frequent = count >= least
        yield n, at[first[frequent]]
        number = np.cumsum(frequent) * frequent
        own = np.zeros(len(seq), np.int64)
        own[at] = number[which]


def mine(how: Mining):
    """The candidates of shards, each mined completely at its share of the support, as ranges of the table's bits.

    The fragments of one lang that a task reads make up its shards.
    """

    def candidates(lang: str, total: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        words, seq = merged([x for _, x in rows])
        least = max(1, -(-how.support * sum(n for n, _ in rows) // total)) if total else 1
        of_word, _ = hashes(lang, words)
        spots = [place_in_table(joined_hash(of_word, seq, at, width)) for width, at in levels(seq, how.longest, least)]
        every = np.unique(np.concatenate(spots)) if spots else np.zeros(0, np.int64)
        ranges, first = np.unique(every >> RANGE_BITS, return_index=True)
        bits = [packed_bits(x) for x in np.split(every, first[1:])] if len(first) else []
        return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.array(bits, pa.binary())], ["range", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, tuple[int, list[tuple[int, bytes]]]] = {}
        for batch in batches:
            for lang, n, total, fragment in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.setdefault(lang, (total, []))[1].append((n, fragment))
                size = {k: sum(n for n, _ in rows) for k, (_, rows) in waiting.items()}
                most = max(size, key=size.get)
                if size[most] >= how.shard or sum(size.values()) >= 2 * how.shard:
                    yield candidates(most, *waiting.pop(most))
        for lang in list(waiting):
            yield candidates(lang, *waiting.pop(lang))

    return run


def packed_bits(spots: np.ndarray) -> bytes:
    bits = np.zeros(1 << RANGE_BITS, bool)
    bits[spots & ((1 << RANGE_BITS) - 1)] = True
    return zstandard.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def bit_table(ranges: DataFrame) -> np.ndarray:
    """The bits of all rows in one table of fixed size, put together by range in two steps of bounded groups."""

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << (RANGE_BITS - 3), np.uint8)
        for b in rows["bits"]:
            bits |= np.frombuffer(zstandard.decompress(b), np.uint8)
        return pd.DataFrame({"range": rows["range"][:1], "bits": [zstandard.compress(bits.tobytes(), 1)]})

    parted = ranges.withColumn("part", F.floor(F.spark_partition_id() / PARTS))
    some = parted.groupBy("range", "part").applyInPandas(either, "range int, bits binary")
    rows = some.groupBy("range").applyInPandas(either, "range int, bits binary").collect()  # 2^(TABLE_BITS - RANGE_BITS) rows at most
    table = np.zeros((1 << (TABLE_BITS - RANGE_BITS), 1 << (RANGE_BITS - 3)), np.uint8)
    for r in rows:
        table[r["range"]] = np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
    return table.reshape(-1)


def ranges_of(rows: DataFrame) -> DataFrame:
    """The places of the hashes ``h`` as ranges of bits, some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.unique(place_in_table(batch.column(0).to_numpy().view(np.uint64)))
            ranges, first = np.unique(every >> RANGE_BITS, return_index=True)
            bits = [packed_bits(x) for x in np.split(every, first[1:])] if len(first) else []
            yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.array(bits, pa.binary())], ["range", "bits"])

    return rows.select("h").mapInArrow(run, "range int, bits binary")


def distinct_places(seq: np.ndarray, at: np.ndarray, width: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number) of each distinct phrase among those at ``at``, told apart by the words themselves."""
    key = seq[at]
    for k in range(1, width):
        key = np.unique(key, return_inverse=True)[1] * (n_words + 1) + seq[at + k]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return at[first], count


def whole_places(seq: np.ndarray, width: int) -> np.ndarray:
    """Places from which ``width`` words lie in one piece."""
    inside = seq[: max(len(seq) - width + 1, 0)] > 0
    for k in range(1, width):
        inside &= seq[k : k + len(inside)] > 0
    return np.flatnonzero(inside)


def bucket_of(h: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def added(h: np.ndarray, check: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names in order, with their occurrences summed."""
    by = np.lexsort((check, h))
    h, check, f = h[by], check[by], f[by]
    head = np.flatnonzero(np.append(True, (np.diff(h) != 0) | (np.diff(check) != 0))[: len(h)])
    return h[head], check[head], np.add.reduceat(f, head) if len(head) else f


def count_level(width: int, candidates, frequent, n_ranges: int):
    """Occurrences of the phrases of ``width`` words that are candidates and whose shorter parts are frequent.

    A task adds up its fragments and sends names and sums packed by range of the first hash.
    """

    def packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, check, f = added(*(np.concatenate(x) for x in zip(*parts)))
        ranges, first = np.unique(bucket_of(h, n_ranges), return_index=True)
        ends = [*first[1:].tolist(), len(h)]
        rows = [(pack64(h[a:e]), pack(check[a:e]), pack(np.minimum(f[a:e], 0xFFFFFFFF))) for a, e in zip(first.tolist(), ends)]
        return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], ["range", "names", "checks", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for lang, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, seq = opened(payload)
                of_word, other = hashes(lang, words)
                at = whole_places(seq, width)
                if width > 1:
                    for shift in (0, 1):
                        at = at[has(frequent.value, place_in_table(joined_hash(of_word, seq, at + shift, width - 1)))]
                at = at[has(candidates.value, place_in_table(joined_hash(of_word, seq, at, width)))]
                starts, count = distinct_places(seq, at, width, len(words))
                parts.append((joined_hash(of_word, seq, starts, width), joined_hash(other, seq, starts, width) >> np.uint64(32), count))
                size += len(count)
                if size > GATHERED:
                    yield packed(parts)
                    parts, size = [], 0
        if parts:
            yield packed(parts)

    return run


def frequent_names(support: int):
    """For one range of names: those that occur ``support`` times or more in all."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([unpack64(x) for x in rows["names"]])
        check, f = (np.concatenate([unpack(x) for x in rows[c]]).astype(np.int64) for c in ("checks", "sums"))
        h, check, f = added(h, check, f)
        keep = f >= support
        return pd.DataFrame({"h": h[keep].view(np.int64), "check": check[keep].astype(np.uint32).view(np.int32), "f": f[keep]})

    return run


def spelled(longest: int, wanted, one_in: int):
    """(h, check, lang, phrase) of wanted phrases; of the fragments that hold a phrase, about one in ``one_in`` spells it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, seq = opened(payload)
                of_word, other = hashes(lang, words)
                turn = np.uint64(zlib.crc32(payload))
                for width in range(1, longest + 1):
                    at = whole_places(seq, width)
                    h = joined_hash(of_word, seq, at, width)
                    at = at[has(wanted.value, place_in_table(h)) & (finalised(h ^ turn) % np.uint64(one_in) == 0)]
                    starts, _ = distinct_places(seq, at, width, len(words))
                    phrases = [b" ".join([words[x - 1] for x in row]) for row in seq[starts[:, None] + np.arange(width)].tolist()]
                    h, check = joined_hash(of_word, seq, starts, width).view(np.int64), (joined_hash(other, seq, starts, width) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(check), pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string())], ["h", "check", "lang", "phrase"])

    return run


def named(kept: DataFrame, found: DataFrame, how: Mining) -> DataFrame:
    """The phrases behind the hashes: most are spelled by a few of the fragments that hold them, the rest in a second round by all."""
    spark, names, missing = kept.sparkSession, None, found.select("h", "check")
    for one_in in (SPELLED, 1):
        wanted = spark.sparkContext.broadcast(bit_table(ranges_of(missing)))
        rows = kept.select("lang", "fragment").mapInArrow(spelled(how.longest, wanted, one_in), "h long, check int, lang string, phrase string")
        # whatever fragment spells it, a phrase is the same
        part = keep_table(rows.groupBy("h", "check").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase")).join(missing, ["h", "check"]))
        names = part if names is None else names.unionByName(part)
        wanted.destroy()
        missing = keep_table(missing.join(part.select("h", "check"), ["h", "check"], "left_anti"))
        if missing.isEmpty():
            break
    return names


def counted(kept: DataFrame, totals: DataFrame, how: Mining) -> DataFrame:
    """(lang, phrase, f, words) of every phrase of 1 to ``longest`` words that occurs ``support`` times or more in its lang."""
    spark = kept.sparkSession
    mined = kept.join(totals, "lang").select("lang", "n", "total", "fragment").mapInArrow(mine(how), "range int, bits binary")
    n_ranges = 1 + (totals.agg(F.sum("total")).first()[0] or 0) // RANGE_WORDS
    candidates, frequent, found = spark.sparkContext.broadcast(bit_table(mined)), None, None
    for width in range(1, how.longest + 1):
        rows = kept.select("lang", "fragment").mapInArrow(count_level(width, candidates, frequent, n_ranges), "range int, names binary, checks binary, sums binary")
        level = keep_table(rows.groupBy("range").applyInPandas(frequent_names(how.support), "h long, check int, f long"))
        if frequent is not None:
            frequent.destroy()
        part = level.withColumn("words", F.lit(width))
        found = part if found is None else found.unionByName(part)
        if width < how.longest:
            frequent = spark.sparkContext.broadcast(bit_table(ranges_of(level)))
    candidates.destroy()
    return found.join(named(kept, found, how), ["h", "check"]).select("lang", "phrase", "f", "words")


def part_of(words: Column, first, length) -> Column:
    return F.concat_ws(" ", F.slice(words, first, length))


def score() -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""
    return F.expr("(1000bd * cast(a as decimal(38,0)) * n) div (cast(l as decimal(38,0)) * r)")


def best_rows(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each lang with their rank: of each part, then of every 32 parts together, until one is left."""
    parted = keep_table(rows).withColumn("_part", F.spark_partition_id())
    parts = 1 + (parted.agg(F.max("_part")).first()[0] or 0)
    while True:
        ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
        if parts == 1:
            return ranked.drop("_part")
        parted, parts = ranked.withColumn("_part", F.floor(F.col("_part") / 32).cast("int")), -(-parts // 32)


def collocations(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """The best phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    1. Fragments of text of one lang are numbered once and written. 2. Fragments that a task reads make up its shards; each is mined
    completely at its share of the support, so that a phrase frequent in the whole lang is frequent in one shard at
    least. The union of these candidates sets bits of a table of fixed size. 3. Phrases of one word, two words and so on
    are counted in all fragments where the table has them and their shorter parts turned out frequent, and summed by a name of 96 bits. A
    bit that two phrases share costs work and no result, for only the sums decide. 4. Frequent names are spelled out by
    fragments that hold them. 5. Scores from joins with the counts, in decimals of 38 digits.

    A null lang is ``und``; null and empty texts have no words. Rows that repeat are documents like any other. A lang
    without a frequent phrase, and an empty table, give no rows. Other columns are ignored. Ties follow score, a, phrase. A piece
    of text without any end is handled whole.
    """
    kept = keep_table(fragments(docs, how))
    totals = keep_table(kept.groupBy("lang").agg(F.sum("n").alias("total")))
    counts = keep_table(counted(kept, totals, how))
    long = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part_of(F.col("w"), F.lit(1), F.col("k")).alias("front"), part_of(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("back"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(side("front", "l"), ["lang", "front"]).join(side("back", "r"), ["lang", "back"]).join(totals.withColumnRenamed("total", "n"), "lang")
    exact = scored.withColumn("score", score())
    worst = exact.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: part_of(F.col("w"), i, m))))
    covers = long.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    own = worst.join(covers, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < how.covered * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return best_rows(own, order, how.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows by counting every run of one to five words.
COLLOCATIONS_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents
), worded as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces
), grams as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) phrase
  from worded, (select unnest(range(1, 6)) m) x where len(w) >= m
), counts as materialized (
  select lang, phrase, m, count(*) f from grams group by all having count(*) >= 100
), totals as (
  select lang, sum(len(w)) n from worded group by lang
), long as (
  select *, string_split(phrase, ' ') w from counts where m > 1
), cuts as (
  select lang, phrase, f a, k, array_to_string(w[1:k], ' ') front, array_to_string(w[k + 1:], ' ') back from (select *, unnest(range(1, m)) k from long)
), scored as (
  select c.lang, c.phrase, a, k, x.f l, y.f r, n, (1000::hugeint * a * n) // (x.f::hugeint * y.f) score
  from cuts c join counts x on x.lang = c.lang and x.phrase = front join counts y on y.lang = c.lang and y.phrase = back join totals t on t.lang = c.lang
), worst as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), covers as (
  select lang, array_to_string(w[i:i + s - 1], ' ') phrase, max(f) longer
  from (select *, unnest(range(1, m - s + 2)) i from (select *, unnest(range(2, m)) s from long where m > 2)) group by all
), own as (
  select w.* from worst w left join covers c using (lang, phrase) where longer is null or 100 * longer < 100 * a
)
select lang, rank, phrase, cast(a as bigint) a, cast(l as bigint) l, cast(r as bigint) r, cast(n as bigint) n, cast(score as bigint) score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from own) where rank <= 2000
"""
