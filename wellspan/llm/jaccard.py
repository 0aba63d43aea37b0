"""Jaccard join of word n-gram sets with a prefix tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from wellspan.llm.bpe import pack, unpack
from wellspan.llm.common import keep_table
from wellspan.llm.components import components
from wellspan.llm.shingles import in_batches

#: Bits of the table of counts that orders n-grams (one byte for each entry goes to every executor), ranges it is summed in, parts summed at once.
SKETCH_BITS, RANGES, PARTS = 22, 64, 256
#: Steps of rarity for each doubling of a count: chance adds nearly the same to every bucket, and what is more must still be told from it.
STEPS = 8
#: N-grams of the sets that a block holds (about); two blocks are compared at once. Blocks whose marks are compared at once, on each side.
BLOCK, WIDE = 60_000, 64
#: Rare n-grams that a block of documents and a range of names hold (about) when they are looked up.
PACKED = 1 << 20
#: Documents that share an n-gram are listed in pairs up to this number, beyond it compared by blocks; partners of one document compared at once.
LISTED, PARTNERS = 64, 64
#: The similarity is SHARE / WHOLE at least.
SHARE, WHOLE = 4, 5


def prefix_length(n: int) -> int:
    """So many of the rarest n-grams that two similar sets must share one of them."""
    return n - -(-SHARE * n // WHOLE) + 1 if n else 0


def marks_of(grams: np.ndarray) -> np.ndarray:
    """One bit for each hash bucket: whether it holds an odd number of the n-grams. There are as many buckets as n-grams, up to the
    next power of 2, 64 at least. Two sets' marks differ in no more bits than the sets do in n-grams."""
    size = 1 << max(6, (len(grams) - 1).bit_length())
    odd = np.bincount((grams >> np.uint64(SKETCH_BITS)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def unlike(a: Column, b: Column) -> Column:
    """In how many bits two marks differ, after the longer one is folded to the length of the other; null if it is over twice as long."""
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    halved = lambda x: xor(F.slice(x, 1, F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.floor(F.size(x) / 2).cast("int")))
    bits = lambda x, y: F.aggregate(xor(x, y), F.lit(0), lambda total, word: total + F.bit_count(word))
    same, longer, shorter = F.size(a) == F.size(b), F.size(a) == 2 * F.size(b), F.size(b) == 2 * F.size(a)
    return F.when(same, bits(a, b)).when(longer, bits(halved(a), b)).when(shorter, bits(a, halved(b)))


def facts_and_counts(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, digest and marks of the set) and, with ``range`` set, of n-gram counts by hash bucket."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind, mask = np.zeros(1 << SKETCH_BITS, np.int64), pa.int64(), np.uint64((1 << SKETCH_BITS) - 1)
        names, marked = ["doc_id", "n", "digest", "marks", "range", "counts"], pa.list_(pa.int64())
        for batch in batches:
            kind, n, digests, marks = batch.schema.field(0).type, [], [], []
            for _, sets in in_batches(batch, 1):
                n += [len(s) for s in sets]
                digests += [hashlib.md5(s.tobytes()).digest() for s in sets]
                marks += [marks_of(s) for s in sets]
                np.add.at(counts, (np.concatenate(sets) & mask).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, marked), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if counts.any():
            parts = [pack(np.minimum(x, 0xFFFFFFFF)) for x in counts.reshape(RANGES, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(RANGES, kind), pa.nulls(RANGES, pa.int64()), pa.nulls(RANGES, pa.binary()), pa.nulls(RANGES, marked), pa.array(range(RANGES), pa.int32()), pa.array(parts)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n long, digest binary, marks array<long>, range int, counts binary")


def rarity(counts: DataFrame, part: str) -> np.ndarray:
    """The logarithm of the count in each bucket, ``STEPS`` for each doubling: a table of fixed size, summed by range in two steps of
    bounded groups."""

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpack(c).astype(np.int64) for c in rows["counts"])
        return pd.DataFrame({"range": rows["range"][:1], "counts": [pack(np.minimum(total, 0xFFFFFFFF))]})

    some = counts.groupBy("range", F.floor(F.col(part) / PARTS).alias("step")).applyInPandas(added, "range int, counts binary")
    rows = some.groupBy("range").applyInPandas(added, "range int, counts binary").collect()  # RANGES rows, 2^SKETCH_BITS numbers
    table = np.zeros((RANGES, (1 << SKETCH_BITS) // RANGES), np.int64)
    for r in rows:
        table[r["range"]] = unpack(r["counts"])
    return np.minimum(np.ceil(STEPS * np.log2(table.reshape(-1) + 1)), 255).astype(np.uint8)


def ordered(grams: np.ndarray, level: np.ndarray) -> np.ndarray:
    """N-grams from rare to frequent; all sets use this order."""
    return grams[np.lexsort((grams, level[(grams & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]))]


def cut_planes(numbers: np.ndarray) -> bytes:
    """Numbers by byte, so that the many zero bytes of small ones lie together; the shuffle's own codec does the rest."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def whole_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def packed_prefixes(docs: DataFrame, level, bits: int) -> DataFrame:
    """The rarest n-grams of each set, packed by block of documents and range of names: bucket, names, at, ids.

    A name is an n-gram's first 48 bits; sets that share a name only are candidates and no more. ``names`` are differences
    of sorted names, ``at`` places in ``ids``. Of equal sets in a block only the least id goes on. Bucket ``k`` of 2^``bits`` holds
    each name of the block once, with the lowest bit of ``at`` set if more of the block's sets share it. Those others, whatever
    their number, travel as a row of the block with a bucket below zero, so a bucket holds a name once a block at most.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = ["bucket", "names", "at", "ids"]

    def row(bucket: int, names: np.ndarray, owners: np.ndarray, marks: np.ndarray, ids: pa.Array):
        distinct, at = np.unique(owners, return_inverse=True)
        return bucket, cut_planes(np.diff(names, prepend=np.uint64(0))), cut_planes(2 * at + marks), ids.take(pa.array(distinct))

    def block(kept: list[tuple[np.ndarray, int]], ids: pa.Array, number: int) -> pa.RecordBatch:
        names = np.concatenate([g for g, _ in kept]) >> np.uint64(16)
        owners = np.repeat(np.array([k for _, k in kept]), [len(g) for g, _ in kept])
        order = np.lexsort((owners, names))
        names, owners = names[order], owners[order]
        first = np.diff(names, prepend=~names[:1]) != 0
        often = np.append(~first[1:], False) & first
        rows = []
        n, o, m = names[first], owners[first], often[first]
        edges = np.searchsorted(n, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(48 - bits))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[k], edges[k + 1])
            rows.append(row(k, n[part], o[part], m[part], ids))
        if not first.all():
            rows.append(row(-1 - number, names[~first], owners[~first], np.ones((~first).sum(), int), ids))
        kind = pa.list_(ids.type)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2)], pa.array([r[3].to_pylist() for r in rows], kind)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        kept, ids, size, number = {}, [], 0, int(TaskContext.get().partitionId()) << 24
        for batch in batches:
            named = batch.column(0)
            for first, sets in in_batches(batch, 1):
                for k, s in enumerate(sets):
                    if not len(s):
                        continue
                    digest, own = hashlib.md5(s.tobytes()).digest(), named[first + k].as_py()
                    at = least.get(digest)
                    if at is None:
                        least[digest] = len(ids)
                        kept[len(ids)] = ordered(s, level.value)[: prefix_length(len(s))]
                        size += len(kept[len(ids)])
                        ids.append(own)
                    elif own < ids[at]:
                        ids[at] = own
                if size > PACKED:
                    yield block([(g, k) for k, g in kept.items()], pa.array(ids, named.type), number)
                    least, kept, ids, size, number = {}, {}, [], 0, number + 1
            kind = named.type
        if kept:
            yield block([(g, k) for k, g in kept.items()], pa.array(ids, kind), number)

    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    return rows.mapInArrow(run, f"bucket long, names binary, at binary, ids array<{id_type}>")


def met_prefixes(docs: DataFrame, level, total: int) -> DataFrame:
    """(gram, id): names of rare n-grams that more than one set shares, with the sets. ``total`` n-grams are dealt to ranges of
    about ``PACKED`` each; a range comes to its task packed."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    packed = packed_prefixes(docs, level, max(0, (total // PACKED).bit_length()))

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, owners, marks, ids = [], [], [], []
        before = 0
        for gaps, at, own in zip(*(table.column(c).to_pylist() for c in ("names", "at", "ids"))):
            places = whole_numbers(at)
            names.append(np.cumsum(whole_numbers(gaps), dtype=np.uint64))
            owners.append((places >> np.uint64(1)).astype(np.int64) + before)
            marks.append((places & np.uint64(1)).astype(bool))
            ids += own
            before += len(own)
        names, owners, marks = (np.concatenate(x) for x in (names, owners, marks))
        order = np.argsort(names, kind="stable")
        names, owners, marks = names[order], owners[order], marks[order]
        same = names[1:] == names[:-1]
        met = marks | np.append(same, False) | np.append(False, same)
        kept = pa.array(ids, table.column("ids").type.value_type).take(pa.array(owners[met]))
        return pa.table({"gram": pa.array(names[met].astype(np.int64)), "id": kept})

    return packed.groupBy("bucket").applyInArrow(meet, f"gram long, id {id_type}")


def set_rows(docs: DataFrame, level) -> DataFrame:
    """The documents' sets in order, the most frequent n-gram first: a tree of them shares long beginnings. With their number, digest and marks."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(ordered(s, level.value)[::-1].tobytes(), hashlib.md5(s.tobytes()).digest(), marks_of(s).tobytes(), len(s)) for _, sets in in_batches(batch, 1) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], kind) for c, kind in enumerate([pa.binary()] * 3 + [pa.int64()])]], ["id", "grams", "digest", "marks", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, f"id {id_type}, grams binary, digest binary, marks binary, n long")


def tree_links(sets: list[np.ndarray], probes: list[np.ndarray], known: np.ndarray | None = None, probes_known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(k, similar probes) for each set k, by a walk through the prefix tree of the sets.

    Sets in lexicographic order are the leaves of the tree from left to right. The stack holds, for each node on the way to the
    current leaf, the overlaps of its n-grams with all probes, so sets that begin alike share that work. A branch
    is left as soon as no probe can reach the overlap it needs with the n-grams that remain. Probes of the set's own component,
    where components are given, need not be found.
    """
    postings: dict[int, list[int]] = {}
    for j, probe in enumerate(probes):
        for gram in probe.tolist():
            postings.setdefault(gram, []).append(j)
    places = {gram: np.array(js) for gram, js in postings.items()}
    sizes = np.array([len(p) for p in probes])
    lists = [s.tolist() for s in sets]
    stack, path = [np.zeros(len(probes), np.int32)], []
    for k in sorted(range(len(lists)), key=lists.__getitem__):
        own = lists[k]
        if not own:
            continue
        shared = 0
        while shared < min(len(path), len(own)) and path[shared] == own[shared]:
            shared += 1
        del stack[shared + 1 :], path[shared:]
        needed = -(-SHARE * (len(own) + sizes) // (SHARE + WHOLE))
        needed[sizes == 0] = len(own) + 1
        if known is not None:
            needed[probes_known == known[k]] = len(own) + 1
        while len(path) < len(own):
            depth = len(path)
            if depth % 8 == 0 and not (stack[-1] + (len(own) - depth) >= needed).any():
                break
            gram = own[depth]
            overlap = stack[-1]
            if (at := places.get(gram)) is not None:
                overlap = overlap.copy()
                overlap[at] += 1
            stack.append(overlap)
            path.append(gram)
        else:
            yield k, np.flatnonzero(stack[-1] >= needed)


class Forest:
    """Least names of what hangs together in one group."""

    def __init__(self, ids):
        self.least = {i: i for i in ids}

    def root(self, i):
        while self.least[i] != i:
            self.least[i] = self.least[self.least[i]]
            i = self.least[i]
        return i

    def link(self, i, j) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.least[max(a, b)] = min(a, b)

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame([(i, self.root(i)) for i in self.least if self.root(i) != i], columns=["a", "b"])


def alike(n: np.ndarray, marks: list[np.ndarray], others_n: np.ndarray, others_marks: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(k, others) for each set k: the others that can be similar to it by sizes and marks (see ``worth_reading``)."""
    widths, others_widths = (np.array([len(m) for m in x], int) for x in (marks, others_marks))
    for width in np.unique(others_widths).tolist():
        at = np.flatnonzero(others_widths == width)
        at = at[np.argsort(others_n[at], kind="stable")]
        sizes, table = others_n[at], np.stack([others_marks[j] for j in at.tolist()])
        halved = table[:, : width // 2] ^ table[:, width // 2 :] if width > 1 else None
        for k in np.flatnonzero((widths == width) | (widths == 2 * width) | (2 * widths == width)).tolist():
            part = slice(np.searchsorted(sizes, -(-SHARE * n[k] // WHOLE)), np.searchsorted(sizes, WHOLE * n[k] // SHARE, side="right"))
            own = marks[k] if len(marks[k]) <= width else marks[k][:width] ^ marks[k][width:]
            unlike_bits = np.bitwise_count((table if len(own) == width else halved)[part] ^ own).sum(axis=1, dtype=np.int64)
            total = n[k] + sizes[part]
            yield k, at[part][unlike_bits <= total + 2 * (-SHARE * total // (SHARE + WHOLE))]


def like_parts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For two wide blocks of a family: the sets that the comparison of its blocks ``first`` and ``second`` must read, which marks and
    sizes allow to be similar to a set of another component in the other block."""
    wide, part, known = rows["wide"].to_numpy(), rows["part"].to_numpy(), pd.factorize(rows["component"])[0]
    n, marks = rows["n"].to_numpy(), [np.frombuffer(m, np.uint64) for m in rows["marks"]]
    left, right = np.flatnonzero(wide == key[1]), np.flatnonzero(wide == key[2])
    chosen = []
    for k, found in alike(n[left], [marks[i] for i in left], n[right], [marks[j] for j in right]):
        k, found = left[k], right[found]
        found = found[known[found] != known[k]]
        first, second = np.minimum(part[k], part[found]), np.maximum(part[k], part[found])
        own = np.unique(np.stack([first, second], axis=1), axis=0)
        chosen += [np.column_stack([own, np.full(len(own), k)]), np.column_stack([first, second, found])]
    chosen = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *chosen]), axis=0)
    at = chosen[:, 2]
    return pd.DataFrame({"family": key[0], "first": chosen[:, 0], "second": chosen[:, 1], **{c: rows[c].to_numpy()[at] for c in ("id", "digest", "part", "component")}})


def dealt_blocks(gathered: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, first, second, id, part, component, grams): the sets that each two blocks of a family compare.

    ``gathered`` holds family, id, digest, component, n and marks. Every block meets every other by marks, a small part of the sets'
    length, ``WIDE`` of them at once; a set is read only where one of another component may be similar to it."""
    id_type = gathered.schema["id"].dataType.simpleString()
    sizes = keep_table(gathered.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts")))
    placed = gathered.dropDuplicates(["id", "digest"]).join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("id", "digest"), F.col("parts")).cast("int"))
    wide = lambda part: F.floor(part / WIDE).cast("int")
    met = placed.withColumn("wide", wide(F.col("part"))).withColumn("other", F.explode(F.sequence(F.lit(0), wide(F.col("parts") - 1))))
    met = met.select("family", F.least("wide", "other").alias("low"), F.greatest("wide", "other").alias("high"), "id", "digest", "part", "wide", "component", "n", "marks")
    chosen = met.groupBy("family", "low", "high").applyInPandas(like_parts, f"family {id_type}, first int, second int, id {id_type}, digest binary, part int, component {id_type}")
    return keep_table(chosen).join(sets.select("id", "digest", "grams"), ["id", "digest"]).select("family", "first", "second", "id", "part", "component", "grams")


def verify_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For two blocks of a family: (id, least id it hangs together with) for what is linked across components found before."""
    first, second = key[1], key[2]
    ids, part, known = rows["id"].tolist(), rows["part"].to_numpy(), rows["component"].to_numpy()
    grams = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
    left, right = np.flatnonzero(part == first), np.flatnonzero(part == second)
    forest = Forest(ids)
    for k, found in tree_links([grams[i] for i in left], [grams[i] for i in right], known[left], known[right]):
        for j in right[found].tolist():
            forest.link(ids[left[k]], ids[j])
    return forest.frame()


def verify_partners(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For some partners of one document: (id, least id) of those that are linked with it."""
    forest = Forest(rows["id"].tolist())
    own = (rows["id"] == key[0]).to_numpy()
    heads, others = rows[own], rows[~own]
    probes = [np.frombuffer(g, np.uint64) for g in heads["grams"]]
    ids = others["id"].tolist()
    for k, found in tree_links([np.frombuffer(g, np.uint64) for g in others["grams"]], probes):
        if len(found):
            forest.link(ids[k], key[0])
    return forest.frame()


def like_sizes() -> Column:
    """Sets of ``a`` and ``b`` can be similar by their sizes: the smaller holds SHARE / WHOLE of the larger at least."""
    return (WHOLE * F.col("a_high") >= SHARE * F.col("b_low")) & (WHOLE * F.col("b_high") >= SHARE * F.col("a_low"))


def worth_reading(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs whose sets can be similar by their sizes and marks, a small part of the sets' length.

    Similar sets differ in at most as many n-grams as the shared ones they need leave over; where the marks differ in more bits, the
    pair is no link. Ids that name several sets have no marks, and their pairs stay.
    """
    side = lambda x: sizes.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("low", "high", "marks")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(like_sizes())
    total = F.col("a_low") + F.col("b_low")
    spare = total - 2 * F.ceil(SHARE * total / (SHARE + WHOLE))
    return both.filter(F.coalesce(unlike(F.col("a_marks"), F.col("b_marks")) <= spare, F.lit(True))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among candidate pairs: a document meets its partners in groups of bounded number."""
    id_type = pairs.schema["a"].dataType.simpleString()
    many = keep_table(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")))
    partners = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"))
    heads = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    rows = keep_table(partners.unionByName(heads)).join(sets.select("id", "grams"), "id")
    return keep_table(rows.groupBy("a", "part").applyInPandas(verify_partners, f"a {id_type}, b {id_type}"))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links of similarity 0.8 or more) for every document.

    1. One scan hashes all sets, names equal sets and counts n-grams by bucket. 2. A second takes the rarest n-grams of each
    set: similar sets share one of those, and only the first of equal sets goes on. 3. Each document meets the least one that
    shares a rare n-gram; most copies hang together after that. Sets are read only for pairs whose marks (``worth_reading``) allow a
    link. 4. Pairs from n-grams that few share are compared where their components differ. 5. Documents that share an n-gram with many form families, cut into blocks; every two blocks meet
    by marks, and those of their sets that may be linked are one group, in which a prefix tree of one is walked with the sets of the other. Groups return (id, least id), so pairs within
    large groups are never listed, and no group grows with a family. 6. Connected components of all links.

    Null and empty texts, and texts of blanks, have no n-grams and are their own component. A null doc_id has component null. Rows
    that repeat a doc_id are compared one by one, but share its name. An empty table gives no rows. Other columns are ignored.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    scanned = keep_table(facts_and_counts(docs).withColumn("part", F.spark_partition_id()))
    level = spark.sparkContext.broadcast(rarity(scanned.filter("range is not null").select("range", "counts", "part"), "part"))
    facts = scanned.filter("range is null").select("doc_id", "n", "digest", "marks")
    classes = keep_table(facts.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("marks").alias("marks")))
    firsts = keep_table(classes.groupBy(F.col("least").alias("id")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.when(F.count("*") == 1, F.min("marks")).alias("marks")))  # more than one set only where an id repeats
    length = F.when(F.col("n") > 0, F.col("n") - F.ceil(SHARE * F.col("n") / WHOLE) + 1)
    total = facts.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    shared = keep_table(met_prefixes(docs, level, int(total)).join(firsts.select("id", "low", "high"), "id"))
    heads = keep_table(shared.groupBy("gram").agg(F.min("id").alias("head"), F.count("*").alias("k")).filter("k > 1"))
    stars = keep_table(shared.join(heads, "gram").filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"), (F.col("k") > LISTED).alias("large")))
    first_pairs = keep_table(worth_reading(stars.select("a", "b").distinct(), firsts))
    few = keep_table(shared.join(heads.filter((F.col("k") > 2) & (F.col("k") <= LISTED)).select("gram"), "gram"))
    named = lambda x: few.select("gram", F.col("id").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"))
    listed = named("a").join(named("b"), "gram").filter(F.col("a") < F.col("b")).filter(like_sizes()).select("a", "b").distinct().join(first_pairs, ["a", "b"], "left_anti")
    listed = keep_table(worth_reading(listed, firsts))
    met_ids = first_pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(listed.select(F.explode(F.array("a", "b")).alias("doc_id")))
    met_ids = keep_table(met_ids.unionByName(stars.filter("large").select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct())
    sets = keep_table(set_rows(docs.select("doc_id", "text").join(met_ids, "doc_id"), level))
    links = verified(first_pairs, sets)
    known = keep_table(components(links))
    placed_in = lambda side: known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
    apart = listed.join(placed_in("a"), "a", "left").join(placed_in("b"), "b", "left").filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")
    links = links.unionByName(verified(keep_table(apart), sets))

    families = keep_table(components(stars.filter("large").select("a", "b")))
    members = families.select(F.col("node").alias("id"), F.col("component").alias("family")).unionByName(families.select(F.col("component").alias("id"), F.col("component").alias("family")).distinct())
    known = keep_table(components(links)).select(F.col("node").alias("id"), "component")
    inside = keep_table(members.join(known, "id", "left").withColumn("component", F.coalesce("component", "id")))
    open_ = keep_table(inside.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("family"))
    gathered = sets.select("id", "digest", "n", "marks").join(inside.join(open_, "family"), "id")
    links = links.unionByName(keep_table(dealt_blocks(gathered, sets).groupBy("family", "first", "second").applyInPandas(verify_blocks, f"a {id_type}, b {id_type}")))

    roots = components(links)
    of_class = keep_table(classes.join(roots, F.col("least") == F.col("node"), "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "least").alias("component")))
    out = facts.join(of_class, (F.col("digest") == F.col("_digest")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
