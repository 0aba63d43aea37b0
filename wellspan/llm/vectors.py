"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wellspan.llm.common import keep_table, row_numbers
from wellspan.llm.components import components

#: Buckets of a table for each vector of a label; tables of two joined hashes, and how many times more for each further hash.
SPACE, FIRST_TABLES, MORE_TABLES = 16, 6, 1.7


@dataclass(frozen=True)
class Hashing:
    """Tables of joined cross-polytope hashes, ``probes`` next-best buckets per table; vectors compared at once.

    How many hashes are joined follows from the number of vectors of a label (``joined``), how many tables from that (``tables``),
    so that buckets of unlike vectors stay small and a pair at the threshold is found about as surely at every size.
    """

    cosine: float = 0.93
    probes: int = 2
    block: int = 512
    lot: int = 20_000
    seed: int = 20_011

    def joined(self, vectors: int, width: int) -> int:
        """The least number, 2 or more, that gives ``SPACE`` buckets a vector."""
        n = 2
        while (2 * width) ** n < SPACE * vectors:
            n += 1
        return n

    def tables(self, joined: int) -> int:
        """``FIRST_TABLES`` for two hashes, ``MORE_TABLES`` times as many for each one more."""
        return math.ceil(FIRST_TABLES * MORE_TABLES ** (joined - 2))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def bucket_codes(x: np.ndarray, how: Hashing, joined: int) -> np.ndarray:
    """[vectors, tables, 1 + probes] bucket numbers: the own one, then those reached by the next-best vertex of one hash.

    A hash is the nearest vertex of the cross-polytope, i.e. the largest coordinate and its sign, after three rounds of
    random signs and a Hadamard transform. The probes are the vertices that lose least against the own one.
    """
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    signs = np.random.default_rng(how.seed).choice([-1.0, 1.0], size=(how.tables(joined), joined, 3, width))
    out = np.empty((n, len(signs), 1 + how.probes), np.int64)
    row = np.arange(n)
    for t in range(len(signs)):
        best, alternatives = np.zeros(n, np.int64), []
        for k in range(joined):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, k, r])
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, : how.probes + 1]
            vertex = 2 * order + (np.take_along_axis(y, order, 1) < 0)
            scale = (2 * width) ** k
            best += vertex[:, 0] * scale
            for j in range(1, how.probes + 1):
                alternatives.append((size[row, order[:, 0]] - size[row, order[:, j]], (vertex[:, j] - vertex[:, 0]) * scale))
        loss = np.stack([a for a, _ in alternatives], 1)
        step = np.stack([b for _, b in alternatives], 1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, : how.probes]
        out[:, t, 0] = best
        out[:, t, 1:] = best[:, None] + np.take_along_axis(step, pick, 1)
    return out


def checked(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the vector as bytes of float64, null where it links with nothing."""
    id_type, label_type = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for key, label, vector in zip(*(c.to_pylist() for c in batch.columns)):
                usable = key is not None and label is not None and vector and None not in vector
                x = np.asarray(vector, np.float64) if usable else np.zeros(1)
                made.append((x + 0.0).tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["vec_id", "label", "vector"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {id_type}, label {label_type}, vector binary")


def units(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(classes: DataFrame, how: Hashing) -> DataFrame:
    """Each distinct vector with all its buckets: those of a table follow each other, its own one first."""
    schema = f"id long, label {classes.schema['label'].dataType.simpleString()}, n long, vector binary, width int, codes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(3).to_pylist()], np.int64)
            joined = np.array([how.joined(k, 1 << max(1, (n // 8 - 1).bit_length())) for k, n in zip(batch.column(4).to_pylist(), lengths.tolist())], np.int64)
            for length, hashes in sorted(set(zip(lengths.tolist(), joined.tolist()))):
                part = batch.take(pa.array(np.flatnonzero((lengths == length) & (joined == hashes))))
                codes = bucket_codes(units(part.column(3).to_pylist()), how, hashes).reshape(part.num_rows, -1)
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * codes.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.full(part.num_rows, length // 8, np.int32)), lists], ["id", "label", "n", "vector", "width", "codes"])

    many = keep_table(classes.groupBy("label").agg(F.count("*").alias("many")))
    return classes.select("id", "label", "n", "vector").join(many, "label").select("id", "label", "n", "vector", "many").mapInArrow(run, schema)


def links_in(place: int, bucket: int, cut: bool, rows: pd.DataFrame, how: Hashing) -> pd.DataFrame:
    """Links in a bucket, or between two of its blocks (``cut``): for each vector its links counted here and the least id it hangs together with."""
    x, ids, n, home = units(list(rows["vector"])), rows["id"].to_numpy(), rows["n"].to_numpy(), rows["home"].to_numpy()
    met = (x @ x.T >= how.cosine) & (home[:, None] | home[None, :]) & (ids[:, None] != ids[None, :])
    if cut:
        block = rows["part"].to_numpy()
        met &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(met))
    if not len(i):
        return rows[:0].assign(links=0, least=0)[["id", "links", "least"]]
    codes = np.stack(list(rows["codes"])).reshape(len(rows), -1, 1 + how.probes)
    order = np.argsort(ids, kind="stable")
    label = np.empty_like(order)
    label[order] = np.arange(len(rows))
    while True:  # least rank among linked rows, until nothing moves
        now = label.copy()
        np.minimum.at(now, i, label[j])
        np.minimum.at(now, j, label[i])
        now = now[order[now]]
        if (now == label).all():
            break
        label = now
    counts = np.zeros(len(rows), np.int64)
    fresh = np.ones(len(i), bool)
    for t in range(place + 1):
        own, other = codes[i, t], codes[j, t]
        at_own, at_other = (other == own[:, :1]).any(1), (own == other[:, :1]).any(1)
        if t < place:
            fresh &= ~(at_own | at_other)
        else:
            fresh &= ~(at_own & (own[:, 0] < bucket)) & ~(at_other & (other[:, 0] < bucket))
    np.add.at(counts, i[fresh], n[j[fresh]])
    np.add.at(counts, j[fresh], n[i[fresh]])
    least = ids[order[label]]
    some = (counts > 0) | (least != ids)
    return pd.DataFrame({"id": ids[some], "links": counts[some], "least": least[some]})


def compare(how: Hashing):
    """The links of each bucket of a lot, or of two blocks of a large bucket."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = [links_in(place, bucket, key[1] != key[2], part, how) for (_, _, place, bucket), part in rows.groupby(["label", "width", "place", "bucket"], sort=False) if len(part) > 1]
        out = pd.concat(found) if found else rows[:0].assign(links=0, least=0)
        return out.groupby("id", as_index=False).agg({"links": "sum", "least": "min"}) if key[1] != key[2] else out[["id", "links", "least"]]

    return run


def linked(rows: DataFrame, how: Hashing = Hashing()) -> DataFrame:
    """One row for each row of (vec_id, embedding, label): n_links, component_id and kept.

    Equal vectors of a label become one class with a count, so copies cost nothing. Classes meet in buckets; vectors are sent only
    to buckets that others share. Small buckets travel in lots; a bucket with more
    than ``block`` rows is cut into blocks, and every two blocks meet in a group of their own, so no group grows with a
    bucket and none is cut short. A group gives each of its vectors a count and the least id it hangs together with, not
    pairs; a pair that shares several buckets is counted in the first.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without label or vec_id, link with nothing:
    n_links is 0 and component_id their own vec_id. Vectors of different length never link. Rows that repeat a vec_id are
    vectors of their own. An empty table gives no rows. Other columns are ignored.
    """
    kept = keep_table(checked(rows))
    distinct = kept.filter("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = keep_table(row_numbers(distinct, ["vec_id", "label", "vector"], "id")[0])  # in the order of vec_id, and unique where a vec_id repeats
    coded = keep_table(hashed(classes, how))
    every = 1 + how.probes
    spot = ["label", "width", "place", "bucket"]
    keyed = coded.select("id", "label", "width", F.posexplode("codes").alias("at", "bucket"))
    keyed = keyed.select("id", "label", "width", F.floor(F.col("at") / every).cast("int").alias("place"), "bucket", (F.col("at") % every == 0).alias("home"))
    sizes = keep_table(keyed.groupBy(*spot).agg(F.count("*").alias("rows_here"), F.max("home").alias("any_home")).filter("rows_here > 1 and any_home"))
    lots = sizes.agg(F.ceil(F.coalesce(F.sum("rows_here"), F.lit(0)) / how.lot)).first()[0]
    name = F.xxhash64(*spot)
    sizes = sizes.withColumn("parts", F.ceil(F.col("rows_here") / how.block).cast("int")).withColumn("lot", F.when(F.col("parts") == 1, F.pmod(name, F.lit(max(int(lots), 1)))).otherwise(name))
    placed = keyed.join(sizes.select(*spot, "parts", "lot"), spot).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"first": F.least("part", "other"), "second": F.greatest("part", "other")})
    met = keep_table(dealt.select("id", *spot, "home", "part", "lot", "first", "second")).join(coded.select("id", "n", "vector", "codes"), "id")
    found = keep_table(met.groupBy("lot", "first", "second").applyInPandas(compare(how), "id long, links long, least long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.filter("least != id").select(F.col("id").alias("a"), F.col("least").alias("b")))
    names = classes.select(F.col("id").alias("root"), F.col("vec_id").alias("component_id"))
    rooted = classes.join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("component", "id")).join(names, "root")
    facts = keep_table(rooted.select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = kept.join(facts, ["label", "vector"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
