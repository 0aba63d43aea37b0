"""Shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wellspan.llm.common import row_numbers

#: (p, q) of the round function ((x + p) * (x + q)) mod PRIME, one pair per round.
ROUNDS = [(7919, 104729), (15485863, 32452843), (49979687, 67867967), (86028121, 122949823), (141650939, 160481183), (179424673, 198491317)]
PRIME = 2147483647


def halves(n: int) -> tuple[int, int]:
    """Sides of a rectangle that holds n numbers with the least excess among a thousand near the square.

    Sides of like size let both halves mix well; the excess bounds the length of every cycle walk.
    """
    root = math.isqrt(max(0, n - 1)) + 1
    a = min(range(root, root + 1000), key=lambda side: (-n % side, side))
    return a, max(1, -(-n // a))


def feistel(x: Column, a: int, b: int) -> Column:
    """A permutation of 0 .. a*b-1: the halves x div b and x mod b take turns in moving each other."""
    left, right = F.call_function("div", x, F.lit(b)), x % F.lit(b)
    for k, (p, q) in enumerate(ROUNDS):
        side = left if k % 2 else right
        moved = ((side + F.lit(p)) * (side + F.lit(q))) % F.lit(PRIME)
        if k % 2:
            right = (right + moved) % F.lit(b)
        else:
            left = (left + moved) % F.lit(a)
    return left * F.lit(b) + right


def permuted(x: Column, n: int) -> Column:
    """A permutation of 0 .. n-1: numbers that land outside walk on along their cycle until they are inside.

    A walk passes only numbers outside, so it has as many steps as there are such numbers at most.
    """
    a, b = halves(n)
    first = feistel(x, a, b)
    if a * b == n:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), first, lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b)))
    return F.when(first < n, first).otherwise(walk)


def shard(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Deal documents to shards whose row counts differ by one at most, in a reproducible shuffled order.

    Rows are numbered by (doc_id, size, text_crc32), nulls first; the permuted number gives shard and slot by remainder and
    quotient, so either can be computed for any row number without a table. Returns doc_id, size (UTF-8 bytes plus 1),
    text_crc32, law, shard, slot, grown_shard (null) and row_number.

    A null text counts as empty. Rows with equal id and text are separate rows with neighbouring numbers. An empty table gives
    no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, n = row_numbers(narrow, ["doc_id", "size", "text_crc32"], "row_number")
    at = numbered.withColumn("_at", permuted(F.col("row_number"), n))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_at") % n_shards).cast("int").alias("shard"),
        F.call_function("div", F.col("_at"), F.lit(n_shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
