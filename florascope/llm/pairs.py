"""How often two items occur in one basket, and how much more often than chance.

Every pair is one 64-bit code (lower id in the upper half). Tasks write the codes of their baskets into a buffer, sort it and
count runs; what leaves a task is sorted runs, cut into chunks of packed differences (about a byte a pair) that carry their
first code. Chunks are shuffled by a hash of the code and sorted by first code, externally if need be. The reducer is a multiway
merge: codes below the first code of the next chunk are final, so it holds one chunk of each run at a time, adds up equal
codes and passes them on.

A basket is never one task's affair: one with more than BLOCK items is cut into blocks, and each pair of blocks is a tile (basket, i, j)
that is a key of its own in the join that brings the two blocks together. An item with more than HOT_ITEM rows is numbered without
being a key of a shuffle. Where pairs on few baskets don't count, the few baskets that would make most pairs make none (set_aside).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, broadcast_if_small, dense_ids, shuffle_partitions, stage

BLOCK = 512
#: A basket of more than BLOCK items is set aside if it would make at least this share of the pairs.
ASIDE = 0.02
HOT_ITEM = 1_000_000
#: Codes in a task's buffer before it is sorted (8 bytes each), in a chunk of a run, and in the reducer before it passes on.
RUN, CHUNK, PENDING = 1 << 23, 1 << 14, 1 << 20
#: Pairs, before equal ones are added up, for each reducer.
PART_PAIRS = 1 << 28
_TRIANGLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _TRIANGLES:
        if len(_TRIANGLES) > 600:
            _TRIANGLES.clear()
        _TRIANGLES[n] = tuple(x.astype(np.int32) for x in np.triu_indices(n, 1))
    return _TRIANGLES[n]


def run_length(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts (or summed weights)."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    counts = np.diff(np.r_[start, len(codes)]) if weights is None else np.add.reduceat(weights, start)
    return codes[start], counts.astype(np.int64)


def _batch(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"code": pa.array(codes, pa.int64()), "n": pa.array(counts, pa.int64())})


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, compressed: planes of zeros cost next to nothing (about a byte a pair, against six
    for rows of code and count)."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel().astype(np.int64)


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    """The reducer of a code: by its lower id and the upper bits of the other, so that neighbours stay together."""
    x = ((codes >> 12) & 0xFFFFF) + (codes >> 32) * 0x9E3779B1
    return ((x ^ (x >> 15)) * 0x85EBCA6B & 0x7FFFFFFF) % parts


def _flush(held: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    codes = np.concatenate(held)
    held.clear()
    codes.sort()
    codes, counts = run_length(codes)
    part = _part(codes, parts)
    order = np.argsort(part, kind="stable")
    codes, counts, part = codes[order], counts[order], part[order]
    ends = np.r_[np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    rows, start = [], 0
    for end in ends:
        for i in range(start, end, CHUNK):
            c = codes[i : min(i + CHUNK, end)]
            rows.append((int(part[start]), int(c[0]), len(c), pack(np.diff(c)), pack(counts[i : i + len(c)] - 1)))
        start = end
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
        ["part", "first", "size", "codes", "counts"],
    )


def _emit(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    parts: list[np.ndarray] = []
    held = 0
    for b in batches:
        left, right = b.column("items"), b.column("others")
        lo, lv = left.offsets.to_numpy(), left.values.to_numpy(zero_copy_only=False)
        ro, rv = right.offsets.to_numpy(), right.values.to_numpy(zero_copy_only=False)
        for i in range(b.num_rows):
            a = np.sort(lv[lo[i] : lo[i + 1]])
            c = rv[ro[i] : ro[i + 1]]
            if len(c):
                x, y = np.minimum.outer(a, c).ravel(), np.maximum.outer(a, c).ravel()
            else:
                p, q = _triangle(len(a))
                x, y = a[p], a[q]
            parts.append((x.astype(np.int64) << 32) | y)
            held += len(x)
            if held >= RUN:
                yield from _flush(parts, n_parts)
                held = 0
    if parts:
        yield from _flush(parts, n_parts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the chunks of one reducer, which come in the order of part and first code."""
    codes, counts, size, now = [], [], 0, None

    def settle(before: int | None) -> Iterator[pa.RecordBatch]:
        nonlocal codes, counts, size
        if not size:
            return
        c, n = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(c, kind="stable")
        c, n = run_length(c[order], n[order])
        cut = len(c) if before is None else int(np.searchsorted(c, before))
        codes, counts, size = [c[cut:]], [n[cut:]], len(c) - cut
        for i in range(0, cut, 1 << 18):
            yield _batch(c[i : min(i + (1 << 18), cut)], n[i : min(i + (1 << 18), cut)])

    limit = PENDING
    for b in batches:
        x = b.to_pydict()
        for part, first, n, packed, counted in zip(x["part"], x["first"], x["size"], x["codes"], x["counts"], strict=True):
            if part != now:
                yield from settle(None)
                now, limit = part, PENDING
            elif size > limit:
                yield from settle(first)
                limit = max(PENDING, 2 * size)
            codes.append(np.cumsum(np.r_[first, unpack(packed, n - 1)]) if n > 1 else np.array([first]))
            counts.append(unpack(counted, n) + 1)
            size += n
    yield from settle(None)


def _numbered(tokens: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """(basket, id) of tokens (basket, item). Where words (item, id, rows) are too many to broadcast, those with more than HOT_ITEM
    rows are: there are at most as many as rows / HOT_ITEM."""
    small = broadcast_if_small(words.drop("rows"), n_words, 80)
    if n_words * 80 <= BROADCAST_BYTES:
        return tokens.join(small, "item").select("basket", "id")
    hot = words.where(F.col("rows") > HOT_ITEM).drop("rows")
    n_hot = hot.count()
    if not n_hot:
        return tokens.join(small, "item").select("basket", "id")
    hot = broadcast_if_small(hot.withColumnRenamed("id", "hot"), n_hot, 80)
    x = stage(tokens.join(hot, "item", "left"), "numbered")
    rest = x.where("hot is null").drop("hot").join(words.where(F.col("rows") <= HOT_ITEM).drop("rows"), "item").select("basket", "id")
    return rest.unionByName(x.where("hot is not null").select("basket", F.col("hot").alias("id")))


def tiles(blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """(items, others) of each pair of blocks i <= j of a basket, others empty for i = j. A tile is its own key of the join.

    parts: partitions that stay as many however few bytes they hold, since a tile is small and its pairs are not.
    """
    i, j = F.col("block"), F.col("blocks") - 1
    left = blocks.select("basket", i.alias("i"), F.explode(F.sequence(i, j)).alias("j"), "items")
    right = blocks.select("basket", F.explode(F.sequence(F.lit(0), i)).alias("i"), i.alias("j"), F.col("items").alias("others"))
    if parts:
        left, right = left.repartition(parts, "basket", "i", "j"), right.repartition(parts, "basket", "i", "j")
    both = left.join(right, ["basket", "i", "j"])
    return both.select("items", F.when(F.col("i") < F.col("j"), F.col("others")).otherwise(F.array().cast("array<int>")).alias("others"))


def set_aside(lists: DataFrame, pairs: float, most: int) -> list:
    """At most `most` baskets of lists (basket, size), the largest ones, that each would make a share of ASIDE of the pairs or more.

    A pair on min_pair baskets is on min_pair - k others than k given ones, so with k < min_pair only pairs that the others make can
    qualify; what the k add to them is looked up. Their own pairs, quadratic in their size, are never made.
    """
    if most < 1:
        return []
    top = lists.where(F.col("size") > BLOCK).orderBy(F.desc("size"), "basket").limit(min(most, 62)).collect()
    return [r for r in top if r["size"] * (r["size"] - 1) / 2 >= ASIDE * pairs]


def pair_counts(df: DataFrame, basket: str, item: str, min_pair: int = 1, min_lift: float | None = None) -> DataFrame:
    """(name_a, name_b, n_a, n_b, n_ab, n_baskets, lift, log_odds) for pairs name_a < name_b on at least min_pair baskets.

    Each basket counts once for a pair, however often the items are repeated in it. Null items and baskets don't count. lift is
    n_ab * N / (n_a * n_b); with min_lift only pairs reaching it are kept. log_odds is the log odds ratio with 0.5 added to each
    of the four cells. An empty table, or baskets of one item, give no rows. Other columns aren't read.

    Both limits bound the items a qualifying pair can have: n_a >= n_ab >= min_pair, and n_ab <= min(n_a, n_b) gives
    N >= min_lift * max(n_a, n_b). Items outside are left out before pairs are made; no qualifying pair is lost by that.
    """
    spark = df.sparkSession
    tokens = df.select(F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item")).dropna()
    words, n_words = dense_ids(tokens.groupBy("item").agg(F.count("*").alias("rows")), "item")
    if n_words >= 1 << 31:
        raise ValueError("more than 2^31 distinct items don't fit a 64-bit pair code")
    counted = words.select("item", F.col("id").cast("int").alias("id"), "rows")
    words = counted.drop("rows")
    coded = stage(_numbered(tokens, counted, n_words).distinct(), "tokens")
    sizes = coded.groupBy("basket").agg(F.count("*").alias("size"))
    n_baskets, = sizes.agg(F.count("*")).first()
    freq = coded.groupBy("id").agg(F.count("*").alias("n"))
    fit = F.col("n") >= min_pair
    if min_lift is not None:
        fit &= F.col("n") * F.lit(min_lift) <= n_baskets
    freq = stage(freq.where(fit), "freq")
    n_freq = freq.count()
    kept = coded.join(broadcast_if_small(freq.select("id"), n_freq, 16), "id", "left_semi")
    lists = kept.groupBy("basket").agg(F.count("*").alias("size"))
    pairs = lists.agg(F.coalesce(F.sum(F.col("size") * (F.col("size") - 1) / 2), F.lit(0.0))).first()[0]
    aside = set_aside(lists, pairs, min_pair - 1)
    marks = spark.createDataFrame([(r["basket"], 1 << k) for k, r in enumerate(aside)], "basket string, mark long")
    # At most 62 rows.
    own = kept.join(F.broadcast(marks), "basket").groupBy("id").agg(F.sum("mark").alias("aside"))
    freq = stage(freq.join(own, "id", "left").withColumn("aside", F.coalesce("aside", F.lit(0))), "marked")
    kept = kept.join(F.broadcast(marks), "basket", "left_anti")
    pairs -= sum(r["size"] * (r["size"] - 1) / 2 for r in aside)
    large = lists.join(F.broadcast(marks), "basket", "left_anti").where(F.col("size") > BLOCK).select("basket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    large = stage(large, "large")
    hint = broadcast_if_small(large, large.count(), 64)
    # As many reducers as the pairs at most ask for, so that none merges more than PART_PAIRS of them.
    n = max(shuffle_partitions(spark), min(1 << 15, int(pairs) // PART_PAIRS))
    # Partitions by number: those that are joined to reach some MB leave a few tasks to make all pairs.
    small = (
        kept.join(hint, "basket", "left_anti").repartition(n, "basket").groupBy("basket").agg(F.collect_list("id").alias("items"))
        .where(F.size("items") > 1).select("items", F.array().cast("array<int>").alias("others"))
    )
    # The block of an item is a hash of its id, so no block holds more than a few times BLOCK items.
    blocks = stage(
        kept.join(hint, "basket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .groupBy("basket", "block", "blocks").agg(F.collect_list("id").alias("items")), "blocks",
    )
    big = tiles(blocks, n)
    runs = small.unionByName(big).mapInArrow(lambda x: _emit(x, 8 * n), "part int, first long, size int, codes binary, counts binary")
    merged = runs.repartition(n, "part").sortWithinPartitions("part", "first").mapInArrow(_merge, "code long, n long")
    low = merged.where(F.col("n") >= min_pair - len(aside)).select(
        F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"),
        F.col("n").alias("n_rest"),
    )
    na, nb = F.col("n_a"), F.col("n_b")
    for side in ("a", "b"):
        f = freq.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("aside").alias(f"aside_{side}"))
        low = low.join(broadcast_if_small(f, n_freq, 32), side)
    low = low.withColumn("n_ab", F.col("n_rest") + F.bit_count(F.col("aside_a").bitwiseAND(F.col("aside_b")))).where(F.col("n_ab") >= min_pair)
    if min_lift is not None:
        low = low.where(F.col("n_ab") * n_baskets >= F.lit(min_lift) * na * nb)
    for side in ("a", "b"):
        w = words.select(F.col("id").alias(side), F.col("item").alias(f"name_{side}"))
        low = low.join(broadcast_if_small(w, n_words, 80), side)
    n11, n10, n01 = F.col("n_ab") + 0.5, na - F.col("n_ab") + 0.5, nb - F.col("n_ab") + 0.5
    n00 = F.lit(n_baskets) - na - nb + F.col("n_ab") + 0.5
    return low.select(
        "name_a", "name_b", "n_a", "n_b", "n_ab", F.lit(n_baskets).cast("long").alias("n_baskets"),
        (F.col("n_ab") * F.lit(float(n_baskets)) / (na * nb)).alias("lift"), F.log(n11 * n00 / (n10 * n01)).alias("log_odds"),
    )
