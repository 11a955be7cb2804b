"""Permutation and bootstrap replicates spread over tasks.

A replicate is a row of a range; what each one needs (a matrix of checked size) travels with the function. Replicate r draws from
default_rng([seed, r]), so results don't depend on how the range is split, nor on which executor runs or repeats a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import SharedArrays, broadcast_if_small, dense_ids, shuffle_partitions, stage, staged_batches, unstage

#: Largest matrix sent along with replicates, bytes.
MATRIX_BYTES = 256 << 20
#: Cells of a sparse table that one task takes through all replicates.
CELLS = 200_000
#: Bytes of the rows of common species, and of shuffled labels sent along with blocks of distances.
DENSE_BYTES, LABEL_BYTES = 256 << 20, 64 << 20


def check_size(*arrays: np.ndarray) -> None:
    if (total := sum(a.nbytes for a in arrays)) > MATRIX_BYTES:
        raise ValueError(f"{total} bytes of matrices are too many for replicate runs (at most {MATRIX_BYTES}): group the rows first")


def replicates(spark: SparkSession, n: int, one: Callable[[np.random.Generator, int], dict | list[dict]], schema: str, seed: int = 42) -> DataFrame:
    """(rep, ...) rows that `one` gives for each replicate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b["id"]:
                got = one(np.random.default_rng([seed, int(r)]), int(r))
                rows += [{"rep": int(r), **x} for x in ([got] if isinstance(got, dict) else got)]
            if rows:
                yield pd.DataFrame(rows)

    parts = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, parts).mapInPandas(run, f"rep long, {schema}")


def species_blocks(cells: DataFrame) -> DataFrame:
    """cells with a column block: all cells of a species in one, some CELLS of them in each."""
    n = max(cells.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // CELLS))
    return cells.withColumn("block", F.pmod(F.xxhash64("species_name"), F.lit(n))).repartition(n, "block")


def permutation_p(reps: DataFrame, stat: str, observed: float | None, plus_one: bool = True) -> DataFrame:
    """One row (observed, n, p): share of replicates reaching the observed value, the observed one counted unless plus_one is off."""
    o = F.lit(observed).cast("double")
    hit = F.count_if(F.col(stat) >= o - 1e-12)
    n = F.count(stat)
    p = (hit + 1) / (n + 1) if plus_one else F.try_divide(hit, n)
    return reps.agg(o.alias("observed"), n.alias("n"), F.when(o.isNotNull(), p).alias("p"))


def to_matrix(df: DataFrame, row: str, col: str, value: str, rows: list, cols: list) -> np.ndarray:
    """Dense matrix of a long table over given row and column keys, its size checked before anything is collected."""
    if len(rows) * len(cols) * 8 > MATRIX_BYTES:
        raise ValueError(f"a matrix of {len(rows)} x {len(cols)} is too large for the driver: group the rows first")
    r, c = {k: i for i, k in enumerate(rows)}, {k: i for i, k in enumerate(cols)}
    out = np.zeros((len(rows), len(cols)))
    pdf = df.select(row, col, value).toPandas()
    ok = pdf[row].isin(r) & pdf[col].isin(c)
    pdf = pdf[ok]
    out[pdf[row].map(r).to_numpy(int), pdf[col].map(c).to_numpy(int)] = pdf[value].to_numpy(float)
    return out


def distance_matrix(pairs: DataFrame, ids: list, d: str = "d") -> np.ndarray:
    m = to_matrix(pairs, "id_a", "id_b", d, ids, ids)
    return m + m.T


def permanova_test(spark: SparkSession, dist: np.ndarray, labels: list, n: int = 999, seed: int = 42) -> DataFrame:
    check_size(dist)
    _, g = np.unique(np.asarray(labels, dtype=str), return_inverse=True)
    sq, k, m = dist**2, int(g.max()) + 1 if len(g) else 0, len(g)
    sst = sq.sum() / 2 / m if m else 0.0

    def f(grp: np.ndarray) -> float:
        hot = np.eye(k)[grp]
        ssw = float((np.einsum("ik,ij,jk->k", hot, sq, hot, optimize=True) / 2 / hot.sum(0)).sum())
        return (sst - ssw) / (k - 1) / (ssw / (m - k)) if ssw > 0 else float("inf")

    if k < 2 or m <= k:
        return permutation_p(spark.createDataFrame([], "f double"), "f", None)
    return permutation_p(replicates(spark, n, lambda rng, _: {"f": f(rng.permutation(g))}, "f double", seed), "f", f(g))


class DistanceRows:
    """The Bray-Curtis distances of plot i to plots i + 1 to m - 1, by call or in pieces; made by distance_rows().

    Species of many plots and whole abundances are rows of bytes: minima up to 255 are added up as bytes, what lies above is added entry by
    entry, as all of the other species is.
    """

    def __init__(self, arrays: SharedArrays, m: int) -> None:
        self.arrays, self.m = arrays, m

    def pieces(self, i: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first plot, distances from plot i to PIECE plots from it on); the array is used again for the next piece."""
        x, m = self.arrays, self.m
        at, col_start, big_start = x["at"], x["col_start"], x["big_start"]
        rest, small = np.zeros(m - i - 1), []
        for a in range(*x["row_start"][i : i + 2].tolist()):
            c, v = int(x["row_c"][a]), float(x["row_abund"][a])
            k = int(at[c])
            if k >= 0:
                small.append((k, int(min(v, 255))))
            if k < 0 or v > 255:
                (first, last), row, val, least = (col_start[c : c + 2], x["col_i"], x["col_abund"], 0) if k < 0 else (big_start[k : k + 2], x["big_i"], x["big_abund"], 255)
                row, val = row[first:last], val[first:last]
                after = int(np.searchsorted(row, i, "right"))
                np.add.at(rest, row[after:] - (i + 1), np.minimum(val[after:], v) - least)
        dense, total = x["dense"].reshape(-1, m), x["total"]
        some, least, out = np.empty((2, PIECE), np.uint8), _levels(), np.empty((2, PIECE))
        for lo in range(i + 1, m, PIECE):
            hi = min(lo + PIECE, m)
            n = hi - lo
            (acc, t), (d, y), held = some[:, :n], out[:, :n], 0
            d[:] = rest[lo - i - 1 : hi - i - 1]
            acc[:] = 0
            for k, v in small:
                if held + v > 255:
                    d += acc
                    acc[:] = 0
                    held = 0
                np.add(acc, np.minimum(dense[k, lo:hi], least[v, :n], out=t), out=acc)
                held += v
            d += acc
            d *= 2
            d /= np.add(total[lo:hi], total[i], out=y)
            yield lo, np.subtract(1, d, out=d)

    def __call__(self, i: int) -> np.ndarray:
        out = np.empty(self.m - i - 1)
        for lo, d in self.pieces(i):
            out[lo - i - 1 : lo - i - 1 + len(d)] = d
        return out


#: Distances that are made at a time; a row of bytes pays from one plot in so many on.
PIECE, SPARSE = 1 << 15, 50
_LEVELS: list[np.ndarray] = []


def _levels() -> np.ndarray:
    """A row of each byte: a minimum with a row is many times faster than one with a number."""
    if not _LEVELS:
        _LEVELS.append(np.repeat(np.arange(256, dtype=np.uint8)[:, None], PIECE, 1))
    return _LEVELS[0]


def distance_rows(cells: DataFrame, m: int) -> DistanceRows:
    """Rows of Bray-Curtis distances of m plots given by sparse cells (i, species_name, abund), as arrays that all tasks map.

    The cells are sorted by Spark and pass through the driver some at a time, so any number of them will do.
    """
    spark, a = cells.sparkSession, F.col("abund")
    kinds = cells.groupBy("species_name").agg(F.count("*").alias("n"), F.bool_and((a >= 0) & (a % 1 == 0)).alias("whole"), F.count_if(a > 255).alias("big"))
    ids, k = dense_ids(kinds, "species_name", "c")
    x = cells.join(broadcast_if_small(ids.select("species_name", "c"), k, 80), "species_name").select(F.col("i").cast("int").alias("i"), F.col("c").cast("int").alias("c"), "abund")
    kinds = ids.select("c", "n", "whole", "big").orderBy("c").toPandas()
    size = kinds["n"].to_numpy(np.int64)
    arrays, n = SharedArrays(spark), shuffle_partitions(spark)
    for name, cols in (("col", ["c", "i"]), ("row", ["i", "c"])):
        t, rows, total = stage(x.repartitionByRange(n, *cols).sortWithinPartitions(*cols), "sorted"), np.zeros(m, np.int64), np.zeros(m)
        arrays.put(f"{name}_{cols[1]}", np.int32, (b.column(0).to_numpy() for b in staged_batches(t, cols[1:])))
        arrays.put(f"{name}_abund", float, (b.column(0).to_numpy() for b in staged_batches(t, ["abund"])))
        if name == "row":
            for b in staged_batches(t, ["i", "abund"]):
                i, v = b.column("i").to_numpy(), b.column("abund").to_numpy()
                u, at = np.unique(i, return_inverse=True)
                rows[u] += np.bincount(at)
                total[u] += np.bincount(at, v)
        unstage(t)
    start = np.r_[0, np.cumsum(size)]
    # Each process maps the rows of bytes; DENSE_BYTES bounds the file only.
    by = np.argsort(-size, kind="stable")
    by = by[kinds["whole"].to_numpy(bool)[by] & (size[by] > m / SPARSE) & (16 * kinds["big"].to_numpy()[by] <= size[by])][: DENSE_BYTES // max(1, m)]
    at = np.full(k, -1, np.int32)
    at[by] = np.arange(len(by))
    col_i, col_abund, big = arrays["col_i"], arrays["col_abund"], []

    def dense() -> Iterator[np.ndarray]:
        for c in by:
            s, row = slice(start[c], start[c + 1]), np.zeros(m, np.uint8)
            row[col_i[s]] = np.minimum(col_abund[s], 255)
            more = np.flatnonzero(col_abund[s] > 255)
            big.append((col_i[s][more], col_abund[s][more]))
            yield row

    arrays.put("dense", np.uint8, dense())
    arrays.put("big_i", np.int32, (b[0] for b in big))
    arrays.put("big_abund", float, (b[1] for b in big))
    for name, dtype, z in (("big_start", np.int64, np.cumsum([0, *(len(b[0]) for b in big)])), ("col_start", np.int64, start), ("row_start", np.int64, np.r_[0, np.cumsum(rows)]),
                           ("total", float, total), ("at", np.int32, at)):
        arrays.put(name, dtype, iter([z]))
    return DistanceRows(arrays, m)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers from 0 on rounded as F.round does it, by their shortest decimals where they lie next to a half."""
    y = x * 10.0**digits
    low = np.floor(y)
    out = np.where(y - low >= 0.5, low + 1, low) / 10.0**digits
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def great_circle_rows(lon: np.ndarray, lat: np.ndarray) -> Callable[[int], np.ndarray]:
    """The function that gives the kilometres from place i to places i + 1 on, on a sphere of 6371 km."""
    x, y, c = np.radians(lon), np.radians(lat), np.cos(np.radians(lat))

    def one(i: int) -> np.ndarray:
        h = np.sin((y[i + 1 :] - y[i]) / 2) ** 2 + c[i] * c[i + 1 :] * np.sin((x[i + 1 :] - x[i]) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1)))

    return one


def pair_table(spark: SparkSession, ids: list[str], row: Callable[[int], np.ndarray], name: str, digits: int) -> DataFrame:
    """(id_a, id_b, name) of all pairs of rising ids, made row by row where they are written: no pair is joined or shuffled."""
    m = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(ids, pa.string())
        for first in (x for b in batches for x in b.column(0).to_pylist()):
            # A long row and a short one, so tasks are alike.
            for i in {first, m - 2 - first}:
                v = half_up(row(i), digits)
                yield pa.RecordBatch.from_pydict({"id_a": pa.repeat(names[i], len(v)), "id_b": names.slice(i + 1), name: v})

    half = m // 2
    return spark.range(0, half, 1, max(1, min(half, 16 * spark.sparkContext.defaultParallelism))).mapInArrow(run, f"id_a string, id_b string, {name} double")


def mantel_blocks(cells: DataFrame, lon: np.ndarray, lat: np.ndarray) -> float | None:
    """Pearson correlation of Bray-Curtis distances and great-circle distances of all pairs; a row of pairs at a time, only sums are kept."""
    spark, m = cells.sparkSession, len(lon)
    if m < 3:
        return None
    row, x, y = distance_rows(cells, m), np.radians(lon), np.radians(lat)
    xyz = np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, t = np.empty((2, PIECE))
        for b in batches:
            for first in b["id"]:
                s = np.zeros(5)
                # Far and near rows alternate, so tasks are alike.
                for i in range(int(first), m - 1, blocks):
                    for lo, u in row.pieces(i):
                        n = len(u)
                        u -= 1
                        # Angles by chords, in the same memory for each piece.
                        np.subtract(xyz[0, lo : lo + n], xyz[0, i], out=v[:n])
                        v[:n] *= v[:n]
                        for p in xyz[1:]:
                            np.subtract(p[lo : lo + n], p[i], out=t[:n])
                            t[:n] *= t[:n]
                            v[:n] += t[:n]
                        np.sqrt(v[:n], out=v[:n])
                        v[:n] /= 2
                        w = np.arcsin(np.minimum(v[:n], 1, out=v[:n]), out=v[:n])
                        w *= 2
                        s += [u.sum(), w.sum(), u @ u, w @ w, u @ w]
                yield pd.DataFrame([s], columns=list("abcde"))

    blocks = min(m - 1, 8 * spark.sparkContext.defaultParallelism)
    got = spark.range(0, blocks, 1, blocks).mapInPandas(run, ", ".join(f"{c} double" for c in "abcde")).collect()
    a, b, c, d, e = (math.fsum(z) for z in zip(*got, strict=True))
    n = m * (m - 1) / 2
    va, vb = c - a * a / n, d - b * b / n
    return (e - a * b / n) / math.sqrt(va * vb) if va > 0 and vb > 0 else None


def within_sums(spark: SparkSession, row: DistanceRows, value: Callable[[np.ndarray], np.ndarray], g: np.ndarray, weight: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, float]:
    """(sums over pairs within a group of value times the group's weight, for the groups g and n shuffles of them; sum over all pairs).

    value turns some distances into values. A task makes some rows and takes them through all shuffles; the n x n matrix is never whole.
    """
    m, k = len(g), len(weight)
    g = g.astype(np.min_scalar_type(k))
    draw = lambda r: np.random.default_rng([seed, r]).permutation(g) if r >= 0 else g
    labels = [draw(r) for r in range(-1, n)] if n and (n + 1) * m * g.itemsize <= LABEL_BYTES else None
    # A block's values take 64 MB at most. Every block goes through all shuffles, so there are no more blocks than that asks for.
    step = max(1, min(-(-m // (4 * spark.sparkContext.defaultParallelism)), (64 << 20) // (8 * m)))
    blocks = -(-m // step)
    tasks = min(blocks, 16 * spark.sparkContext.defaultParallelism)

    def seen(lo: int, hi: int, held: np.ndarray | None) -> tuple[list[float], float]:
        """The sums for the groups as they are, a piece of a row at a time; held: a row of ones and zeros for each group, where that isn't too much."""
        w, t = [], []
        for i in range(lo, hi):
            for at, d in row.pieces(i):
                v, s = value(d), slice(at, at + len(d))
                w.append(float(np.bincount(g[s], v, k)[g[i]] if held is None else held[g[i], s] @ v) * weight[g[i]])
                t.append(float(v.sum()))
        return [math.fsum(w)], math.fsum(t)

    def shuffled(lo: int, hi: int, held: np.ndarray) -> tuple[list[float], float]:
        # Only what lies above the diagonal is there.
        v = held[: (hi - lo) * (m - lo)].reshape(hi - lo, m - lo)
        v[:] = 0
        for i in range(lo, hi):
            for at, d in row.pieces(i):
                v[i - lo, at - lo : at - lo + len(d)] = value(d)
        sums = []
        for r in range(-1, n):
            x = (labels[r + 1] if labels else draw(r))[lo:]
            order = np.argsort(x, kind="stable")
            ends = np.searchsorted(x[order], np.arange(k + 1))
            rows = x[: hi - lo]
            sums.append(math.fsum(float(v[np.ix_(np.flatnonzero(rows == q), order[ends[q] : ends[q + 1]])].sum()) * weight[q] for q in np.unique(rows)))
        return sums, float(v.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty(step * m) if n else (np.arange(k)[:, None] == g).astype(float) if 8 * k * m <= LABEL_BYTES else None
        for first in (int(x) for b in batches for x in b["id"]):
            w, t = np.zeros(n + 1), 0.0
            # Far and near blocks alternate, so tasks are alike.
            for lo in range(first * step, m, tasks * step):
                a, b = (shuffled if n else seen)(lo, min(lo + step, m), held)
                w, t = w + a, t + b
            yield pd.DataFrame({"id": [first], "w": [w.tolist()], "t": [t]})

    w, t = np.zeros(n + 1), 0.0
    for x in sorted(spark.range(0, tasks, 1, tasks).mapInPandas(run, "id long, w array<double>, t double").collect()):
        w, t = w + x.w, t + x.t
    return w, t


def permanova_blocks(cells: DataFrame, labels: list, n: int = 999, seed: int = 42) -> DataFrame:
    """permanova_test of Bray-Curtis distances on sparse cells (i, species_name, abund), i the plot's place in labels."""
    spark = cells.sparkSession
    _, g = np.unique(np.asarray(labels, dtype=str), return_inverse=True)
    k, m = int(g.max()) + 1 if len(g) else 0, len(g)
    if k < 2 or m <= k:
        return permutation_p(spark.createDataFrame([], "f double"), "f", None)
    row = distance_rows(cells, m)
    w, t = within_sums(spark, row, np.square, g, 1 / np.bincount(g, minlength=k), n, seed)
    f = [(t / m - x) / (k - 1) / (x / (m - k)) if x > 0 else float("inf") for x in w.tolist()]
    return permutation_p(spark.createDataFrame([(x,) for x in f[1:]], "f double"), "f", f[0])


def distance_counts(cells: DataFrame, labels: list) -> DataFrame:
    """(d, same, n) of each distinct Bray-Curtis distance, in units of 1e-10: pairs that have it within a group, and in all."""
    spark, m = cells.sparkSession, len(labels)
    _, g = np.unique(np.asarray(labels, dtype=str), return_inverse=True)
    if m < 2:
        return spark.createDataFrame([], "d long, same long, n long")
    row = distance_rows(cells, m)

    def merged(parts: list[tuple]) -> tuple:
        u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return u, np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in b["id"]:
                parts, held = [], 0
                for i in range(int(first), m - 1, blocks):
                    # The last bit tells pairs within a group.
                    parts.append(np.unique(2 * units(row(i)) + (g[i + 1 :] == g[i]), return_counts=True))
                    held += len(parts[-1][0])
                    if held > 1 << 22:
                        parts = [merged(parts)]
                        held = 0
                        if len(parts[0][0]) > 1 << 21:
                            yield counted(*parts.pop())
                if parts:
                    yield counted(*merged(parts))

    def counted(d: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"d": d >> 1, "same": n * (d & 1), "n": n})

    blocks = min(m - 1, 8 * spark.sparkContext.defaultParallelism)
    x = spark.range(0, blocks, 1, blocks).mapInPandas(run, "d long, same long, n long")
    return stage(x.groupBy("d").agg(F.sum("same").alias("same"), F.sum("n").alias("n")), "distances")


def units(d: np.ndarray) -> np.ndarray:
    """Distances rounded to ten digits, as whole numbers: what differs by rounding errors only is tied."""
    return np.floor(d * 1e10 + 0.5).astype(np.int64)


def rank_lookup(arrays: SharedArrays) -> Callable[[np.ndarray], np.ndarray]:
    """The function that gives the ranks (array rank) of some of the rising keys (array d), by a table of where keys of the same leading bits begin."""
    keys = arrays["d"]
    shift = max(0, int(keys[-1]).bit_length() - 22)
    arrays.put("first", np.int64, iter([np.searchsorted(keys, np.arange((int(keys[-1]) >> shift) + 1, dtype=np.int64) << shift)]))

    def of(x: np.ndarray) -> np.ndarray:
        keys = arrays["d"]
        at = arrays["first"][x >> shift]
        left = np.flatnonzero(keys[at] < x)
        while len(left):
            at[left] += 1
            left = left[keys[at[left]] < x[left]]
        return arrays["rank"][at]

    return of


def anosim_blocks(cells: DataFrame, labels: list, n: int = 999, seed: int = 42) -> DataFrame:
    """anosim_test of Bray-Curtis distances, rounded to ten digits, on sparse cells (i, species_name, abund), i the plot's place in labels.

    Distances are made twice: to count the distinct ones, whose ranks are arrays that tasks map, and to add up ranks within groups.
    """
    spark, m = cells.sparkSession, len(labels)
    _, g = np.unique(np.asarray(labels, dtype=str), return_inverse=True)
    counts = distance_counts(cells, labels)
    t = stage(counts.orderBy("d"), "ranks")
    pairs, inner = m * (m - 1) // 2, t.agg(F.coalesce(F.sum("same"), F.lit(0))).first()[0]
    if not 0 < inner < pairs:
        return permutation_p(spark.createDataFrame([], "r double"), "r", None)

    def ranks() -> Iterator[np.ndarray]:
        before = 0
        for b in staged_batches(t, ["n"]):
            n = b.column(0).to_numpy()
            ends = before + np.cumsum(n)
            yield ends - (n - 1) / 2
            before = int(ends[-1])

    arrays = SharedArrays(spark)
    arrays.put("d", np.int64, (b.column(0).to_numpy() for b in staged_batches(t, ["d"])))
    arrays.put("rank", float, ranks())
    unstage(counts, t)
    row, rank = distance_rows(cells, m), rank_lookup(arrays)
    w, total = within_sums(spark, row, lambda d: rank(units(d)), g, np.ones(int(g.max()) + 1), n, seed)
    r = [((total - x) / (pairs - inner) - x / inner) / (pairs / 2) for x in w.tolist()]
    return permutation_p(spark.createDataFrame([(x,) for x in r[1:]], "r double"), "r", r[0])


def mantel_p_blocks(cells: DataFrame, lon: np.ndarray, lat: np.ndarray, n: int = 999, seed: int = 42) -> DataFrame:
    """mantel_test of Bray-Curtis and great-circle distances of all pairs, by rows of pairs; cells as for mantel_blocks.

    The shuffle of a replicate sends the places around instead of the plots, so neither matrix is whole: great-circle distances
    are made anew for every replicate, and only their sum of products with the others differs.
    """
    spark, m = cells.sparkSession, len(lon)
    if m < 3:
        return permutation_p(spark.createDataFrame([], "r double"), "r", None)
    row, x, y = distance_rows(cells, m), np.radians(lon), np.radians(lat)
    xyz = np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])

    def place(r: int) -> np.ndarray:
        """Places by plot, so that the plots' distances meet those of the places as if the plots had been shuffled."""
        return xyz if r < 0 else xyz[:, np.argsort(np.random.default_rng([seed, r]).permutation(m))]

    def angles(p: np.ndarray, i: int) -> np.ndarray:
        d = p[:, i + 1 :] - p[:, i : i + 1]
        d *= d
        h = d.sum(0)
        return 2 * np.arcsin(np.minimum(np.sqrt(h, out=h) / 2, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in b["id"] * step:
                rows = [row(i) - 1 for i in range(lo, min(lo + step, m - 1))]
                products = [math.fsum(float(u @ angles(p, lo + i)) for i, u in enumerate(rows)) for p in map(place, range(-1, n))]
                s = [0.0] * 4
                for i, u in enumerate(rows):
                    v = angles(xyz, lo + i)
                    s = [a + float(z) for a, z in zip(s, (u.sum(), v.sum(), u @ u, v @ v), strict=True)]
                yield pd.DataFrame({"lo": lo, "s": [s], "w": [products]})

    # A block's rows take 32 MB at most; every block draws all shuffles.
    step = max(1, min(-(-m // (8 * spark.sparkContext.defaultParallelism)), (32 << 20) // (8 * m)))
    blocks = -(-(m - 1) // step)
    got = spark.range(0, blocks, 1, blocks).mapInPandas(run, "lo long, s array<double>, w array<double>").orderBy("lo")
    s, w = np.zeros(4), np.zeros(n + 1)
    for g in got.collect():
        s, w = s + g.s, w + g.w
    a, b, c, d = s.tolist()
    k = m * (m - 1) / 2
    va, vb = c - a * a / k, d - b * b / k
    if not (va > 0 and vb > 0):
        return permutation_p(spark.createDataFrame([], "r double"), "r", None)
    r = np.abs((w - a * b / k) / math.sqrt(va * vb)).tolist()
    return permutation_p(spark.createDataFrame([(z,) for z in r[1:]], "r double"), "r", r[0])


def mantel_test(spark: SparkSession, a: np.ndarray, b: np.ndarray, n: int = 999, seed: int = 42) -> DataFrame:
    """Two-sided: absolute correlations are compared."""
    check_size(a, b)
    iu = np.triu_indices(len(a), 1)

    def r(p: np.ndarray | None = None) -> float:
        x = a if p is None else a[np.ix_(p, p)]
        return abs(float(np.corrcoef(x[iu], b[iu])[0, 1]))

    return permutation_p(replicates(spark, n, lambda rng, _: {"r": r(rng.permutation(len(a)))}, "r double", seed), "r", r())


def anosim_test(spark: SparkSession, dist: np.ndarray, labels: list, n: int = 999, seed: int = 42) -> DataFrame:
    check_size(dist)
    lab = np.asarray(labels, dtype=str)
    iu = np.triu_indices(len(dist), 1)
    ranks = pd.Series(dist[iu]).rank().to_numpy()

    def r(x: np.ndarray) -> float:
        same = x[iu[0]] == x[iu[1]]
        return float((ranks[~same].mean() - ranks[same].mean()) / (len(ranks) / 2))

    return permutation_p(replicates(spark, n, lambda rng, _: {"r": r(rng.permutation(lab))}, "r double", seed), "r", r(lab))


def _anova(x: np.ndarray, g: np.ndarray) -> float:
    k = int(g.max()) + 1
    m = np.bincount(g, minlength=k)
    mean = np.bincount(g, x, k) / m
    ssw = float(((x - mean[g]) ** 2).sum())
    return float((m * (mean - x.mean()) ** 2).sum() / (k - 1)) / (ssw / (len(x) - k)) if ssw > 0 else float("inf")


def permdisp_test(spark: SparkSession, coords: np.ndarray, labels: list, n: int = 999, seed: int = 42) -> DataFrame:
    """Distances to group centroids (groups of one left out), F permuted over the distances."""
    check_size(coords)
    names, g, m = np.unique(np.asarray(labels, dtype=str), return_inverse=True, return_counts=True)
    keep = m[g] >= 2
    _, g = np.unique(g[keep], return_inverse=True)
    x = coords[keep]
    centre = np.stack([x[g == k].mean(0) for k in range(int(g.max()) + 1)])
    d = np.sqrt(((x - centre[g]) ** 2).sum(1))
    return permutation_p(replicates(spark, n, lambda rng, _: {"f": _anova(rng.permutation(d), g)}, "f double", seed), "f", _anova(d, g))


def indval_test(spark: SparkSession, occ: np.ndarray, species: list[str], labels: list, n: int = 999, seed: int = 42) -> DataFrame:
    """(species_name, stat, p): one matrix product of presence and shuffled labels a replicate, for all species at once."""
    check_size(occ)
    _, g = np.unique(np.asarray(labels, dtype=str), return_inverse=True)
    k = int(g.max()) + 1
    size = np.bincount(g, minlength=k)

    def stat(grp: np.ndarray) -> np.ndarray:
        means = occ.T @ np.eye(k)[grp] / size
        best = means.max(1)
        return best / (means.sum(1) + 1e-12) * best

    seen = stat(g)
    reps = replicates(spark, n, lambda rng, _: {"hit": (stat(rng.permutation(g)) >= seen - 1e-12).astype(int).tolist()}, "hit array<int>", seed)
    hits = reps.select(F.posexplode("hit").alias("i", "hit")).groupBy("i").agg(((F.sum("hit") + 1) / (F.count("*") + 1)).alias("p"))
    base = spark.createDataFrame([(i, s, float(v)) for i, (s, v) in enumerate(zip(species, seen, strict=True))], "i int, species_name string, stat double")
    return base.join(hits, "i").drop("i")


def indval_cells(cells: DataFrame, labels: list, n: int = 999, seed: int = 42) -> DataFrame:
    """(species_name, stat, p, p_adj) of every species of sparse cells (i, species_name), i the plot's place in labels.

    Blocks of species draw the same shuffles as indval_test, so the split changes nothing. p_adj is over all species.
    """
    from .ranks import bh_adjust

    _, g = np.unique(np.asarray(labels, dtype=str), return_inverse=True)
    k, g = int(g.max()) + 1, g.astype(np.int32)
    size = np.bincount(g, minlength=k)

    def block(b: pd.DataFrame) -> pd.DataFrame:
        at, names = pd.factorize(b["species_name"])
        row, base = b["i"].to_numpy(), at * k

        def stat(grp: np.ndarray) -> np.ndarray:
            means = np.bincount(base + grp[row], minlength=k * len(names)).reshape(-1, k) / size
            best = means.max(1)
            return best / (means.sum(1) + 1e-12) * best

        seen, hits = stat(g), np.zeros(len(names), int)
        for r in range(n):
            hits += stat(np.random.default_rng([seed, r]).permutation(g)) >= seen - 1e-12
        return pd.DataFrame({"species_name": names, "stat": seen, "p": (hits + 1) / (n + 1)})

    x = species_blocks(cells.select("i", "species_name").distinct()).groupBy("block").applyInPandas(block, "species_name string, stat double, p double")
    return bh_adjust(stage(x, "indval"), "p").select("species_name", "stat", "p", "p_adj")


def bootstrap_line(spark: SparkSession, x: np.ndarray, y: np.ndarray, n: int = 500, points: int = 300, seed: int = 42) -> DataFrame:
    """(x, low, high): 2.5 and 97.5 percentiles of regression lines over resampled rows."""
    check_size(x, y)
    at = np.linspace(x.min(), x.max(), points)

    def one(rng: np.random.Generator, _: int) -> list[dict]:
        i = rng.integers(0, len(x), len(x))
        if np.ptp(x[i]) == 0:
            return []
        b, a = np.polyfit(x[i], y[i], 1)
        return [{"x": float(v), "fit": float(a + b * v)} for v in at]

    q = replicates(spark, n, one, "x double, fit double", seed).groupBy("x").agg(F.percentile("fit", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select("x", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
