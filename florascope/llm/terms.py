"""Occurrences and records of every term, by last-seen counters.

Tokens are partitioned by record (and by a salt of the term, so that one huge record is spread over many tasks) and ordered
by record. Each task keeps, for each term, its occurrences, its records and the record it was last seen in; a term counts one
record more only when the record differs from the last one. No set of records is held anywhere. As all tokens of a term in a
record fall into one task, the partial counters of the tasks add up to the exact figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions

#: Terms a task's table may hold; beyond, the counters are handed on at the next change of record and begin anew.
MAX_TERMS = 1_000_000


class LastSeen:
    """occurrences, records and last record identifier of each term met so far."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)

    def _ids(self, terms: list[str]) -> np.ndarray:
        index = self.index
        ids = np.fromiter((index.setdefault(t, len(index)) for t in terms), np.int64, len(terms))
        if len(index) > len(self.last):
            size = max(len(index), 2 * len(self.last))
            for name, fill in (("occurrences", 0), ("records", 0), ("last", -1)):
                new = np.full(size, fill, np.int64)
                old = getattr(self, name)
                new[: len(old)] = old
                setattr(self, name, new)
        return ids

    def add(self, terms: pa.Array, records: np.ndarray) -> None:
        """terms and the running number of each one's record, in the order of records."""
        coded = terms.dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        order = np.argsort(ids, kind="stable")
        ids, records = ids[order], records[order]
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        before = np.r_[-1, records[:-1]]
        before[start] = self.last[ids[start]]
        seen = ids[start]
        self.occurrences[seen] += np.diff(np.r_[start, len(ids)])
        self.records[seen] += np.add.reduceat((records != before).astype(np.int64), start)
        self.last[seen] = records[np.r_[start[1:], len(ids)] - 1]

    def rows(self) -> pa.RecordBatch:
        n = len(self.index)
        return pa.RecordBatch.from_pydict(
            {"term": pa.array(list(self.index), pa.string()), "occurrences": self.occurrences[:n], "records": self.records[:n]}
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, number, last = LastSeen(), 0, None
    for b in batches:
        if not b.num_rows:
            continue
        record = b.column("record").dictionary_encode()
        at, names = record.indices.to_numpy(), record.dictionary
        change = np.r_[names[int(at[0])].as_py() != last, at[1:] != at[:-1]]
        if len(seen.index) > MAX_TERMS and change.any():
            # Up to the first change of record the old counters go on; then they are handed over.
            cut = int(np.argmax(change))
            if cut:
                seen.add(b.column("term").slice(0, cut), np.full(cut, number, np.int64))
            yield seen.rows()
            seen = LastSeen()
            b, change = b.slice(cut), change[cut:]
        records = number + np.cumsum(change)
        seen.add(b.column("term"), records)
        number, last = int(records[-1]), names[int(at[-1])].as_py()
    if seen.index:
        yield seen.rows()


def record_sizes(df: DataFrame, record: str) -> tuple[int, int, int]:
    """Number of records, of their rows, and rows of the largest one; a null record doesn't count."""
    x = df.where(F.col(record).isNotNull()).groupBy(record).agg(F.count("*").alias("n"))
    return x.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()


def salts_for(rows: int, largest: int, partitions: int) -> int:
    """Parts that records are cut into, so that the largest one's fill no more than a partition each: a record of s times a
    partition's rows asks for s parts (times four, as terms don't spread evenly)."""
    return max(16, min(1 << 16, 4 * -(-largest * partitions // max(rows, 1))))


def term_counts(df: DataFrame, term: str, record: str, salts: int | None = None) -> DataFrame:
    """(term, occurrences, records) of every distinct term of the whole table. salts: parts a record is cut into; from the sizes if
    not given.

    A null term or record doesn't count; empty strings are terms like others. Repeated rows are occurrences of their own. An
    empty table gives no rows. Other columns of df, whatever their names, aren't read.
    """
    tokens = df.select(F.col(term).cast("string").alias("term"), F.col(record).cast("string").alias("record")).dropna()
    n = shuffle_partitions(df.sparkSession)
    if salts is None:
        _, rows, largest = record_sizes(tokens, "record")
        salts = salts_for(rows, largest, n)
    parted = tokens.repartition(n, F.xxhash64("record", F.pmod(F.xxhash64("term"), F.lit(salts)))).sortWithinPartitions("record")
    partial = parted.mapInArrow(_count, "term string, occurrences long, records long")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, n_records: int, rare_below: int = 3, common_over: int = 5) -> DataFrame:
    """Adds mark: 'rare' for terms in fewer than rare_below records, 'common' for those in more than one of common_over
    records; 'rare' goes first; null otherwise."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_over > n_records, "common")
    return counts.withColumn("mark", mark)


def brute_counts(pdf: pd.DataFrame, term: str, record: str) -> dict[str, tuple[int, int]]:
    """The same by sets, for tests."""
    x = pdf[[term, record]].dropna()
    return {t: (len(g), g[record].nunique()) for t, g in x.groupby(term)}
