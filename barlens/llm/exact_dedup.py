"""Exact duplicates by counting quotient filters.

A fingerprint of 64 bits is a quotient (its high bits) and a remainder.  A counting
quotient filter keeps, for each occupied quotient, its remainders in order with a count;
nothing is lost, so two filters merge by walking both in order and adding the counts of
equal remainders.  Every task builds one filter of the fingerprints it reads, cut by
quotient range; the pieces of a range meet in one task and merge.  A hot fingerprint is
one entry with a count before anything is shuffled.  Fingerprints counted more than once
route their documents to byte verification, which groups the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.arrays import U64
from barlens.llm.frames import lower_ascii, map_batches, stored, text_of

#: Fingerprints of one merged range, about; the number of ranges follows the number of rows.
RANGE_ROWS = 250_000
QUOTIENT_BITS = 32


class CountingQuotientFilter:
    """Quotients in order, the length of each one's run, and the runs' remainders and counts."""

    def __init__(self, quotients: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.quotients, self.lengths, self.remainders, self.counts = quotients, lengths, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        values = fingerprints[order]
        weights = np.ones(len(values), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weights, first) if len(first) else weights
        distinct = values[first]
        quotients, lengths = np.unique((distinct >> U64(64 - QUOTIENT_BITS)).astype(np.int64), return_counts=True)
        return cls(quotients, lengths, (distinct & U64((1 << (64 - QUOTIENT_BITS)) - 1)).astype(np.int64), sums)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.lengths).astype(U64) << U64(64 - QUOTIENT_BITS)) | self.remainders.astype(U64)

    @classmethod
    def merged(cls, parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Runs of equal quotients meet, their remainders in order; counts of equal remainders add up."""
        return cls.of(np.concatenate([p.fingerprints() for p in parts]), np.concatenate([p.counts for p in parts]))

    def pieces(self, ranges_log2: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut into ranges of quotients."""
        of_range = self.quotients >> (QUOTIENT_BITS - ranges_log2)
        ends = np.concatenate(([0], np.cumsum(self.lengths)))
        for r in np.unique(of_range):
            a, b = np.searchsorted(of_range, [r, r + 1])
            lo, hi = ends[a], ends[b]
            yield int(r), CountingQuotientFilter(self.quotients[a:b], self.lengths[a:b], self.remainders[lo:hi], self.counts[lo:hi])


LISTS = pa.list_(pa.int64())
PIECE = "range int, quotients array<long>, lengths array<long>, remainders array<long>, counts array<long>"


def repeated_fingerprints(prints: DataFrame, column: str = "fp") -> DataFrame:
    """fp and n of every value of the long column ``column`` that occurs more than once."""
    rows = prints.count()
    ranges_log2 = max(4, int(np.ceil(np.log2(max(1, rows) / RANGE_ROWS + 1))))

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: CountingQuotientFilter | None = None
        for batch in it:
            part = CountingQuotientFilter.of(np.asarray(batch.column(0)).view(U64))
            whole = part if whole is None else CountingQuotientFilter.merged([whole, part])
            if len(whole.counts) >= 1 << 20:  # bounds the memory of a task
                yield piece_rows(whole)
                whole = None
        if whole is not None:
            yield piece_rows(whole)

    def piece_rows(whole: CountingQuotientFilter) -> pa.RecordBatch:
        cut = list(whole.pieces(ranges_log2))
        return pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in cut], pa.int32()), *(pa.array([getattr(p, k) for _, p in cut], LISTS) for k in ("quotients", "lengths", "remainders", "counts"))],
            ["range", "quotients", "lengths", "remainders", "counts"])

    def merge(group: pa.Table) -> pa.Table:
        parts = [CountingQuotientFilter(*(np.asarray(group.column(k)[i].values) for k in ("quotients", "lengths", "remainders", "counts"))) for i in range(group.num_rows)]
        whole = CountingQuotientFilter.merged(parts)
        more = whole.counts > 1
        return pa.table({"fp": whole.fingerprints()[more].view(np.int64), "n": whole.counts[more]})

    pieces = prints.where(F.col(column).isNotNull()).select(F.col(column).cast("long")).mapInArrow(build, PIECE)
    return pieces.groupBy("range").applyInArrow(merge, "fp long, n long")


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def exact_groups(docs: DataFrame, fingerprint=fingerprint) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when their bytes are equal after lower-casing A-Z; null counts as empty,
    so null and empty texts form one group.  The largest doc_id of a group stays.  A null
    doc_id counts as the smallest and stays only where all ids of its group are null.  Rows that
    repeat both id and text are counted each and bear the same marks.  Other columns are not
    read; an empty table gives an empty result.
    """
    normal = lower_ascii(text_of())
    narrow = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), fingerprint(normal).alias("fp"), F.sha2(normal.cast("binary"), 256).alias("text_sha256")), "op5-prints")
    repeated = stored(repeated_fingerprints(narrow), "op5-repeated")
    # byte verification: whole texts of the routed documents, grouped as they are; a hot text is one row after the map side
    routed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal.alias("normal")).withColumn("fp", fingerprint(F.col("normal")))
    groups = stored(
        routed.join(repeated.select("fp"), "fp", "left_semi").groupBy("normal")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2(F.col("normal").cast("binary"), 256).alias("sha"), "keep_id", "group_size"), "op5-groups")
    joined = narrow.join(groups, narrow["text_sha256"] == groups["sha"], "left")
    single = F.col("sha").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows that repeat id and text one stays."""
    key = "_text_sha256_of_copies"
    marks = exact_groups(docs).where("group_size > 1")
    lost = marks.where(~F.col("kept")).select(F.col("doc_id").alias("_id_of_copy"), F.col("text_sha256").alias("_sha_of_copy")).distinct()
    keyed = docs.withColumn(key, F.sha2(lower_ascii(text_of()).cast("binary"), 256))
    rest = keyed.join(lost, keyed["doc_id"].cast("long").eqNullSafe(lost["_id_of_copy"]) & (keyed[key] == lost["_sha_of_copy"]), "left_anti")
    return rest.dropDuplicates(["doc_id", key]).drop(key)
