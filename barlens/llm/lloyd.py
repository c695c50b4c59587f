"""Product-quantisation codes by Lloyd rounds over resident members.

Every vector is cut into 16 parts.  A part lives with the owner of its codebook entry: rows
are blocks of parts, partitioned by (position, entry, salt).  A block carries the number
and the sum of its members, so owners update their entries from a few numbers per block,
without a look at the members.  An assignment runs over the blocks where they are:
members that keep their entry are written back in place, and only those that change it
travel, in the next shuffle, to their new owner.  The codebooks are the one thing that all
tasks need: at most 16 x 64 entries, however many vectors there are.

All numbers are integers, so sums and distances are exact and don't depend on how the members lie.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.frames import map_batches, stored
from barlens.session import scratch_dir

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Quantised components beyond this count as this much, so that squares and sums fit 64 bits.
LARGEST = 1 << 26
#: Members of one salted owner, and of one of its blocks.
OWNER_MEMBERS, BLOCK_MEMBERS = 1 << 18, 1 << 14

BLOCK = "position int, entry int, n long, sums array<long>, uids binary, members binary"


def is_whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantised(vector: Column, dim: int) -> Column:
    """Integer components, zeros up to ``dim``."""
    clipped = F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * SCALE))).cast("int"))
    return F.concat(clipped, F.array_repeat(F.lit(0), F.lit(dim) - F.size(vector)))


class Codebooks:
    """Entries of all positions: ``entries[position, entry]`` has the components."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries

    def nearest(self, position: int, members: np.ndarray, rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each member; of equally near entries the first."""
        book = self.entries[position]
        entry, error = np.empty(len(members), np.int64), np.empty(len(members), np.int64)
        for a in range(0, len(members), rows):
            part = members[a: a + rows].astype(np.int64)
            far = np.zeros((len(part), len(book)), np.int64)
            for k in range(book.shape[1]):
                apart = part[:, k, None] - book[None, :, k]
                far += apart * apart
            entry[a: a + rows] = near = far.argmin(1)
            error[a: a + rows] = far[np.arange(len(part)), near]
        return entry, error

    def updated(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Each entry becomes the floor of its members' mean; entries without members stay."""
        entries = self.entries.copy()
        for (position, entry), (n, total) in sums.items():
            entries[position, entry] = [x // n for x in total]
        return Codebooks(entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def block_rows(position: int, entry: np.ndarray, uids: np.ndarray, members: np.ndarray) -> list[tuple]:
    """One row for each entry that occurs, in pieces of at most ``BLOCK_MEMBERS``."""
    order = np.argsort(entry, kind="stable")
    entry, uids, members = entry[order], uids[order], members[order]
    out = []
    edges = [0, *(np.flatnonzero(np.diff(entry)) + 1).tolist(), len(entry)]
    for lo, hi in zip(edges, edges[1:]):
        for a in range(lo, hi, BLOCK_MEMBERS):
            b = min(a + BLOCK_MEMBERS, hi)
            out.append((position, int(entry[a]), b - a, members[a:b].astype(np.int64).sum(0).tolist(), uids[a:b].tobytes(), members[a:b].tobytes()))
    return out


def block_batch(rows: list[tuple], *more: tuple[str, list, pa.DataType]) -> pa.RecordBatch:
    kinds = (("position", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("uids", pa.binary()), ("members", pa.binary()))
    columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)] + [pa.array(values, kind) for _, values, kind in more]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in kinds] + [name for name, _, _ in more])


def read_block(batch: pa.RecordBatch, i: int, width: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """position, entry, uids, members."""
    return batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.frombuffer(batch.column(4)[i].as_py(), np.int64), \
        np.frombuffer(batch.column(5)[i].as_py(), np.int32).reshape(-1, width)


def gathered_blocks(moving: DataFrame, salts: int, width: int) -> DataFrame:
    """Blocks on their way, joined at the owner (position, entry, salt); a block stays whole, its first member salts it.

    An owner's blocks arrive one after the other and are joined batch by batch, so a task holds a batch and not an owner.
    """
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        rows, a = [], 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            held = [read_block(batch, i, width) for i in range(a, b)]
            uids, members = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            rows += block_rows(keys[a][0], np.full(len(uids), keys[a][1]), uids, members)
            a = b
        yield block_batch(rows)

    owner = ["position", "entry", "salt"]
    salted = moving.withColumn("salt", F.pmod(F.xxhash64(F.substring("uids", 1, 8)), F.lit(salts)))
    return map_batches(salted.repartition(*owner).sortWithinPartitions(*owner).drop("salt"), run, BLOCK)


def placed(vectors: DataFrame, books: Codebooks, width: int, salts: int) -> DataFrame:
    """Every part at the owner of its nearest entry: the one shuffle that moves them all."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not len(batch):
            return
        uids = np.asarray(batch.column(0)).astype(np.int64)
        x = np.asarray(batch.column(1).flatten(), np.int32).reshape(len(batch), PARTS, width)
        rows = []
        for p in range(PARTS):
            part = np.ascontiguousarray(x[:, p])
            rows += block_rows(p, books.nearest(p, part)[0], uids, part)
        yield block_batch(rows)

    return gathered_blocks(map_batches(vectors.select("uid", "x"), run, BLOCK), salts, width)


def reassigned(blocks: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """Blocks after an assignment, with ``moved``: false for the members that keep their entry, true for those that leave."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(len(batch)):
            position, entry, uids, members = read_block(batch, i, width)
            now, _ = books.nearest(position, members)
            rows = block_rows(position, now, uids, members)
            yield block_batch(rows, ("moved", [r[1] != entry for r in rows], pa.bool_()))

    return map_batches(blocks, run, BLOCK + ", moved boolean")


def coded(blocks: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """uid, position, entry, error of every part by a last assignment, made where the members are."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(len(batch)):
            position, _, uids, members = read_block(batch, i, width)
            entry, error = books.nearest(position, members)
            yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(np.full(len(uids), position, np.int32)), pa.array(entry.astype(np.int32)), pa.array(error)], ["uid", "position", "entry", "error"])

    return map_batches(blocks, run, "uid long, position int, entry int, error long")


def sums_of(blocks: DataFrame) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Members and their sums by (position, entry), from the blocks' own numbers: at most 16 x 64 rows."""
    items = blocks.select("position", "entry", "n", F.posexplode("sums").alias("k", "value"))
    total = items.groupBy("position", "entry", "k").agg(F.sum("value").alias("total"), F.sum("n").alias("n"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(total.collect(), key=lambda r: r.k):
        out.setdefault((r.position, r.entry), (r.n, []))[1].append(r.total)
    return out


def first_entries(vectors: DataFrame, width: int) -> Codebooks:
    """The parts of the vectors with the smallest different ids; one scan, and another only where ids repeat."""
    found: dict[object, list[int]] = {}
    left = vectors.where("vec_id IS NOT NULL")
    while len(found) < ENTRIES and (rows := left.orderBy("vec_id", "x").select("vec_id", "x").limit(ENTRIES).collect()):
        for r in rows:
            found.setdefault(r.vec_id, r.x)
        left = vectors.where(F.col("vec_id") > F.lit(rows[-1].vec_id))
    entries = np.array(list(found.values())[:ENTRIES], np.int64).reshape(-1, PARTS, width)
    return Codebooks(np.ascontiguousarray(entries.transpose(1, 0, 2)))


def compressed(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row of ``embeddings`` that has a whole vector.

    Rows whose vector is null or holds null or non-finite components are dropped; rows repeat as
    in the input.  Vectors shorter than the longest, and lengths that 16 doesn't divide, are filled up
    with zeros; components count up to +-2**18.  The 64 smallest different ids make the first codebooks; of
    several vectors of one id the least one does.  Rows without an id are coded too; if no row has one, there
    is no codebook: code, error and label_error are null and the digest is that of an empty text.  Ties go to
    the lower entry.  Other columns are not read; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).where(is_whole(F.col("vector")))
    size = rows.agg(F.max(F.size("vector")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, -(-(size.dim or 0) // PARTS))
    salts = -(-size.n // OWNER_MEMBERS) or 1
    # written once, so that the numbers given to rows are the same for every reader
    vectors = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", quantised(F.col("vector"), width * PARTS).alias("x")), "op13-vectors")
    books = first_entries(vectors, width)
    if not books.entries.size:
        return vectors.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"),
                              F.lit(None).cast("long").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))
    blocks = stored(placed(vectors, books, width, salts), "op13-blocks")
    for r in range(rounds):
        books = books.updated(sums_of(blocks))
        if r + 1 == rounds:
            break
        path = os.path.join(scratch_dir(spark), f"op13-moves-{uuid.uuid4().hex}")
        reassigned(blocks, books, width).write.partitionBy("moved").option("compression", "zstd").parquet(path)
        moves = spark.read.schema(BLOCK + ", moved boolean").parquet(path)
        arrived = stored(gathered_blocks(moves.where("moved").drop("moved"), salts, width), "op13-arrived")
        blocks = moves.where("NOT moved").drop("moved").unionByName(arrived)
    halves = [F.when((F.col("position") < 8) == first, F.expr("shiftleft(CAST(entry AS BIGINT), 8 * (7 - position % 8))")).otherwise(F.lit(0)) for first in (True, False)]
    parts = coded(blocks, books, width).select("uid", halves[0].alias("high"), halves[1].alias("low"), "error", F.lit(None).cast(vectors.schema["vec_id"].dataType).alias("vec_id"),
                                               F.lit(None).cast(vectors.schema["label"].dataType).alias("label"))
    nothing = F.lit(0).cast("long")
    ids = vectors.select("uid", nothing.alias("high"), nothing.alias("low"), nothing.alias("error"), "vec_id", "label")
    digits = [F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("high", "low")]
    found = stored(parts.union(ids).groupBy("uid").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("error").alias("error"), F.max("vec_id").alias("vec_id"), F.max("label").alias("label"))
                   .select("vec_id", "label", F.concat(*digits).alias("code"), "error"), "op13-codes")
    by_label = found.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return found.join(by_label, F.col("label").eqNullSafe(F.col("l")), "left").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
