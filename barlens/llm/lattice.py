"""Near-duplicate vectors by lattice hashing.

Random projections to eight dimensions are decoded to the nearest point of the E8 lattice,
in several tables; a vector is found under its own cell and looks also into the cells of
the neighbouring lattice points nearest to its projection.  Vectors that two tables of
their own decode alike share a home.  Cells lead from home to home, not from vector to
vector: homes that meet in a cell, and whose 128-bit sketches allow a link, are compared
block by block with the cosine in double precision.  Every vector has one home, so every
pair is compared once and counts need no list of pairs; a hot home is cut into blocks of
bounded size, and equal vectors are one with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.arrays import U64, mix, seeds
from barlens.llm.frames import map_batches, stored
from barlens.llm.graph import components

COSINE = 0.93
TABLES, PROBES, SCALE = 12, 10, 0.8
BLOCK_ROWS = 1024
#: Two directions at cosine 0.93 differ in 15.3 of 128 random signs, standard deviation 3.7; the bound is 7 deviations off.
FAR_BITS = 41


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        v = np.array([0.5 if signs >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


NEIGHBOURS = minimal_vectors()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer point of even coordinate sum: where the sum is odd, the worst rounded coordinate goes the other way."""
    point = np.round(y)
    error = y - point
    odd = np.flatnonzero(point.sum(1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest lattice point: E8 is D8 and D8 moved by one half."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - whole) ** 2).sum(1) <= ((y - half) ** 2).sum(1))[:, None], whole, half)


def cell_keys(points: np.ndarray, label: np.ndarray, table: int) -> np.ndarray:
    key = mix(label.astype(np.int64).view(U64) ^ seeds(TABLES, 71)[table])
    for k in range(8):
        key = mix(key ^ np.round(points[:, k] * 2).astype(np.int64).view(U64))
    return key


def projections(dim: int) -> list[np.ndarray]:
    rng = np.random.default_rng(29)
    return [rng.normal(size=(dim, 8)) * SCALE for _ in range(TABLES)]


def hashed(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home, keys, sketch) of unit vectors; the first column of a table's keys is the own cell, the rest are probes."""
    n, dim = x.shape
    keys = np.empty((n, TABLES, 1 + PROBES), U64)
    for t, p in enumerate(projections(dim)):
        y = x @ p
        point = nearest_e8(y)
        keys[:, t, 0] = cell_keys(point, label, t)
        near = np.argpartition(-((y - point) @ NEIGHBOURS.T), PROBES, axis=1)[:, :PROBES]
        for j in range(PROBES):
            keys[:, t, 1 + j] = cell_keys(point + NEIGHBOURS[near[:, j]], label, t)
    signs = x @ np.random.default_rng(31).normal(size=(dim, 128)) > 0
    return mix(keys[:, 0, 0] ^ mix(keys[:, 1, 0])), keys, np.packbits(signs, axis=1).view(np.int64)


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows have a direction, and those rows scaled to length one."""
    out, good = [], np.zeros(len(column), bool)
    for i, v in enumerate(column):
        if not v.is_valid or v.values.null_count or not len(v.values):
            continue
        x = np.asarray(v.values, float)
        if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
            x = x / top
            good[i] = True
            out.append(x / np.sqrt((x * x).sum()))
    return good, out


def _units(vectors: DataFrame) -> DataFrame:
    """One row for each distinct (label, vector): its key, smallest id and multiplicity."""
    return vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL") \
        .groupBy("label", "vector").agg(F.min("vec_id").alias("unit"), F.countDistinct("vec_id").alias("copies")) \
        .withColumn("uid", F.xxhash64("label", "vector"))


def block_links(group: pa.Table, threshold: float) -> pa.Table:
    """(uid, unit, links, root) of one pair of blocks: how many vectors each links to, and the smallest unit its links join it to here."""
    side, itself = np.asarray(group.column("side")), group.column("itself")[0].as_py()
    unit, copies = np.asarray(group.column("unit")), np.asarray(group.column("copies")).astype(float)
    x = np.stack([np.asarray(v.values) for v in group.column("x")])
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if itself:
        b = a
    near = x[a] @ x[b].T >= threshold
    near &= unit[a][:, None] != unit[b][None, :]  # not with itself, nor with other rows of its id
    links = np.zeros(len(unit))
    links[a] = near @ copies[b]
    if not itself:
        links[b] = near.T @ copies[a]
    root = unit.copy()
    touched = np.flatnonzero(links > 0)
    while True:  # smallest unit within reach
        old = root.copy()
        np.minimum(root[a], np.where(near, root[b][None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max), out=(low := root[a].copy()))
        root[a] = low
        np.minimum(root[b], np.where(near, root[a][:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max), out=(low := root[b].copy()))
        root[b] = low
        if (root == old).all():
            break
    return pa.table({"uid": np.asarray(group.column("uid"))[touched], "unit": unit[touched], "links": links[touched].astype(np.int64), "root": root[touched]})


def near_vectors(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Vectors of one label link at a cosine of ``threshold`` or more.  A null label, and a vector
    that is null, empty, zero or holds null or non-finite numbers, links with nothing; vectors of
    different lengths don't link.  Rows that share a vec_id are one vector: their links add up
    over different numbers, and it isn't linked to itself.  A row without vec_id has no links, a null
    component and is not kept.  Other columns are not read; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))

    def prepare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        good, out = unit_rows(batch.column(1))
        unit, label, copies, uid = (np.asarray(batch.column(i))[good] for i in (2, 0, 3, 4))
        lengths = np.array([len(v) for v in out], int)
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            x = np.array([out[i] for i in at])
            home, keys, sketch = hashed(x, label[at])
            home = mix(home ^ U64(dim))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[at]), pa.array(unit[at]), pa.array(copies[at]), pa.array(list(x), pa.list_(pa.float64())), pa.array(home.view(np.int64)), pa.array(np.ascontiguousarray(sketch[:, 0])),
                 pa.array(np.ascontiguousarray(sketch[:, 1])), pa.array(list(keys[:, :, 0].view(np.int64)), pa.list_(pa.int64())),
                 pa.array(list(keys[:, :, 1:].reshape(len(at), -1).view(np.int64)), pa.list_(pa.int64()))],
                ["uid", "unit", "copies", "x", "home", "s1", "s2", "own", "probes"])

    units = stored(map_batches(_units(rows), prepare, "uid long, unit long, copies long, x array<double>, home long, s1 long, s2 long, own array<long>, probes array<long>"), "op7-units")
    # homes: a member's sketch as centre, how far the others are from it, how many blocks they fill
    centre = units.groupBy("home").agg(F.min(F.struct("s1", "s2")).alias("c"), F.count(F.lit(1)).alias("n"))
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("c.s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("c.s2")))
    homes = stored(units.select("home", "s1", "s2").join(centre, "home").groupBy("home").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.max(apart).alias("r"))
                   .select("home", "c", "r", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "op7-homes")
    own = units.select("home", F.explode("own").alias("key")).distinct().join(homes, "home")
    looks = units.select("home", F.explode(F.concat("own", "probes")).alias("key")).distinct().join(homes, "home") \
        .select("key", F.col("home").alias("home2"), F.col("c").alias("c2"), F.col("r").alias("r2"), F.col("blocks").alias("blocks2"))
    allowed = F.bit_count(F.col("c.s1").bitwiseXOR(F.col("c2.s1"))) + F.bit_count(F.col("c.s2").bitwiseXOR(F.col("c2.s2"))) <= F.col("r") + F.col("r2") + FAR_BITS
    meet = own.join(looks, (own["key"] == looks["key"]) & (F.col("home") != F.col("home2")) & allowed)
    swap = F.col("home") > F.col("home2")
    across = meet.select(F.when(swap, F.col("home2")).otherwise(F.col("home")).alias("h1"), F.when(swap, F.col("blocks2")).otherwise(F.col("blocks")).alias("n1"),
                         F.when(swap, F.col("home")).otherwise(F.col("home2")).alias("h2"), F.when(swap, F.col("blocks")).otherwise(F.col("blocks2")).alias("n2")).distinct()
    pairs = across.union(homes.select("home", "blocks", "home", "blocks"))
    blocks = pairs.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("b1"), "n2").select("h1", "h2", "b1", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("b2")) \
        .where("h1 <> h2 OR b1 <= b2")
    itself = ((F.col("h1") == F.col("h2")) & (F.col("b1") == F.col("b2"))).alias("itself")
    blocks = stored(blocks.select("h1", "b1", "h2", "b2", itself, F.struct("h1", "b1", "h2", "b2").alias("pair")), "op7-blocks")
    placed = units.join(homes.select("home", "blocks"), "home").select(
        "uid", "unit", "copies", "x", F.col("home").alias("h"), F.pmod(F.xxhash64("uid", F.lit(3)), F.col("blocks")).cast("int").alias("b"))
    sides = blocks.select(F.col("h1").alias("h"), F.col("b1").alias("b"), "pair", "itself", F.lit(0).alias("side")) \
        .union(blocks.where("NOT itself").select(F.col("h2").alias("h"), F.col("b2").alias("b"), "pair", "itself", F.lit(1).alias("side")))
    found = sides.join(placed, ["h", "b"]).select("pair", "itself", "side", "uid", "unit", "copies", "x").groupBy("pair").applyInArrow(
        lambda g: block_links(g, threshold), "uid long, unit long, links long, root long")
    found = stored(found, "op7-found")
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    joined = stored(components(found.select(F.col("unit").alias("a"), F.col("root").alias("b"))), "op7-joined")
    # back to ids: copies of a unit link with each other too
    unit_of = units.select("uid", "unit", "copies").join(counts, "uid", "left").join(joined, F.col("unit") == F.col("node"), "left") \
        .select("uid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "unit").alias("component"))
    ids = rows.where("vec_id IS NOT NULL").select("vec_id", F.xxhash64("label", "vector").alias("uid")).distinct().join(unit_of, "uid", "left") \
        .groupBy("vec_id").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"), F.min("component").alias("c"))
    return rows.select("vec_id").join(ids, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("c", "vec_id"), F.lit(False)).alias("kept"))
