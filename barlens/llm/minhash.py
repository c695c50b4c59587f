"""Near-duplicates by ProbMinHash of weighted word shingles.

A text's elements are its distinct five-word shingles (A-Z lower-cased), weighted by how
often they occur.  Each element is a Poisson process whose rate is its weight; every
arrival goes to one of 128 registers, in an order of its own, and a register keeps the
element that arrived first.  An element stops at the first arrival later than all
registers hold, which ends most after one or two.  Two texts agree in a register with
the probability Jaccard similarity of their weighted shingles.  Registers in bands of four
make buckets; links are verified on whole shingle sets.

No bucket is turned into rows of pairs.  Equal texts are one node.  First each node is
verified against the nearest first node of its buckets; the links join most groups.  Nodes of
buckets that still hold several components meet once more by shingle, but only by their rarest ones: shingles stand in one
order, those of few nodes first, and a text enters under no more of them than weigh a fifth of it.
A link shares four fifths of either text, so the first shingle in common lies among these of both
(``meetings``).  Nodes that crowd under the same few shingles meet once for all of them.  The nodes of a
meeting are compared in blocks of bounded size, common shingles of a whole block at once; a block gives one link for each two
components that it joins.  Sketches only choose the nearest first node, they leave no pair
out, so no link between components of a bucket is missed.  At a similarity of 0.8 a
pair shares no bucket with probability (1 - 0.8**4)**32, 5e-8, where registers are independent;
an element's order of registers is permuted for that, see ``registers``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm.arrays import U64, chunks, grams, mix, prefix_sums, seeds, slice_hash, word_bounds, word_hashes
from barlens.llm.frames import map_batches, stored, text_of
from barlens.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, BAND = 128, 4
#: Sketch bits beyond which a node isn't verified against the first one of its bucket but only in blocks; 12.8 are expected at 0.8.
FAR_BITS = 37
ARRIVAL, ORDER, BAND_SALT, BIT_SALT = seeds(REGISTERS, 101), seeds(2, 102), seeds(REGISTERS // BAND, 103), seeds(REGISTERS, 104)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) in the order of text and shingle; fewer than five words are one shingle."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    count = np.diff(first)
    gram = grams(words, SHINGLE)
    owner = np.repeat(np.arange(len(count)), count)[: len(gram)]
    inside = np.arange(len(gram)) + SHINGLE <= first[owner + 1] if len(gram) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    text = np.concatenate((owner[inside], short))
    element = np.concatenate((gram[inside], slice_hash(prefix_sums(words), first[short], first[short + 1])))
    order = np.lexsort((element, text))
    text, element = text[order], element[order]
    new = np.flatnonzero(np.concatenate(([True], (element[1:] != element[:-1]) | (text[1:] != text[:-1])))[: len(element)])
    return text[new], element[new], np.diff(np.concatenate((new, [len(element)])))


def _visited(j: int, spread: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The register that each element visits as its j-th; odd factors and shifted differences keep every register once."""
    low = U64(REGISTERS - 1)
    x = U64(j)
    for k in (0, 16, 32):
        x = (x * ((spread >> U64(k)) | U64(1)) + (key >> U64(k))) & low
        x = x ^ (x >> U64(3))
    return x


def registers(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """For each text the element that holds each register.

    An element's order is a keyed permutation, not one progression: two elements whose
    progressions have one step would win or lose neighbouring registers together.
    """
    m = REGISTERS
    time = np.full(texts * m, np.inf)
    holder = np.zeros(texts * m, U64)
    spread = mix(element ^ ORDER[0])
    key = mix(element ^ ORDER[1])
    at = np.zeros(len(element))
    for j in range(m):
        if not len(element):
            break
        uniform = (mix(element ^ ARRIVAL[j]) >> U64(11)).astype(np.float64) * 2.0 ** -53
        at = at - np.log1p(-uniform) / weight * (m / (m - j))  # arrivals at registers not visited yet are thinned
        slot = text * m + _visited(j, spread, key).astype(np.int64)
        better = at < time[slot]
        slot, when, who = slot[better], at[better], element[better]
        np.minimum.at(time, slot, when)
        won = when == time[slot]
        holder[slot[won]] = who[won]
        alive = at < time.reshape(texts, m).max(1)[text]
        text, element, weight, at, spread, key = (x[alive] for x in (text, element, weight, at, spread, key))
    return holder.reshape(texts, m)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, sha, keys (one per band, none without words) and the two halves of the sketch."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in chunks(batch.column(2)):
            text, element, weight = shingles(data, offsets)
            held = registers(text, element, weight, hi - lo)
            key = np.zeros((hi - lo, REGISTERS // BAND), U64) + BAND_SALT
            for k in range(BAND):
                key = mix(key ^ held[:, k::BAND])
            bits = np.packbits((mix(held ^ BIT_SALT) & U64(1)).astype(np.uint8), axis=1).view(np.int64)
            some = np.isin(np.arange(hi - lo), text)
            ends = np.concatenate(([0], np.cumsum(some * (REGISTERS // BAND)))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), keys, pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1]))],
                ["doc_id", "sha", "keys", "s1", "s2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("sha"), text_of().alias("text"))
    return map_batches(rows, run, "doc_id long, sha binary, keys array<long>, s1 long, s2 long")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, elements and weights (packed numbers) of the wanted documents."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, data, offsets in chunks(batch.column(1)):
            text, element, weight = shingles(data, offsets)
            cut = np.searchsorted(text, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([element[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                 pa.array([weight[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["node", "elements", "weights"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), text_of().alias("text")).join(wanted, "node", "left_semi")
    return map_batches(rows, run, "node long, elements binary, weights binary")


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i); elements are sorted."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    at = np.searchsorted(ratio, ratio, "left")  # elements of smaller ratio count with y, the others with x
    below_y = np.concatenate(([0], np.cumsum(y)))[at]
    above_x = x.sum() - np.concatenate(([0], np.cumsum(x)))[at]
    return float((x / (above_x + only_x + ratio * (below_y + only_y))).sum())


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose probability Jaccard similarity reaches ``similarity``."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for ea, wa, eb, wb in zip(*(batch.column(i) for i in (2, 3, 4, 5))):
            arrays = [np.frombuffer(v.as_buffer(), t) for v, t in ((ea, np.uint64), (wa, np.int32), (eb, np.uint64), (wb, np.int32))]
            keep.append(probability_jaccard(*arrays) >= similarity - 1e-12)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "ea", "wa", "eb", "wb"), run, "a long, b long")


#: Nodes of one side of a block, and different shingles counted at once.
BLOCK_NODES, BLOCK_SHINGLES = 256, 8192


def common_shingles(sets: list[np.ndarray], weights: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of what the elements that the sets ``a`` share with the sets ``b`` weigh in ``a`` and in ``b``."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, number, count = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, U64), return_inverse=True, return_counts=True)
    several = count[number] > 1
    owner, number, weight = owner[several], np.unique(number[several], return_inverse=True)[1], np.concatenate([*weights, np.zeros(0, np.int32)])[several]
    order = np.argsort(number, kind="stable")
    owner, number, weight = owner[order], number[order], weight[order]
    plain = bool((weight == 1).all())
    in_a = np.zeros((len(a), len(b)), np.float32)
    in_b = in_a if plain else np.zeros_like(in_a)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, BLOCK_SHINGLES):
        x, y = np.searchsorted(number, [lo, lo + BLOCK_SHINGLES])
        has = np.zeros((len(sets), BLOCK_SHINGLES), np.float32)
        has[owner[x:y], number[x:y] - lo] = 1
        if plain:
            in_a += has[a] @ has[b].T
        else:
            heavy = np.zeros_like(has)
            heavy[owner[x:y], number[x:y] - lo] = weight[x:y]
            in_a += heavy[a] @ has[b].T
            in_b += has[a] @ heavy[b].T
    return in_a, in_b


def block_links(group: pa.Table, similarity: float) -> pa.Table:
    """Links (a, b) of one block pair, as many as join its components."""
    side, node, component = (np.asarray(group.column(c)) for c in ("side", "node", "c"))
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if group.column("itself")[0].as_py():
        b = a
    open_pairs = component[a][:, None] != component[b][None, :]
    sets = [np.frombuffer(x.as_buffer(), U64) for x in group.column("elements")]
    weights = [np.frombuffer(x.as_buffer(), np.int32) for x in group.column("weights")]
    found: list[tuple[int, int]] = []
    if open_pairs.any():
        size, plain = np.array([len(s) for s in sets]), np.array([bool((w == 1).all()) for w in weights])
        common, common_b = common_shingles(sets, weights, a, b)
        unweighted = plain[a][:, None] & plain[b][None, :]  # there the similarity is the plain one
        near = open_pairs & unweighted & (common >= (similarity - 1e-12) * (size[a][:, None] + size[b][None, :] - common))
        # no similarity exceeds the common elements' share of either text; the slack is for rounding
        total = np.array([w.sum() for w in weights], float)
        likely = np.minimum(common / total[a][:, None], common_b / total[b][None, :]) >= similarity - 1e-3
        for i, j in np.argwhere(open_pairs & ~unweighted & likely):
            near[i, j] = probability_jaccard(sets[a[i]], weights[a[i]], sets[b[j]], weights[b[j]]) >= similarity - 1e-12
        root = {c: c for c in component.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for i, j in np.argwhere(near):
            x, y = top(int(component[a[i]])), top(int(component[b[j]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((int(node[a[i]]), int(node[b[j]])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


#: Members and bytes of shingles that one task compares at a time, in one or more meetings.
PACK_MEMBERS, PACK_BYTES = 2048, 16 << 20


def flat_shingles(sets: DataFrame) -> DataFrame:
    """node, c, element, weight and the text's total weight, one row per shingle."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(len(batch)):
            element, weight = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64), np.frombuffer(batch.column(3)[i].as_buffer(), np.int32)
            if len(element):
                same = [np.full(len(element), x, np.int64) for x in (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), weight.sum())]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (same[0], same[1], element, weight.astype(np.int64), same[2])], ["node", "c", "element", "weight", "total"])

    return map_batches(sets.select("node", "c", "elements", "weights"), run, "node long, c long, element long, weight long, total long")


def _crossing(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys under which nodes of different components stand, and how many."""
    return rows.groupBy(*keys).agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count(F.lit(1)).alias("n")).where("_lo < _hi").drop("_lo", "_hi")


def meetings(sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(lists of at most ``BLOCK_NODES`` nodes to compare, larger meetings as rows of meeting, node, n).

    ``sets`` has node, component c, elements and weights.  Two nodes of different components with a similarity of
    ``similarity`` or more stand together in one of them.  Shingles are in the order of (nodes that have them, hash); those
    of one component only can't join two and count as the rarest.  Before the first common shingle a text has only
    what the other lacks, at most 1 - ``similarity`` of its weight.  Nodes that crowd under several shingles
    would meet as often: shingles that share nodes are one meeting, unless apart they have fewer pairs of nodes.
    """
    flat = flat_shingles(sets)
    crossing = stored(_crossing(flat, "element").withColumnRenamed("n", "df"), "op4-crossing")
    mine = Window.partitionBy("node")
    lead = F.col("total") - F.sum("weight").over(mine) + F.coalesce(F.sum("weight").over(mine.orderBy("df", "element").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = flat.join(crossing, "element").withColumn("lead", lead).where(F.col("lead") <= F.col("total") * (1 - similarity + 1e-6)).select("node", "c", "element")
    prefix = stored(prefix, "op4-prefix")
    sizes = stored(_crossing(prefix, "element"), "op4-met")
    lists = prefix.join(sizes.where(F.col("n") <= BLOCK_NODES), "element").groupBy("element").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
    crowded = prefix.join(sizes.where(F.col("n") > BLOCK_NODES), "element").select(F.col("element").alias("meeting"), "node", "n")
    if crowded.isEmpty():
        return lists, crowded
    crowded = stored(crowded, "op4-crowded")
    first = crowded.groupBy("meeting", "n").agg(F.min("node").alias("first"))
    crowd = stored(components(crowded.join(first.drop("n"), "meeting").select(F.col("node").alias("a"), F.col("first").alias("b"))), "op4-crowds")
    apart = first.join(crowd, F.col("first") == F.col("node")).groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    together = crowd.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(apart, "component").where(F.col("n") * F.col("n") <= F.col("pairs")).select("component", "n")
    together = stored(together, "op4-together")
    as_one = crowd.join(together, "component").select(F.xxhash64(F.lit("crowd"), "component").alias("meeting"), "node", "n")
    alone = crowded.join(crowd.join(together, "component", "left_anti").select("node"), "node", "left_semi")
    return lists, as_one.union(alone.select("meeting", "node", "n"))


def links_of(sides: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that the blocks of ``sides`` (gid, node, side, itself) give; several small ones are one group of rows."""
    placed = sides.join(sets, "node")
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("elements")).alias("bytes")).first()
    packs = 1 + max(size.n // PACK_MEMBERS, (size.bytes or 0) // PACK_BYTES)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("gid")
        gid = np.asarray(group.column("gid"))
        edges = [0, *(np.flatnonzero(np.diff(gid)) + 1).tolist(), len(gid)]
        return pa.concat_tables([block_links(group.slice(a, b - a), similarity) for a, b in zip(edges, edges[1:])])

    packed = placed.withColumn("pack", F.pmod(F.xxhash64("gid"), F.lit(packs)))
    return packed.groupBy("pack").applyInArrow(run, "a long, b long").distinct()


def _bits_apart(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept for every row of ``docs``.

    class_id is the smallest doc_id that a document reaches by links of similarity
    ``similarity`` or more, itself included; kept marks that document.  Equal texts are of one
    class.  A text without words (null, empty, blank) is linked with equal texts only, null
    counting as empty.  Rows that share a doc_id are taken as one document.  A row without doc_id
    bears the class of its text's equals, or null, and isn't kept where it has one.  Other columns
    are not read; an empty table gives an empty result.
    """
    signed = stored(signatures(docs), "op4-signatures")
    nodes = stored(signed.where("doc_id IS NOT NULL").groupBy("sha").agg(
        F.min("doc_id").alias("node"), *(F.any_value(c).alias(c) for c in ("keys", "s1", "s2"))), "op4-nodes")
    bands = nodes.select("node", "s1", "s2", F.explode("keys").alias("key"))
    firsts = bands.groupBy("key").agg(F.min(F.struct("node", "s1", "s2")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    buckets = stored(bands.join(firsts, "key").select("key", "node", "s1", "s2", "first"), "op4-buckets")
    sets = stored(shingle_sets(docs, buckets.select("node").distinct()), "op4-sets")

    apart = _bits_apart(F.col("s1"), F.col("s2"), F.col("first.s1"), F.col("first.s2"))
    nearest = buckets.where(F.col("node") > F.col("first.node")).select("node", F.struct(apart.alias("bits"), F.col("first.node").alias("b")).alias("p")) \
        .where(F.col("p.bits") <= FAR_BITS).groupBy("node").agg(F.min("p").alias("p")).select(F.col("node").alias("a"), F.col("p.b").alias("b"))
    links = stored(verified(nearest, sets, similarity), "op4-links")
    joined = stored(components(links), "op4-joined")

    placed = buckets.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    open_keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    still = placed.join(open_keys, "key", "left_semi").select("node", "c").distinct()
    open_sets = stored(still.join(sets, "node"), "op4-open")
    lists, large = meetings(open_sets, similarity)
    # a gid that two lists share only makes one larger block
    listed = lists.select(F.xxhash64("nodes").alias("gid"), F.explode("nodes").alias("node"), F.lit(0).alias("side"), F.lit(True).alias("itself"))
    blocks = large.withColumns({"blocks": F.ceil(F.col("n") / BLOCK_NODES).cast("int")}).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a node stands on one side of every block pair that holds its block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = blocks.select("meeting", "node", "mine", other).select(
        F.xxhash64("meeting", F.least("mine", "other"), F.greatest("mine", "other")).alias("gid"), "node",
        (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") == F.col("other")).alias("itself"))
    sides = stored(listed.union(cut), "op4-sides")
    more = stored(links_of(sides, open_sets, similarity), "op4-more")
    classes = stored(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)) if more.take(1) else joined, "op4-classes")

    of_text = nodes.select("sha", "node").join(classes, "node", "left").select("sha", F.coalesce("component", "node").alias("class_id"))
    return signed.select("doc_id", "sha").join(of_text, "sha", "left").select(
        "doc_id", "class_id", F.when(F.col("class_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False))).alias("kept"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; rows without doc_id stay."""
    lost = near_groups(docs, similarity).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id_of_near_copy")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == lost["_id_of_near_copy"], "left_anti")
