"""Where a window of fixed length that recurs in several documents may be.

Every window has an anchor, its smallest gram.  Equal windows have equal anchors at equal
places, so a window recurs only if its anchor's gram does.  Grams at anchors are a small
part of all positions; those that only one text has are dropped first.  Documents whose
whole text a smaller document has need no search: every window of theirs recurs.  Around each
remaining anchor the snippet that holds its windows is routed by the gram: all equal
windows of the corpus meet in one route.  A gram with very many occurrences is routed
window by window instead, so that a route never has more than a bounded number of
different snippets; equal snippets meet map-side with their smallest and largest document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.arrays import BYTE_CODES, U64, anchors, chunks, grams, mix, word_bounds, word_hashes
from barlens.llm.frames import map_batches, release, stored, text_of

#: A gram in more places than this is routed window by window.
HOT = 20_000
#: Snippets of one Arrow batch.
SLICE = 50_000
#: Windows of a run that takes the whole text.
ALL = 1 << 30
#: Distinct snippets that a task looks at together, about, and how many such shares it has.
SHARE, SHARES = 10_000, 4


@dataclass(frozen=True)
class Units:
    """What a window is made of: bytes or words, how many, and the length of its grams."""

    words: bool
    window: int
    gram: int

    def anchored(self, data: np.ndarray, offsets: np.ndarray):
        """(starts of windows, their anchors, hash of each gram, first unit of each text, bounds of units in bytes)."""
        if self.words:
            begin, end, first = word_bounds(data, offsets)
            codes = word_hashes(data, begin, end)
        else:
            begin = end = None
            first, codes = offsets, BYTE_CODES[data]
        gram = grams(codes, self.gram)
        start, anchor = anchors(gram, first, self.window, self.gram)
        return start, anchor, gram, first, begin, end


def keyed(docs: DataFrame) -> DataFrame:
    """doc, fp, text: a document is its id and its text's fingerprint; rows without id are not here."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text_of()).alias("fp"), text_of().alias("text"))


def _distinct_anchors(units: Units, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of the anchors, each once."""
    _, anchor, gram, first, _, _ = units.anchored(data, offsets)
    place = anchor[np.concatenate(([True], anchor[1:] != anchor[:-1]))[: len(anchor)]]
    text = np.searchsorted(first, place, "right") - 1
    hashes = gram[place]
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])))[: len(hashes)]
    return text[new], hashes[new]


def recurring_grams(docs: DataFrame, units: Units) -> DataFrame:
    """gram and hot of anchors that at least two different texts have."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prints = np.asarray(batch.column(0))
        for lo, hi, data, offsets in chunks(batch.column(1)):
            text, hashes = _distinct_anchors(units, data, offsets)
            doc = prints[lo:hi][text]
            order = np.argsort(hashes, kind="stable")
            hashes, doc = hashes[order], doc[order]
            start = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)])
            if len(start):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[start].view(np.int64)), pa.array(np.minimum.reduceat(doc, start)), pa.array(np.maximum.reduceat(doc, start)),
                     pa.array(np.diff(np.concatenate((start, [len(hashes)]))).astype(np.int32))], ["gram", "lo", "hi", "n"])

    return map_batches(docs.select("fp", "text"), run, "gram long, lo long, hi long, n int").groupBy("gram") \
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi").select("gram", (F.col("n") > HOT).alias("hot"))


def gram_places(docs: DataFrame, units: Units) -> DataFrame:
    """gram, doc, fp: each document's distinct anchor grams."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, prints = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for lo, hi, data, offsets in chunks(batch.column(2)):
            text, hashes = _distinct_anchors(units, data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[lo:hi][text]), pa.array(prints[lo:hi][text])], ["gram", "doc", "fp"])

    return map_batches(docs, run, "gram long, doc long, fp long")


def _in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One hash of a gram and the text it is in; two that meet cost a snippet that shares nothing."""
    return mix(hashes + (text.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def _among(mine: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which of ``mine`` are among the grams that the texts' lists hold."""
    sizes = np.diff(np.asarray(lists.offsets))
    known = np.sort(_in_text(np.asarray(lists.flatten()).view(U64), np.repeat(np.arange(len(sizes)), sizes)))
    if not len(known):
        return np.zeros(len(mine), bool)
    return known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine


SNIPPETS = "route long, doc long, fp long, start int, anchor int, snippet binary"


def snippets(docs: DataFrame, hits: DataFrame, units: Units) -> DataFrame:
    """For each recurring anchor: its route, the first unit and the bytes of the snippet that holds the anchor's windows, and the anchor's place in it."""
    window = units.window

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, prints = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for lo, hi, data, offsets in chunks(batch.column(2)):
            start, anchor, gram, first, begin, end = units.anchored(data, offsets)
            if not len(start):
                continue
            new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
            head, tail, place = start[new], start[np.concatenate((new[1:], [len(start)])) - 1], anchor[new]
            text = np.searchsorted(first, head, "right") - 1
            mine = _in_text(gram[place], text)
            warm = _among(mine, batch.column(3).slice(lo, hi - lo)).astype(np.int8)
            warm *= 1 + _among(mine, batch.column(4).slice(lo, hi - lo)).astype(np.int8)
            one = np.flatnonzero(warm == 1)
            each = np.flatnonzero(warm == 2)
            many = tail[each] - head[each] + 1  # hot: a snippet for each window
            from_ = np.concatenate((head[one], np.repeat(head[each], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))))
            to = np.concatenate((tail[one] + window, from_[len(one):] + window))
            which = np.concatenate((one, np.repeat(each, many)))
            route = gram[place[which]]
            if begin is not None:
                byte_from, byte_to = begin[from_], end[to - 1]
            else:
                byte_from, byte_to = from_, to
            raw, hot_from = data.tobytes(), len(one)
            for a in range(0, len(which), SLICE):  # a text that repeats itself has a snippet at nearly every unit
                b = min(a + SLICE, len(which))
                cuts = [raw[x:y] for x, y in zip(byte_from[a:b].tolist(), byte_to[a:b].tolist())]
                for i in range(max(hot_from, a), b):  # routed by what the window is
                    route[i] = xxhash.xxh64_intdigest(b" ".join(cuts[i - a].split()) if units.words else cuts[i - a])
                doc = text[which[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route[a:b].view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array(prints[lo:hi][doc]),
                     pa.array((from_[a:b] - first[doc]).astype(np.int32)), pa.array((place[which[a:b]] - from_[a:b]).astype(np.int32)), pa.array(cuts, pa.binary())],
                    ["route", "doc", "fp", "start", "anchor", "snippet"])

    with_hits = docs.join(hits, ["doc", "fp"]).select("doc", "fp", "text", "known", "hot")
    return map_batches(with_hits, run, SNIPPETS)


def in_shares(find: Callable, share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``find`` over whole routes, about ``share`` snippets at a time; rows arrive in the order of routes."""
    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        snippet, first, count, owner = find(rows)
        if len(snippet):
            yield pa.RecordBatch.from_arrays(
                [rows.column("route").combine_chunks().take(pa.array(snippet)), rows.column("print").combine_chunks().take(pa.array(snippet)),
                 pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(owner.astype(np.int64))], ["route", "print", "first", "count", "owner"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in it:
            if not batch.num_rows:
                continue
            if size >= share:
                route = np.asarray(batch.column(0))
                last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                end = int(np.argmax(route != last)) if (route != last).any() else len(route)
                held.append(batch.slice(0, end))
                if end == len(route):
                    continue
                yield from flush([b for b in held if b.num_rows])
                held, size, batch = [], 0, batch.slice(end)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from flush(held)

    return run


def owned_runs(owner: np.ndarray, snippet: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring windows of one snippet with one owner as (snippet, first window, number, owner); input in order."""
    if not len(owner):
        return snippet, at, at, owner
    new = np.flatnonzero(np.concatenate(([True], (snippet[1:] != snippet[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]))))
    return snippet[new], at[new], np.diff(np.concatenate((new, [len(owner)]))), owner[new]


def removed_windows(docs: DataFrame, units: Units, find: Callable, label: str, by_range: bool) -> DataFrame:
    """doc, fp, starts, counts: runs of windows of a document whose content also starts in a document of smaller id.

    A copy of a smaller document's text has one run without end.

    ``find`` gets the snippets of whole routes (route, print, snippet, anchor, lo, hi: smallest and
    largest document that has the snippet) and returns, for windows that several documents have,
    (snippet's row, first window, number of windows, smallest document).
    """
    spark = docs.sparkSession
    known = stored(recurring_grams(docs, units), f"{label}-grams")
    # dealt by text first: aggregated where they are found, nearly every row would be a list of its own
    hits = gram_places(docs, units).join(known, "gram").repartition("doc", "fp").groupBy("doc", "fp").agg(
        F.collect_list("gram").alias("known"), F.collect_list(F.when(F.col("hot"), F.col("gram"))).alias("hot"))
    hits = stored(hits, f"{label}-hits")
    release(known)
    cut = stored(snippets(docs, hits, units), f"{label}-snippets")
    places = cut.withColumn("print", F.xxhash64("snippet", "anchor"))
    distinct = places.groupBy("route", "snippet", "anchor").agg(F.first("print").alias("print"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    total = hits.agg(F.sum(F.size("known")).alias("n")).first()["n"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (SHARES * SHARE) + 1)
    dealt = distinct.withColumn("lead", F.substring(F.col("snippet"), F.col("anchor") + 1, F.lit(units.gram)) if by_range else F.col("route"))
    if by_range:  # splitters sampled from the suffixes' leading bytes; equal leads are never parted
        dealt = dealt.repartitionByRange(tasks, "lead").sortWithinPartitions("lead", "route")
    else:
        dealt = dealt.repartition(tasks, "route").sortWithinPartitions("route")
    owned = dealt.select("route", "print", "snippet", "anchor", "lo", "hi").mapInArrow(in_shares(find, SHARE), "route long, print long, first int, count int, owner long")
    owned = stored(owned, f"{label}-owned")
    found = places.select("route", "print", "doc", "fp", "start").join(owned, ["route", "print"]).where("owner < doc") \
        .select("doc", "fp", (F.col("start") + F.col("first")).alias("start"), "count")
    same = docs.select("doc", "fp", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    copied = same.groupBy("sha").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = same.join(copied, "sha").where("doc > first").select("doc", "fp", F.lit(0).alias("start"), F.lit(ALL).alias("count"))
    gone = stored(found.union(copies).groupBy("doc", "fp").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts")), f"{label}-gone")
    release(hits, cut, owned)
    return gone
