"""Byte-level BPE encoding and decoding by merge replay over many words at once.

A task keeps the distinct words of the texts it reads.  The words it has not met are
laid out in one line of symbols; an index from merge rank to the positions of the pairs
that merge to it replays the merges in rank order: the lowest rank in the index is taken,
applied at all its positions in all words, and only the two pairs beside each new symbol
are put back.  A word so costs its merges, however often it occurs, and a text is the
concatenation of its words' ids.  The line holds the new words of about
16 MB of text, so memory doesn't grow with the table; found words stay in a store that is
emptied once it holds more than ``STORE_WORDS``, which changes no result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.frames import map_batches

STORE_WORDS = 250_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Replay:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.find = regex.compile(pattern).findall
        pairs = {}  # every way to make a token of two
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.number: dict[str, int] = {}
        self.known: list[bytes] = []

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that the symbols a and b make, or -1."""
        if not len(self.pair_keys):
            return np.full(len(a), -1)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (little-endian 32-bit integers), by rank-ordered merges over all words together."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths + 1) - 1  # a symbol of -1 ends each word, so no pair crosses it
        symbol = np.full(int(ends[-1]) + 1, -1, np.int64)
        inner = np.ones(len(symbol), bool)
        inner[ends] = False
        symbol[inner] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        made = np.full(n, -1, np.int64)  # rank of the pair that starts here
        made[:-1] = self.rank(symbol[:-1], symbol[1:])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []  # where a merge made a pair of lower rank: those words are done again one by one

        def put(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            edges = [0, *cuts.tolist(), len(ranks)]
            for r, lo, hi in zip(ranks[edges[:-1]].tolist(), edges[:-1], edges[1:]):
                if r in index:
                    index[r].append(places[lo:hi])
                else:
                    index[r] = [places[lo:hi]]
                    heapq.heappush(heap, r)

        start = np.flatnonzero(made >= 0)
        if len(start):
            put(made[start], start)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            i = i[made[i] == r]  # others were merged away, or got another neighbour
            if not len(i):
                continue
            j = after[i]
            linked = np.concatenate(([False], j[:-1] == i[1:]))
            if linked.any():  # pairs that overlap: from the left, every second one
                at = np.arange(len(i))
                keep = (at - np.maximum.accumulate(np.where(linked, 0, at))) % 2 == 0
                i, j = i[keep], j[keep]
            k = after[j]
            close = made[k] == r  # the next pair merges too: between the two merges another may have been due
            if close.any():
                due = self.rank(np.full(int(close.sum()), r), symbol[k[close]])
                odd.append(i[close][(due >= 0) & (due <= r)])
            symbol[i], symbol[j], made[j] = r, -2, -1
            after[i], before[k] = k, i
            right = self.rank(symbol[i], symbol[k])
            h = before[i]
            left = np.where(h >= 0, self.rank(symbol[h], symbol[i]), -1)
            made[i] = right
            made[h[h >= 0]] = left[h >= 0]
            ranks, places = np.concatenate((right, left)), np.concatenate((i, h))
            some = ranks >= 0
            ranks, places = ranks[some], places[some]
            if len(ranks):
                odd.append(places[ranks <= r])
                put(ranks, places)
        left_over = np.flatnonzero(symbol >= 0)
        count = np.bincount(np.searchsorted(ends, left_over), minlength=len(words))
        edges = np.concatenate(([0], np.cumsum(count))) * 4
        ids, edges = symbol[left_over].astype("<u4").tobytes(), edges.tolist()
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]
        again = np.concatenate(odd) if odd else np.zeros(0, np.int64)
        for w in np.unique(np.searchsorted(ends, again)).tolist():
            out[w] = np.array(self.one_by_one(words[w]), "<u4").tobytes()
        return out

    def one_by_one(self, word: bytes) -> list[int]:
        """The leftmost pair of lowest rank first; for vocabularies whose ranks are out of order."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        while len(ids) > 1:
            ranks = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
            if ranks.max() < 0:
                break
            i = int(np.where(ranks >= 0, ranks, np.iinfo(np.int64).max).argmin())
            ids[i: i + 2] = [int(ranks[i])]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.known) > STORE_WORDS:
            self.number.clear()
            self.known.clear()
        number, known = self.number, self.known
        numbers = []
        for t in texts:
            words = self.find(t)
            try:
                numbers.append(array("I", [number[w] for w in words]))
            except KeyError:
                numbers.append(array("I", [number.setdefault(w, len(number)) for w in words]))
        new = list(itertools.islice(number, len(known), None)) if len(number) > len(known) else []
        whole = [self.ranks.get(w.encode()) for w in new]  # a word that is a token needs no merges
        merged = iter(self.replay([w.encode() for w, r in zip(new, whole) if r is None]))
        known += [next(merged) if r is None else r.to_bytes(4, "little") for r in whole]
        return [b"".join([known[x] for x in xs]) for xs in numbers]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[x] for x in array("I", ids)])


_LOADED: dict[tuple[str, str], Replay] = {}


def replay_of(path: str, pattern: str) -> Replay:
    """One per worker process; the vocabulary file is on every machine, as its library is."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = Replay(read_ranks(path), pattern)
    return _LOADED[key]


def texts_in_slices(column: pa.Array, limit: int = 1 << 24) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about ``limit`` characters."""
    part, size = [], 0
    for x in column:
        t = x.as_py() or ""
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``; with ``keep_ids`` also ids and decoded text.

    Equal to tiktoken's ``encode_ordinary``.  A null text counts as empty and has no ids;
    rows repeat as they repeat in the input, null ids of documents stay null, other columns
    are not read.  An empty table gives an empty result.
    """
    import public_tokenizers

    # the file's path is resolved on the executor, where its library may lie elsewhere
    named = path or VOCABULARY
    pattern = pattern or public_tokenizers.PATTERN

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = replay_of(named if "/" in named else public_tokenizers.path(named), pattern)
        row = 0
        for texts in texts_in_slices(batch.column(1)):
            ids = coder.encode(texts)
            decoded = [coder.decode(x) for x in ids]
            columns = [
                batch.column(0).slice(row, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                            pa.array([x.decode("utf-8", "replace") for x in decoded], pa.string())]
                names += ["ids", "decoded"]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run,
                       schema + (", ids array<int>, decoded string" if keep_ids else ""))
