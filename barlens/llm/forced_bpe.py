"""Byte-level BPE encoding and decoding by forced boundaries.

Two bytes that stand side by side in no token of the vocabulary can never end up in one
token, whatever the merges: between them is a certain cut.  The cuts of a whole slice of
texts come from one look-up of all its byte pairs in a 256 x 256 table; together with the
borders of the pattern's pieces, which depend on the classes of neighbouring characters
only, they part the slice into short fragments.  Merges never reach over a cut, so every
different fragment is encoded once, by itself, and the ids of a text are those of its
fragments in order.

Memory is bounded by the slice, not by the table or the text: long texts are cut between
two words, and the store of known fragments is emptied once it is full, which changes no result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.frames import map_batches

VOCABULARY = "byte_bpe_50k.json"
SLICE_CHARS = 1 << 19
STORE_FRAGMENTS = 400_000

OTHER, LETTER, NUMBER, SPACE = range(4)
# fixed values: white space of the pattern
SPACES = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# fixed values: first and last code points of the letters and numbers of Unicode 16, which older versions leave unassigned
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
              (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
              (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# fixed values: endings that the pattern parts from a word, by their letters after the apostrophe
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

#: A blank between two letters or digits starts a piece, whatever stands around it.
SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            table[a: b + 1] = kind
    table[list(SPACES)] = SPACE
    return table


def piece_starts(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Marks the characters at which a piece of the pattern starts; ``first`` marks the starts of texts.

    Pieces are runs of one class with the blank before them; of white space the last
    character stands apart; an apostrophe that starts a piece takes s, t, m, d, re, ve, ll with it.
    """
    n = len(codes)
    kind = classes[codes]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:] & ~first[1:] & (kind[:-1] == SPACE)) + 1  # a run that white space leads to
    start[after - 1] = True
    start[after[codes[after - 1] == 0x20]] = False
    quote = np.flatnonzero((codes == 0x27) & start)
    padded, ends = np.append(codes, (0, 0, 0)), np.append(first, (True, True, True))
    quote = quote[~ends[quote + 1]]
    one, two = padded[quote + 1], np.where(ends[quote + 2], 0, padded[quote + 2])
    length = np.where(np.isin(one, [ord(c) for c in SHORT_ENDINGS]), 2, 0)
    for a, b in LONG_ENDINGS:
        length[(one == ord(a)) & (two == ord(b))] = 3
    quote, length = quote[length > 0], length[length > 0]
    start[quote + 1] = False
    over = quote + length
    start[over[over < n]] = True
    return start


def byte_of_character() -> dict[str, int]:
    """Vocabulary files write bytes as characters: visible ones as themselves, the rest from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in seen}
    rest = (b for b in range(256) if b not in set(seen))
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


def gathered(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``flat[offsets[r]:offsets[r + 1]]`` one after the other, and where each starts."""
    lengths = offsets[rows + 1] - offsets[rows]
    at = np.concatenate(([0], np.cumsum(lengths)))
    return flat[np.repeat(offsets[rows] - at[:-1], lengths) + np.arange(at[-1])], at


class ForcedCuts:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split != split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or spec["normalizer"] \
                or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take more than their own text")
        to_byte = byte_of_character()
        tokens = {i: bytes(to_byte[c] for c in t) for t, i in model["vocab"].items()}
        number = {t: i for i, t in tokens.items()}
        self.single = [number[bytes([b])] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(to_byte[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[number[a], number[b]] = rank, number[a + b]
        self.inside = np.zeros((256, 256), bool)  # byte pairs that some token holds
        for t in tokens.values():
            self.inside[list(t[:-1]), list(t[1:])] = True
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.find_special = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) + ")") if self.special else None
        tokens |= {i: t for t, i in self.special.items()}
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(max(tokens) + 1)), np.uint8)
        self.token_offsets = np.concatenate(([0], np.cumsum([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)])))
        self.classes = character_classes()
        self.known: dict[bytes, int] = {}
        self.ids, self.offsets = array("I"), array("q", [0])

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the leftmost pair of lowest rank merges first."""
        ids = [self.single[b] for b in fragment]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [(*found, i) for i in range(n - 1) if (found := self.merges.get((ids[i], ids[i + 1])))]
        due = [(rank, i, made) for rank, made, i in due]
        heapq.heapify(due)
        while due:
            rank, i, made = heapq.heappop(due)
            j = after[i]
            if ids[i] < 0 or j >= n or self.merges.get((ids[i], ids[j])) != (rank, made):
                continue  # one of the two was merged otherwise
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (found := self.merges.get((ids[left], ids[right]))):
                    heapq.heappush(due, (found[0], left, found[1]))
        return [x for x in ids if x >= 0]

    def fragments(self, pieces: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Fragments of the pieces, in order, and the index of each piece's first fragment (one more than pieces)."""
        whole = "".join(pieces)
        data = whole.encode()
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in pieces])
        begins = ends - [len(p) for p in pieces]
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = np.concatenate(([0], np.cumsum(width)))
        first = np.zeros(len(codes) + 1, bool)
        first[begins] = True
        cut = np.zeros(len(data) + 1, bool)
        if len(codes):
            cut[at[np.flatnonzero(piece_starts(codes, first[:-1], self.classes))]] = True
            raw = np.frombuffer(data, np.uint8)
            cut[1:-1] |= ~self.inside[raw[:-1], raw[1:]]
        for p, a, b in zip(pieces, at[begins].tolist(), at[ends].tolist()):
            if b > a and p.encode() in self.special:
                cut[a + 1: b] = False
        starts = np.flatnonzero(cut[:-1])
        borders = [*starts.tolist(), len(data)]
        return [data[a:b] for a, b in zip(borders, borders[1:])], np.searchsorted(starts, np.append(at[begins], len(data)))

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece; a piece is a text, a part of one that ends before a safe blank, or a special token."""
        if len(self.known) > STORE_FRAGMENTS:
            self.known.clear()
            self.ids, self.offsets = array("I"), array("q", [0])
        fragments, first = self.fragments(pieces)
        known = self.known
        for f in set(fragments).difference(known):
            known[f] = len(known)
            self.ids.extend([self.special[f]] if f in self.special else self.merged(f))
            self.offsets.append(len(self.ids))
        rows = np.fromiter((known[f] for f in fragments), np.int64, len(fragments))
        ids, at = gathered(np.array(self.ids, np.uint32), np.array(self.offsets, np.int64), rows)
        borders = at[first].tolist()
        return [ids[a:b] for a, b in zip(borders, borders[1:])]

    def decode(self, ids: np.ndarray) -> str:
        return gathered(self.token_bytes, self.token_offsets, ids.astype(np.int64))[0].tobytes().decode("utf-8", "replace")

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut at special tokens and, where it is long, between words."""
        for i, part in enumerate(self.find_special.split(text) if self.find_special else [text]):
            if i % 2:
                yield part
                continue
            begin = 0
            while len(part) - begin > SLICE_CHARS and (safe := SAFE.search(part, begin + SLICE_CHARS)):
                yield part[begin: safe.start()]
                begin = safe.start()
            yield part[begin:]

    def slices(self, texts: Iterator[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids of its next piece), encoded many pieces at a time."""
        owner, held, size = [], [], 0
        for n, text in enumerate(texts):
            for piece in self.pieces(text):
                owner.append(n)
                held.append(piece)
                size += len(piece)
                if size >= SLICE_CHARS:
                    yield from zip(owner, self.encode(held))
                    owner, held, size = [], [], 0
        if held:
            yield from zip(owner, self.encode(held))


_LOADED: dict[str, ForcedCuts] = {}


def coder_of(path: str) -> ForcedCuts:
    """One per worker process; the vocabulary file is on every machine, as its library is."""
    if path not in _LOADED:
        _LOADED[path] = ForcedCuts(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``; with ``keep_ids`` also ids and decoded text.

    Equal to the tokenizers library's ``encode(text, add_special_tokens=False)`` and
    ``decode(ids, skip_special_tokens=False)``: special tokens written out in a text are
    special tokens.  A null text counts as empty, and an empty one has no ids.  Rows repeat as in
    the input, null ids of documents stay null, other columns are not read, an empty table gives
    an empty result.  A very long text is encoded part by part.
    """
    named = path or VOCABULARY  # resolved on the executor, where its library may lie elsewhere

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        coder = coder_of(named if "/" in named else public_tokenizers.path(named))
        n = len(batch)
        count = [0] * n
        of_ids, of_text = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
        kept: list[list[np.ndarray]] = [[] for _ in range(n if keep_ids else 0)]
        for i, ids in coder.slices(x.as_py() or "" for x in batch.column(1)):
            count[i] += len(ids)
            of_ids[i].update(ids.astype("<u4").tobytes())
            of_text[i].update(coder.decode(ids).encode())
            if keep_ids:
                kept[i].append(ids)
        columns = [batch.column(0), pa.array(count, pa.int64()), pa.array([h.hexdigest() for h in of_ids], pa.string()), pa.array([h.hexdigest() for h in of_text], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            columns += [pa.array([np.concatenate(x).astype(np.int32) for x in kept], pa.list_(pa.int32())), pa.array(["".join(map(coder.decode, x)) for x in kept], pa.string())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run,
                       schema + (", ids array<int>, decoded string" if keep_ids else ""))
