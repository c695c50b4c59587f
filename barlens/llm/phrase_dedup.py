"""Substring dedup by repeated-phrase automata.

Windows of 13 words that more than one document has are confirmed on the words themselves,
compiled into Aho-Corasick automata, one per share of routes, over an alphabet in which
every word is a pair of symbols, and every document's snippets stream through the automaton of
their route, which locates each occurrence.  An automaton is as large as a share of
snippets, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.arrays import cover
from barlens.llm.frames import map_batches, text_of
from barlens.llm.recurring import Units, keyed, owned_runs, removed_windows

WINDOW, GRAM = 13, 5
WORDS = Units(words=True, window=WINDOW, gram=GRAM)


#: Symbols of each of the three places of a word.  Nodes look for a child one by one, so the alphabet is small;
#: the places have symbols of their own, so no match starts or ends inside a word.
BASE, PLACES = 192, 2


def symbols() -> Iterator[str]:
    """Pairs of symbols that stand for words; the second comes from as many as are needed."""
    for n in itertools.count():
        yield chr(n % BASE + 1) + chr(n // BASE + BASE + 1)


def phrases(rows: pa.Table, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Confirmed recurring windows of the snippets, located by the automaton.

    A phrase is a window, or the whole snippet where its route has no other: then all its
    windows are in the same documents.
    """
    import ahocorasick

    lo, hi = (np.asarray(rows.column(c)).tolist() for c in ("lo", "hi"))
    _, at, size = np.unique(np.asarray(rows.column("route")), return_inverse=True, return_counts=True)
    alone = (size[at] == 1).tolist()
    fresh, width = symbols(), window * PLACES
    symbol: dict[bytes, str] = {}
    lines, owner = [], {}
    for text, a, b, single in zip(rows.column("snippet").to_pylist(), lo, hi, alone):
        line = "".join([symbol.get(w) or symbol.setdefault(w, next(fresh)) for w in text.split()])
        lines.append(line)
        if single:
            if a < b:
                owner[line] = (a, b)
            continue
        for i in range(0, len(line) - width + 1, PLACES):
            phrase = line[i: i + width]
            known = owner.get(phrase)
            if known is None:
                owner[phrase] = (a, b)
            elif a < known[0] or b > known[1]:
                owner[phrase] = (min(a, known[0]), max(b, known[1]))
    automaton = ahocorasick.Automaton()
    for phrase, (a, b) in owner.items():
        if a < b:  # confirmed: two documents have these words
            automaton.add_word(phrase, (a, len(phrase) // PLACES))
    if not len(automaton):
        return (np.zeros(0, np.int64),) * 4
    automaton.make_automaton()
    found = [(k, end, a, n) for k, line in enumerate(lines) for end, (a, n) in automaton.iter(line)]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    snippet, end, first_doc, length = (np.array(x, np.int64) for x in zip(*found))
    first, many = (end + 1) // PLACES - length, length - window + 1
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return owned_runs(np.repeat(first_doc, many), np.repeat(snippet, many), np.repeat(first, many) + step)


def drop_repeated_phrases(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``; with ``keep_text`` also the kept words.

    A word goes if a window of 13 words that covers it also starts in a document of smaller
    doc_id, judged on the input.  A null text has no words.  Rows that repeat id and text are
    alike; rows of one id with other texts count as one document, so they take nothing from each
    other.  A row without doc_id loses nothing and takes nothing.  Other columns are not read; an
    empty table gives an empty result.
    """
    whole = keyed(docs)
    gone = removed_windows(whole, WORDS, phrases, "op8", by_range=False)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, n_removed, digest, kept = [], [], [], []
        for text, starts, counts in zip(batch.column(1), batch.column(2), batch.column(3)):
            words = (text.as_py() or "").encode().split()
            left = words
            if starts.is_valid and len(words) >= WINDOW:
                lost = cover(np.asarray(starts.values).astype(np.int64), np.asarray(counts.values).astype(np.int64) + WINDOW - 1, len(words))
                left = [w for w, x in zip(words, lost.tolist()) if not x]
            joined = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            digest.append(hashlib.sha256(joined).hexdigest())
            if keep_text:
                kept.append(joined.decode())
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("fp"))
    joined = rows.join(gone, (rows["doc_id"] == gone["doc"]) & (rows["fp"] == gone["fp"]), "left").select("doc_id", "text", "starts", "counts")
    return map_batches(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
