"""Forced-boundary encoding beside the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from barlens.llm import forced_bpe

SCRAPS = ["a", "e", "s", "t", "'", "'s", "'re", "'ll", "'LL", " ", "  ", "\n", "\t", "1", "23", "!", "?", "é", "ç", "中", "文", "😀", " ", "　", "<|endoftext|>", "<|", "endoftext", "ing", " the",
          "Ᲊ", "՘", "xxxxx", "²", "\x00", "\x85", "\x1c", "​"]


@pytest.fixture(scope="session")
def library():
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path(forced_bpe.VOCABULARY)
    return forced_bpe.coder_of(path), tokenizers.Tokenizer.from_file(path)


def ids_of(coder, texts):
    out = [[] for _ in texts]
    for i, ids in coder.slices(iter(texts)):
        out[i] += ids.tolist()
    return out


def test_ids_equal_the_library(library):
    coder, theirs = library
    rng = random.Random(1)
    texts = ["".join(rng.choice(SCRAPS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", "'", "'s", "a" * 20_000, " " * 3000, "<|endoftext|>" * 3, "ab cd " * 200_000]
    texts += ["a" + chr(c) + "1" + chr(c) + " " + chr(c) + "!" for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    want = theirs.encode_batch(texts, add_special_tokens=False)
    got = ids_of(coder, texts)
    assert got == [w.ids for w in want]
    assert [coder.decode(np.array(g, np.uint32)) for g in got[:500]] == [theirs.decode(w.ids, skip_special_tokens=False) for w in want[:500]]


def test_slices_and_a_full_store_change_nothing(library, monkeypatch):
    coder, theirs = library
    rng = random.Random(2)
    texts = [" ".join(rng.choice(SCRAPS) + rng.choice("abc") for _ in range(60)) for _ in range(60)]
    monkeypatch.setattr(forced_bpe, "SLICE_CHARS", 40)
    monkeypatch.setattr(forced_bpe, "STORE_FRAGMENTS", 10)
    assert ids_of(coder, texts) == [w.ids for w in theirs.encode_batch(texts, add_special_tokens=False)]


def test_no_merge_crosses_a_forced_cut(library):
    coder, _ = library
    tokens = [bytes(coder.token_bytes[a:b]) for a, b in zip(coder.token_offsets, coder.token_offsets[1:])]
    ordinary = [t for t in tokens if t not in coder.special]
    assert all(coder.inside[a, b] for t in ordinary for a, b in zip(t, t[1:]))
    assert not coder.inside.all()


def test_query_on_odd_rows(docs, rows, empty, library):
    _, theirs = library
    want = []
    for r in rows:
        w = theirs.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(w), hashlib.sha256(np.array(w, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = forced_bpe.encode_decode(docs, keep_ids=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert sorted(r.decoded for r in got) == sorted(r[1] or "" for r in rows) and all(len(r.ids) == r.n_tokens for r in got)
    assert forced_bpe.encode_decode(empty).count() == 0
