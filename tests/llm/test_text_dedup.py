"""Dedup operators beside brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from barlens.llm import exact_dedup, minhash, phrase_dedup, recurring, suffix_dedup
from barlens.llm.arrays import LOWER


def lower(t):
    return bytes(LOWER[np.frombuffer((t or "").encode(), np.uint8)])


def plain(df, *keys):
    return Counter(tuple(r) for r in df.select(*keys).collect())


def starts_before(rows, unit, window):
    first = {}
    for r in rows:
        if r[0] is not None:
            u = unit(r[1])
            for i in range(len(u) - window + 1):
                k = tuple(u[i:i + window])
                first[k] = min(first.get(k, r[0]), r[0])
    return first


def marks(doc_id, units, window, first):
    lost = np.zeros(len(units), bool)
    if doc_id is not None:
        for i in range(len(units) - window + 1):
            if first[tuple(units[i:i + window])] < doc_id:
                lost[i:i + window] = True
    return lost


def test_equal_texts_keep_the_largest_id(docs, rows):
    want = Counter()
    for r in rows:
        same = [x for x in rows if lower(x[1]) == lower(r[1])]
        keep = max((x[0] for x in same if x[0] is not None), default=None)
        want[(r[0], keep, len(same), r[0] == keep, hashlib.sha256(lower(r[1])).hexdigest())] += 1
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert plain(exact_dedup.exact_groups(docs), *columns) == want


def test_colliding_fingerprints_are_told_apart_by_bytes(docs):
    from pyspark.sql import functions as F
    weak = exact_dedup.exact_groups(docs, fingerprint=lambda t: F.pmod(F.xxhash64(t), F.lit(3)))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert plain(weak, *columns) == plain(exact_dedup.exact_groups(docs), *columns)


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cqf = exact_dedup.CountingQuotientFilter
    whole = cqf.merged([cqf.of(part) for part in np.array_split(values, 7)])
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist())) == Counter(values.tolist())
    again = cqf.merged([p for _, p in whole.pieces(4)])
    assert (again.fingerprints() == whole.fingerprints()).all() and (again.counts == whole.counts).all()


def test_dropping_copies_keeps_columns_and_one_row(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [lower(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({lower(r.text) for r in docs.collect()})


def test_repeated_strings(docs, rows):
    first = starts_before(rows, lambda t: (t or "").encode(), 50)
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        lost = marks(r[0], raw, 50, first)
        left = np.frombuffer(raw, np.uint8)[~lost].tobytes()
        spans = int((np.diff(np.concatenate(([0], lost.astype(int)))) == 1).sum())
        want[(r[0], len(raw), int(lost.sum()), spans, hashlib.sha256(left).hexdigest())] += 1
    got = suffix_dedup.drop_repeated_strings(docs, keep_text=True)
    assert plain(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_phrases(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(recurring, "HOT", hot)  # 1: every recurring gram is routed window by window
    first = starts_before(rows, lambda t: (t or "").encode().split(), 13)
    want = Counter()
    for r in rows:
        words = (r[1] or "").encode().split()
        lost = marks(r[0], words, 13, first)
        left = b" ".join(w for w, x in zip(words, lost) if not x)
        want[(r[0], len(words), int(lost.sum()), hashlib.sha256(left).hexdigest())] += 1
    assert plain(phrase_dedup.drop_repeated_phrases(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_hot_strings_are_routed_by_window(docs, monkeypatch):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    usual = plain(suffix_dedup.drop_repeated_strings(docs), *columns)
    monkeypatch.setattr(recurring, "HOT", 1)
    monkeypatch.setattr(recurring, "SHARE", 50)
    assert plain(suffix_dedup.drop_repeated_strings(docs), *columns) == usual


def test_multikey_sort():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, (500, 11)).astype(np.uint16)
    order, common = suffix_dedup.multikey_sort(codes)
    lines = [tuple(r) for r in codes[order]]
    assert lines == sorted(lines)
    for a, b, n in zip(lines, lines[1:], common[1:]):
        assert n == next((i for i in range(11) if a[i] != b[i]), 11)


def shingled(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(t))
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def probability_jaccard(a, b):
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def test_near_copies(docs, rows):
    known = {}
    for r in rows:
        if r[0] is not None:
            known[r[0]] = r[1]
    sets = {d: shingled(t) for d, t in known.items()}
    root = {d: d for d in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(known)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            near = (known[a] or "") == (known[b] or "")
            if not near and sets[a] and sets[b] and 0.7 < len(sets[a]) / len(sets[b]) < 1.5 and sets[a].keys() & sets[b].keys():
                near = probability_jaccard(sets[a], sets[b]) >= 0.8
            if near:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minhash.near_groups(docs)
    assert got.count() == len(rows)
    for r in got.collect():
        if r.doc_id is not None:
            assert (r.class_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d in known if find(d) == d} | {None}


def test_exact_similarity_of_weighted_sets():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (Counter(rng.integers(0, 12, rng.integers(1, 30)).tolist()) for _ in range(2))
        arrays = [np.array(x) for c in (a, b) for x in (sorted(c), [c[k] for k in sorted(c)])]
        assert abs(minhash.probability_jaccard(*arrays) - probability_jaccard(a, b)) < 1e-9


def test_registers_agree_with_the_similarity():
    rng = np.random.default_rng(5)
    agree = 0.0
    for trial in range(60):
        pool = rng.integers(1, 1 << 62, 40).astype(np.uint64)
        wa, wb = rng.integers(1, 4, 40), rng.integers(1, 4, 40)
        a, b = pool[:35], pool[5:]
        held = minhash.registers(np.repeat([0, 1], 35), np.concatenate((a, b)), np.concatenate((wa[:35], wb[5:])), 2)
        ca, cb = Counter(dict(zip(a.tolist(), wa[:35].tolist()))), Counter(dict(zip(b.tolist(), wb[5:].tolist())))
        agree += (held[0] == held[1]).mean() - probability_jaccard(ca, cb)
    assert abs(agree / 60) < 0.02


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, minhash.near_groups, suffix_dedup.drop_repeated_strings, phrase_dedup.drop_repeated_phrases])
def test_empty_tables(empty, operator):
    assert operator(empty).count() == 0


@pytest.mark.parametrize("itself", [True, False])
def test_blocks_find_links_between_components(itself, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 16)
    rng = np.random.default_rng(8)
    base = rng.permutation(1 << 20)[:60].astype(np.uint64)
    sets, weights = [], []
    for k in range(24):
        own = np.unique(np.concatenate((rng.choice(base, 50, replace=False), rng.integers(1 << 21, 1 << 22, 3).astype(np.uint64))))
        sets.append(own)
        weights.append(np.where(rng.random(len(own)) < (0.3 if k % 3 == 0 else 0), 2, 1).astype(np.int32))
    side = np.zeros(24, int) if itself else np.arange(24) % 2
    node = np.arange(24) * 5
    part = np.where(np.arange(24) < 6, 0, node)  # the first are one component already
    group = pa.table({"side": side, "node": node, "c": part, "itself": [itself] * 24, "s1": np.zeros(24, np.int64), "s2": np.zeros(24, np.int64),
                      "elements": [s.tobytes() for s in sets], "weights": [w.tobytes() for w in weights]})
    got = minhash.block_links(group, 0.7)
    counters = [Counter(dict(zip(s.tolist(), w.tolist()))) for s, w in zip(sets, weights)]

    def joined(edges):
        root = dict(zip(part.tolist(), part.tolist()))

        def top(c):
            while root[c] != c:
                c = root[c]
            return c

        for i, j in edges:
            x, y = top(part[i]), top(part[j])
            root[max(x, y)] = min(x, y)
        return {int(n): int(top(c)) for n, c in zip(node, part)}

    want = [(i, j) for i in range(24) for j in range(24) if i < j and (itself or side[i] != side[j]) and probability_jaccard(counters[i], counters[j]) >= 0.7]
    links = [(a // 5, b // 5) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist())]
    assert all(probability_jaccard(counters[i], counters[j]) >= 0.7 for i, j in links) and want
    assert joined(links) == joined(want) and len(links) < 24


def test_short_texts_are_verified_whatever_their_sketches_say(spark):
    """Pairs of 4 and 5 shingles, similarity 0.8: some sketches differ in more than FAR_BITS bits, none may be lost for that."""
    n = 6000
    texts = [(2 * k + more, " ".join(f"w{k}x{i}" for i in range(8 + more))) for k in range(n) for more in (0, 1)]
    got = minhash.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.class_id != r.doc_id // 2 * 2} == set() and len(got) == 2 * n


def test_blocks_link_pairs_of_far_sketches():
    import pyarrow as pa
    for weights in ([1, 1, 1, 1], [1, 1, 1, 1, 1]), ([8], [8, 2]):
        group = pa.table({"side": [0, 0], "node": [3, 9], "c": [3, 9], "itself": [True, True], "s1": [0, -1], "s2": [0, -1],
                          "elements": [np.arange(len(w), dtype=np.uint64).tobytes() for w in weights],
                          "weights": [np.array(w, np.int32).tobytes() for w in weights]})
        assert minhash.block_links(group, 0.8).num_rows == 1


def test_an_element_visits_every_register_once_in_an_order_of_its_own():
    keys = np.random.default_rng(3).integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    order = np.array([minhash._visited(j, *keys) for j in range(minhash.REGISTERS)])
    assert (np.sort(order, axis=0) == np.arange(minhash.REGISTERS)[:, None]).all()
    assert len(np.unique(order[1] - order[0])) > 64 and len({tuple(np.diff(o) % minhash.REGISTERS) for o in order.T}) > 490


@pytest.mark.parametrize("block", [256, 4])
def test_crowds_of_texts_that_are_not_near_enough(spark, monkeypatch, block):
    """A large group at similarities around the threshold: no link between components is missed, rows stay linear."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(70)]

    def changed(times):
        words = list(base)
        for _ in range(times):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        return words
    texts = [changed(rng.randint(2, 7)) for _ in range(70)] + [changed(1) for _ in range(3)]
    texts += [t[:35] + t[:35] for t in texts[:6]]  # shingles that occur twice
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    similar = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            similar[i, j] = probability_jaccard(sets[i], sets[j])
            if similar[i, j] >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert sum(0.5 < s < 0.8 for s in similar.values()) > 200
    seen = {}
    monkeypatch.setattr(minhash, "stored", lambda df, label, keep=minhash.stored: seen.setdefault(label, keep(df, label)) if label in ("op4-sides", "op4-met") else keep(df, label))
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert [(r.class_id) for r in sorted(got)] == [find(i) for i in range(len(rows))]
    if block == 4 and "op4-sides" in seen:
        assert seen["op4-sides"].count() < len(rows) * len(rows) / block


def test_every_link_meets_under_a_rare_shingle(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_NODES", 8)
    rng = np.random.default_rng(9)
    common = rng.integers(1, 2**60, 40)
    rows = []
    for i in range(60):
        own = rng.integers(1, 2**60, rng.integers(0, 9))
        element = np.unique(np.concatenate((rng.choice(common, rng.integers(30, 40), replace=False), own))).astype(np.uint64)
        element = np.sort(element)
        weight = rng.integers(1, 3, len(element)).astype(np.int32)
        rows.append((i, i, bytearray(element.tobytes()), bytearray(weight.tobytes())))
    sets = spark.createDataFrame(rows, "node long, c long, elements binary, weights binary")
    lists, large = minhash.meetings(sets, 0.8)
    met = [set(r.nodes) for r in lists.collect()]
    by = {}
    for r in large.collect():
        by.setdefault(r.meeting, set()).add(r.node)
    assert all(r.n == len(by[r.meeting]) for r in large.collect())
    met += by.values()
    arrays = [(np.frombuffer(r[2], np.uint64), np.frombuffer(r[3], np.int32)) for r in rows]
    links = [(i, j) for i in range(60) for j in range(i + 1, 60) if minhash.probability_jaccard(*arrays[i], *arrays[j]) >= 0.8 or np.isin(*[arrays[k][0] for k in (i, j)]).all()]
    assert all(any({i, j} <= m for m in met) for i, j in links)
