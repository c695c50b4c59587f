"""Classifiers on held-out rows, BPE beside tiktoken, vectors, raking and URLs beside brute force."""

import hashlib
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlens.llm import bpe, lattice, mixing, quality, toxicity, url_reputation

SF = "/root/testdata/sf0.1"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="session")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return bpe.read_ranks(public.path(bpe.VOCABULARY)), public.PATTERN


def test_tokens_equal_the_library(docs, rows, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    coder = tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=vocabulary[0], special_tokens={})
    want = []
    for r in rows:
        ids = coder.encode_ordinary(r[1] or "")
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = bpe.encode_decode(docs, keep_ids=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert sorted(r.decoded for r in got) == sorted(r[1] or "" for r in rows)


def test_ranks_out_of_order():
    tiktoken = pytest.importorskip("tiktoken")
    rng = np.random.default_rng(0)

    def word(lo, hi):
        return bytes(rng.integers(97, 100, rng.integers(lo, hi)).astype(np.uint8))

    for _ in range(30):
        tokens = [bytes([b]) for b in range(256)] + sorted({word(2, 6) for _ in range(60)})
        ranks = {t: int(p) for t, p in zip(tokens, rng.permutation(len(tokens)))}
        ours, theirs = bpe.Replay(ranks, r"[a-z]+|\s+"), tiktoken.Encoding("x", pat_str=r"[a-z]+|\s+", mergeable_ranks=ranks, special_tokens={})
        texts = [" ".join(word(1, 20).decode() for _ in range(15)) for _ in range(10)]
        for text, ids in zip(texts, ours.encode(texts)):
            assert theirs.encode_ordinary(text) == np.frombuffer(ids, "<u4").tolist()


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    near = base[:15] + rng.normal(size=(15, 64)) * 0.2
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(base)] + [(100 + i, [float(x) for x in v], i % 2) for i, v in enumerate(near)]
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]  # copies
    rows += [(300, None, 0), (301, [0.0] * 64, 0), (302, [float("nan")] * 64, 0), (303, rows[0][1], None), (304, [None] * 64, 0), (305, [1.0], 0), (306, [], 0), (None, rows[0][1], 0), rows[3]]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, home string")).collect()}
    good = [r for r in {x[0]: x for x in rows if x[0] is not None}.values() if r[1] and len(r[1]) == 64 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    for label in (0, 1):
        part = [r for r in good if r[2] == label]
        x = np.array([r[1] for r in part])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link = x @ x.T >= 0.93
        np.fill_diagonal(link, False)
        ids = np.array([r[0] for r in part])
        root = ids.copy()
        for _ in range(len(ids)):
            root = np.minimum(root, np.where(link, root[None, :], 10**9).min(1))
        for i, n, c in zip(ids.tolist(), link.sum(1).tolist(), root.tolist()):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, c, c == i), i
    for i in (300, 301, 302, 303, 304, 306):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and not got[None].kept
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_small_blocks_count_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    rows = [(i, [float(x) for x in base + rng.normal(size=64) * 0.15], 1) for i in range(60)]
    monkeypatch.setattr(lattice, "BLOCK_ROWS", 7)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [n for _, n, _ in got] == ((x @ x.T >= 0.93).sum(1) - 1).tolist()


def test_recall_at_the_threshold():
    """Pairs just at the threshold meet in a cell, and their sketches are near enough."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * other
    label = np.zeros(len(x), np.int64)
    (_, a, s), (_, b, t) = lattice.hashed(x, label), lattice.hashed(y, label)
    met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
    bits = np.unpackbits((s ^ t).view(np.uint8), axis=1).sum(1)
    assert (met & (bits <= lattice.FAR_BITS)).mean() > 0.999


def test_nearest_lattice_points():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(200, 8)) * 2
    point = lattice.nearest_e8(y)
    doubled = point * 2
    assert (np.abs(doubled - np.round(doubled)) < 1e-9).all() and (np.abs(point.sum(1) / 2 - np.round(point.sum(1) / 2)) < 1e-9).all()
    assert len(lattice.NEIGHBOURS) == 240
    near = ((y[:, None] - (point[:, None] + lattice.NEIGHBOURS[None])) ** 2).sum(2).min(1)
    assert (((y - point) ** 2).sum(1) <= near + 1e-9).all()


def test_raking_meets_the_marginals(docs, spark):
    got = mixing.sample_documents(docs, budget=0.5).toPandas()
    assert len(got) == docs.count()
    total = got.n_tokens.sum()
    for name in ("source", "lang", "topic"):
        own = got.groupby(name).n_tokens.sum()
        want = (own[own > 0] ** mixing.TEMPER) / (own[own > 0] ** mixing.TEMPER).sum()
        have = (got.n_tokens * got.weight).groupby(got[name]).sum() / total
        assert np.allclose(have[want.index], want, atol=0.02)
    assert abs((got.n_tokens * got.probability).sum() / total - 0.5) < 0.02
    assert (got.probability <= 1).all()
    kept = mixing.mix(docs, budget=0.5)
    assert kept.columns == docs.columns and kept.count() == got.sampled.sum()


def test_raking_equals_a_plain_fit(spark):
    rng = np.random.default_rng(6)
    n = rng.integers(1, 100, (5, 3, 4)).astype(float)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k])) for i in range(5) for j in range(3) for k in range(4)], "source string, lang string, topic string, tokens long")
    fit = n / n.sum()
    targets = [m ** 0.7 / (m ** 0.7).sum() for m in (n.sum((1, 2)), n.sum((0, 2)), n.sum((0, 1)))]
    for _ in range(500):
        fit *= (targets[0] / fit.sum((1, 2)))[:, None, None]
        fit *= (targets[1] / fit.sum((0, 2)))[None, :, None]
        fit *= (targets[2] / fit.sum((0, 1)))[None, None, :]
    weight = fit / (n / n.sum())
    for r in mixing.rake(cells).collect():
        assert abs(r.weight - weight[int(r.source[1]), int(r.lang[1]), int(r.topic[1])]) < 1e-4


def _shares(cells, r, name):
    got = cells.join(r, ["source", "lang", "topic"]).toPandas()
    taken = got.tokens * got.probability
    return taken.groupby(got[name]).sum() / taken.sum(), taken.sum() / got.tokens.sum(), got


def test_probabilities_meet_targets_where_cells_are_whole(spark):
    """With a large budget many cells are taken whole; the sample has its marginals all the same."""
    rng = np.random.default_rng(16)
    base = rng.normal(5, 0.5, (40, 1, 1)) + rng.normal(0, 0.5, (40, 3, 4)) + np.array([0, 0.8, 1.6])[None, :, None] + np.arange(4) * 0.5
    n = np.exp(base).astype(int) * (rng.random((40, 3, 4)) < 0.9)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k])) for i in range(40) for j in range(3) for k in range(4) if n[i, j, k]],
                                  "source string, lang string, topic string, tokens long")
    rake = mixing.rake(cells, budget=0.7).cache()
    for axis, name in (((1, 2), "source"), ((0, 2), "lang"), ((0, 1), "topic")):
        share, budget, got = _shares(cells, rake, name)
        own = n.sum(axis)
        want = mixing.filled(own ** mixing.TEMPER / (own ** mixing.TEMPER).sum(), own.astype(float), own.sum() * 0.7) / (own.sum() * 0.7)
        assert abs(budget - 0.7) < 1e-3
        assert all(abs(share[f"{name[0]}{i}"] - w) < 1e-3 for i, w in enumerate(want))
    assert (got.probability >= 0.999999).mean() > 0.1 and got.probability.max() <= 1 and got.error.max() < mixing.BOUNDED_TOLERANCE
    # a source of one language and a source of the other cannot meet both targets: the miss is told
    small = spark.createDataFrame([("a", "x", "t", 100), ("b", "y", "t", 100)], "source string, lang string, topic string, tokens long")
    torn = mixing.rake(small, budget=0.5, lang_targets={"x": 0.9, "y": 0.1}).collect()
    assert all(r.error > 0.1 and 0 <= r.probability <= 1 for r in torn)


def test_bounded_factor_by_bisection():
    rng = np.random.default_rng(9)
    n, g = rng.integers(0, 50, (30, 8)).astype(float), np.append(rng.random(7) * 5, 0.0)
    quota = n[:, :7].sum(1) * rng.random(30)
    factor, chance = mixing.bounded(n, quota, g)
    assert np.allclose((n * chance).sum(1), quota) and (chance <= 1).all() and np.allclose(chance, np.minimum(1, factor[:, None] * g))
    assert (mixing.bounded(n, n.sum(1), np.ones(8))[1] > 1 - 1e-12).all()


@tables
def test_quality_on_held_out_rows(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score_documents(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert ((got.score >= 0) & (got.score <= 1)).all()


@tables
def test_toxicity_on_held_out_rows(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score_documents(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got[got.toxic == 1].predicted.mean() > 0.85


@pytest.mark.parametrize("model", [quality, toxicity])
def test_scores_of_odd_rows(docs, rows, labels, no_labels, empty, model):
    got = model.score_documents(docs, labels)
    assert got.count() == len(rows)
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert model.score_documents(docs, no_labels).select("score").distinct().count() == 1
    assert model.score_documents(empty, labels).count() == 0


def test_linear_time_interactions_equal_the_pairs():
    rng = np.random.default_rng(7)
    size = quality.HASHES + quality.DENSE
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)), np.zeros(quality.DENSE), np.ones(quality.DENSE))
    x = np.zeros((1, size))
    at = rng.choice(size, 12, replace=False)
    x[0, at] = rng.normal(size=12)
    pairs = sum(m.v[i] @ m.v[j] * x[0, i] * x[0, j] for n, i in enumerate(at) for j in at[n + 1:])
    assert abs(m.raw(x)[0] - (0.3 + x[0] @ m.w + pairs)) < 1e-6


URLS = ["https://WWW.Example.com/en/7", "http://example.com/en/1?x=/", "https://shop.example.com/de/4", "http://a.net/es/3", "http://a.net/de/3#/fr/", "http://net/fr/", "x://com",
        "https://notexample.com/en/1", "no scheme", "", None, "http://a.co.uk/4.html", "://b.org", "http://u:p@h.com:80/en/", "https://a.net/ES/3", "http://é.org/en/10/"]


def test_urls_beside_sql(spark, labels):
    import duckdb
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS * 3)] + [(None, URLS[0], "", "")], "page_id long, url string, host string, bad string")
    got = url_reputation.judge_urls(pages, labels)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", labels.toPandas())
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from oracle import compare
    assert compare(got.toPandas(), con.sql(url_reputation.ORACLE).df()) is None
    rules = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect() if r.page_id is not None}
    assert rules[0] == ("www.example.com", "/en/7", "www.example.com/en/", "allow")
    assert rules[1][1:] == ("/en/1", "example.com/en/", "block") and rules[2][2:] == ("com/", "allow") and rules[3][2:] == ("net/es/", "block")
    assert rules[4][:3] == ("a.net", "/de/3", None) and rules[5][2] == "net/fr/" and rules[6][:3] == ("com", "", None) and rules[10][:3] == ("", "", None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0


def test_prior_strength_is_that_within_the_parent(spark):
    """Hosts that differ by suffix only are shrunk to their domain; hosts that differ inside a domain are not."""
    rng = np.random.default_rng(8)

    def hosts(rate):
        return spark.createDataFrame([(f"h{h}.d{d}.{s}", n, int(rng.binomial(n, rate(i, h)))) for i, s in enumerate(("aa", "bb", "cc")) for d in range(12)
                                      for h in range(6) for n in [int(rng.integers(20, 200))]], "host string, n long, k long")
    by_suffix = hosts(lambda i, h: (0.1, 0.4, 0.8)[i])
    parts = by_suffix.selectExpr("*", "substring_index(host, '.', -2) AS domain", "substring_index(host, '.', -1) AS suffix")
    domains = parts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1))
    assert url_reputation.strength(parts, "domain") > 150 and url_reputation.strength(domains, "suffix") > 150
    assert url_reputation.strength(suffixes, "all") < 10
    own = hosts(lambda i, h: (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)[h]).selectExpr("*", "substring_index(host, '.', -2) AS domain")
    assert url_reputation.strength(own, "domain") < 10
    assert url_reputation.strength(own.where("host LIKE 'h0.%'"), "domain") == url_reputation.STRENGTHS[1]
    rates = {r.host: r.mean for r in url_reputation.host_reputation(by_suffix).collect()}
    assert all(abs(m - {"aa": 0.1, "bb": 0.4, "cc": 0.8}[h[-2:]]) < 0.1 for h, m in rates.items())
