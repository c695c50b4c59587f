"""The registered queries of the operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barlens.llm import bpe, conversations, exact_dedup, forced_bpe, lattice, lloyd, minhash, mixing, phrase_dedup, quality, suffix_dedup, toxicity, url_reputation
from barlens.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_factorisation_machine": lambda s, d: quality.score_documents(table(s, d, "documents"), table(s, d, "labels")),
    "op2_mixing_by_raking": lambda s, d: mixing.sample_documents(table(s, d, "documents")),
    "op3_suffix_array_dedup": lambda s, d: suffix_dedup.drop_repeated_strings(table(s, d, "documents")),
    "op4_probminhash_near_dedup": lambda s, d: minhash.near_groups(table(s, d, "documents")),
    "op5_exact_dedup_quotient_filter": lambda s, d: exact_dedup.exact_groups(table(s, d, "documents")),
    "op6_toxicity_boosted_trees": lambda s, d: toxicity.score_documents(table(s, d, "documents"), table(s, d, "labels")),
    "op7_lattice_near_dedup": lambda s, d: lattice.near_vectors(table(s, d, "embeddings")),
    "op8_repeated_phrase_dedup": lambda s, d: phrase_dedup.drop_repeated_phrases(table(s, d, "documents")),
    "op9_bpe_merge_replay": lambda s, d: bpe.encode_decode(table(s, d, "documents")),
    "op10_url_reputation": lambda s, d: url_reputation.judge_urls(table(s, d, "pages"), table(s, d, "labels")),
    "op11_conversation_repair_by_word_graph": lambda s, d: conversations.repair_damaged(table(s, d, "conversations")),
    "op12_bpe_forced_boundaries": lambda s, d: forced_bpe.encode_decode(table(s, d, "documents")),
    "op13_vector_codes_by_resident_lloyd": lambda s, d: lloyd.compressed(table(s, d, "embeddings")),
}

ORACLES: dict[str, str] = {
    "op7_lattice_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN roots r ON r.x = vec_id LEFT JOIN counts c ON c.x = vec_id""",
    "op8_repeated_phrase_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
phrases AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
owners AS (SELECT k, min(doc_id) AS owner FROM phrases GROUP BY k HAVING count(DISTINCT doc_id) > 1),
starts AS (SELECT doc_id, i FROM phrases JOIN owners USING (k) WHERE owner < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM starts) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone g ON g.doc_id = d.doc_id""",
    "op5_exact_dedup_quotient_filter": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)""",
    "op10_url_reputation": url_reputation.ORACLE,
    "op13_vector_codes_by_resident_lloyd": """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
cells AS (SELECT r, unnest(embedding) AS y, unnest(range(len(embedding))) AS i, len(embedding) // 16 AS width FROM v),
x AS MATERIALIZED (SELECT r, CAST(i // width AS BIGINT) AS p, i % width AS k, CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT) AS c FROM cells),
b0 AS (SELECT p, r - 1 AS e, k, c FROM x WHERE r <= 64),
far0 AS (SELECT x.r, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b0 b ON b.p = x.p AND b.k = x.k GROUP BY x.r, x.p, b.e),
near0 AS (SELECT r, p, min_by(e, d * 64 + e) AS e, min(d) AS d FROM far0 GROUP BY r, p),
b1 AS (SELECT b.p, b.e, b.k, coalesce(m.c, b.c) AS c FROM b0 b LEFT JOIN (
  SELECT n.p, n.e, x.k, CAST(floor(CAST(sum(x.c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM near0 n JOIN x ON x.r = n.r AND x.p = n.p GROUP BY n.p, n.e, x.k) m ON m.p = b.p AND m.e = b.e AND m.k = b.k),
far1 AS (SELECT x.r, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b1 b ON b.p = x.p AND b.k = x.k GROUP BY x.r, x.p, b.e),
near1 AS (SELECT r, p, min_by(e, d * 64 + e) AS e, min(d) AS d FROM far1 GROUP BY r, p),
b2 AS (SELECT b.p, b.e, b.k, coalesce(m.c, b.c) AS c FROM b1 b LEFT JOIN (
  SELECT n.p, n.e, x.k, CAST(floor(CAST(sum(x.c) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM near1 n JOIN x ON x.r = n.r AND x.p = n.p GROUP BY n.p, n.e, x.k) m ON m.p = b.p AND m.e = b.e AND m.k = b.k),
far2 AS (SELECT x.r, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b2 b ON b.p = x.p AND b.k = x.k GROUP BY x.r, x.p, b.e),
near2 AS (SELECT r, p, min_by(e, d * 64 + e) AS e, min(d) AS d FROM far2 GROUP BY r, p),
codes AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k)) FROM b2) AS codebooks_sha256
FROM v JOIN codes USING (r)""",
}
