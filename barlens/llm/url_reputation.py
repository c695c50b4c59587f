"""URL filter: allow and block rules, and for the rest a host reputation by empirical Bayes.

A page whose document is labelled (its path ends in the document's number) is an outcome:
bad if the label says low quality or toxic.  The bad rates are shrunk through beta-binomial
priors: the suffix towards all pages, the registered domain towards its suffix, the host
towards its domain.  A level's prior strength is estimated by moments
from how much the groups of one parent differ beyond chance.  A page without a rule is blocked when
the lower bound of its host's posterior bad rate exceeds the threshold.  Only DataFrame
functions run; the rates are one row per host, the only shuffled side that grows with
pages is (page, host, path), and it joins on host as a left side that can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.frames import LOWERED, UPPER, stored

#: The rules of the filter as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
BOUND_Z = 1.645
THRESHOLD = 0.5
STRENGTHS = (1.0, 1000.0)
#: The document's number at the end of a path.
NUMBER = r"/(\d+)(?:\.html?)?/?$"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found: Column | None = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def strength(groups: DataFrame, parent: str) -> float:
    """Prior size M of a level by moments around its parents' rates.

    Among the groups of one parent with rate r, sum n (k/n - r)^2 is (groups - 1) r (1 - r) by chance plus
    r (1 - r) (N - sum n^2 / N) / (M + 1) where the groups differ.  Both sides are summed over all parents, so what
    parents differ in does not count as a difference between their groups; a lone group says nothing.
    """
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    per = groups.where("n > 0").groupBy(parent).agg(
        F.count(F.lit(1)).alias("g"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk"))
    noise = k / n * (1 - k / n)
    row = per.agg(F.sum(F.col("kk") - k * k / n - (F.col("g") - 1) * noise).alias("over"), F.sum(noise * (n - F.col("nn") / n)).alias("room")).first()
    if not row["room"] or row["room"] <= 0 or row["over"] <= 0:
        return STRENGTHS[1]
    return min(max(row["room"] / row["over"] - 1, STRENGTHS[0]), STRENGTHS[1])


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """host, mean, lower from one row per host with n labelled pages and k bad ones.

    Hosts without labelled pages take their domain's rate, domains their suffix's, and so
    on; with no labelled page at all every rate is one half.
    """
    hosts = stored(outcomes.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"), "op10-hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    rate = total["k"] / total["n"] if total["n"] else 0.5
    m_suffix = strength(suffixes.withColumn("all", F.lit(1)), "all")
    m_domain, m_host = strength(domains, "suffix"), strength(hosts, "domain")

    def shrunk(prior: Column, m: float) -> Column:
        return (F.col("k") + F.lit(m) * prior) / (F.col("n") + F.lit(m))

    by_suffix = suffixes.select("suffix", shrunk(F.lit(rate), m_suffix).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk(F.col("suffix_rate"), m_domain).alias("domain_rate"))
    a = F.col("k") + F.lit(m_host) * F.col("domain_rate")
    size = F.col("n") + F.lit(m_host)
    mean = a / size
    return hosts.join(by_domain, "domain").select("host", mean.alias("mean"), (mean - F.lit(BOUND_Z) * F.sqrt(mean * (1 - mean) / (size + 1))).alias("lower"))


def bad_documents(labels: DataFrame) -> DataFrame:
    """number and bad (0 or 1) of every labelled document; labels that are null say nothing, and of several the worst counts."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").cast("long").alias("number"), bad.alias("bad")).groupBy("number").agg(F.max("bad").alias("bad"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, which no rule fits; the
    reputation of the empty host then decides.  Rows repeat as in the input, null page ids
    stay null, other columns are not read, an empty table gives an empty result.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules)) \
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    # (host, document) is counted before labels are looked up, so a hot host or document is a few rows
    numbers = parts.select("host", F.regexp_extract("path", NUMBER, 1).try_cast("long").alias("number")).groupBy("host", "number").agg(F.count(F.lit(1)).alias("pages"))
    outcomes = numbers.join(bad_documents(labels), "number", "left").groupBy("host").agg(
        F.sum(F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)).alias("n"), F.sum(F.when(F.col("bad") == 1, F.col("pages")).otherwise(0)).alias("k"))
    bad = host_reputation(outcomes).select("host", (F.col("lower") > threshold).alias("bad"))
    return ruled.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


#: The same result in DuckDB's SQL, written from the definitions above.
ORACLE = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
addresses AS (SELECT DISTINCT host, path FROM parts),
fits AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS ruled
  FROM addresses JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
judged AS (SELECT p.*, f.rule, f.ruled FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path),
bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
numbered AS (SELECT host, TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)(\.html?)?/?$', 1), '') AS BIGINT) AS doc_id FROM judged),
hosts0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, string_split(host, '.') AS labels FROM numbered LEFT JOIN bad USING (doc_id) GROUP BY host),
hosts1 AS (
  SELECT host, n, k, labels, CASE WHEN array_to_string(labels[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'org.uk') THEN 2 ELSE 1 END AS parts FROM hosts0),
hosts AS (SELECT host, n, k, array_to_string(labels[-parts:], '.') AS suffix, array_to_string(labels[-(parts + 1):], '.') AS domain FROM hosts1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix),
total AS (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.5) AS rate FROM suffixes),
levels AS (SELECT 'host' AS level, domain AS parent, n, k FROM hosts UNION ALL SELECT 'domain', suffix, n, k FROM domains UNION ALL SELECT 'suffix', '', n, k FROM suffixes),
rated AS (SELECT *, sum(k) OVER w / sum(n) OVER w AS r FROM levels WHERE n > 0 WINDOW w AS (PARTITION BY level, parent)),
families AS (SELECT level, parent, count(*) AS g, sum(n) AS n, sum(n * n) AS nn, sum(n * pow(k / n - r, 2)) AS ss, any_value(r * (1 - r)) AS noise FROM rated GROUP BY level, parent),
moments AS (SELECT level, sum(ss - (g - 1) * noise) AS over_chance, sum(noise * (n - nn / n)) AS room FROM families GROUP BY level),
strengths AS (SELECT level, CASE WHEN room <= 0 OR over_chance <= 0 THEN 1000.0 ELSE least(greatest(room / over_chance - 1, 1.0), 1000.0) END AS m FROM moments),
m AS (SELECT coalesce(max(m) FILTER (WHERE level = 'host'), 1000.0) AS mh, coalesce(max(m) FILTER (WHERE level = 'domain'), 1000.0) AS md, coalesce(max(m) FILTER (WHERE level = 'suffix'), 1000.0) AS ms FROM strengths),
by_suffix AS (SELECT suffix, (k + ms * rate) / (n + ms) AS r FROM suffixes, total, m),
by_domain AS (SELECT d.domain, (d.k + md * s.r) / (d.n + md) AS r FROM domains d JOIN by_suffix s USING (suffix), m),
by_host AS (SELECT host, (h.k + mh * d.r) / (h.n + mh) AS mean, h.n + mh AS size FROM hosts h JOIN by_domain d USING (domain), m)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN by_host b ON j.host = b.host
"""
