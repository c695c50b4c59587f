"""Result tables and text scans as queries.  Orders stand for strategies, customers for ideas and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.core import finite, r
from barlens.operators import registry as rg
from barlens.operators import textscan as tx
from barlens.plans.catalog import query
from barlens.session import table

AS_OF = "2001-08-01 00:00:00"
_ERRORS = {
    0: "Leakage check failed at line 3", 1: "NameError: name x is not defined", 2: "Container exited with SIGKILL",
    3: "optimization_regression: sharpe fell", 4: "", 5: "Too few trades: 0 ", 6: "something else", 7: "exec() failed in <strategy>",
}
_ERR_EXPR = "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _ERRORS.items()) + " END"
_STATUSES = ["failed", "running", "backtesting", "quick_testing", "quick_tested", "archived", "live", "filtered"]
_ST_EXPR = "CASE (o_orderkey + o_custkey) % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_STATUSES)) + " END"
_COLS = f"""o_orderkey AS id, {_ST_EXPR} AS status, {_ERR_EXPR} AS error_log, o_orderkey % 5 AS retry_count, o_orderkey % 7 <> 0 AS has_code,
  o_orderkey % 10 = 0 AS is_campaign_root, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey - o_orderkey % 10 END AS campaign_id,
  round((o_totalprice - 250000.0) / 100000.0, 8) AS sharpe, o_custkey % 60 AS trades, o_custkey AS idea_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'job-' || o_orderkey END AS job_id"""
_STRAT = f"strategies AS (SELECT {_COLS}, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM orders)"


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        *[c.strip() for c in _split(_COLS)], "CAST(o_orderdate AS TIMESTAMP) AS updated_at")


def _split(text: str) -> list[str]:
    """Comma-separated expressions, commas inside brackets left alone."""
    parts, depth, cur = [], 0, ""
    for ch in text:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return [*parts, cur]


@query("upsert", """
WITH base AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_acctbal AS balance, 1 AS version FROM customer),
upd AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END AS k, lower(c_mktsegment) AS segment, c_acctbal + 1 AS balance, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END AS version FROM customer WHERE c_custkey % 5 < 3)
SELECT k, arg_max(segment, (version, new)) AS segment, round(arg_max(balance, (version, new)), 2) AS balance, max(version) AS version FROM (SELECT *, 0 AS new FROM base UNION ALL SELECT *, 1 FROM upd) GROUP BY k""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    base = c.selectExpr("c_custkey AS k", "c_mktsegment AS segment", "c_acctbal AS balance", "1 AS version")
    upd = c.where("c_custkey % 5 < 3").selectExpr(
        "c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END AS k", "lower(c_mktsegment) AS segment",
        "c_acctbal + 1 AS balance", "CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END AS version")
    return rg.upsert(base, upd, keys=["k"], version="version").withColumn("balance", r("balance", 2))


@query("insert_if_absent", """
WITH t AS (SELECT DISTINCT lower(trim(p_name || ' ' || (p_partkey % 50))) AS k FROM part WHERE p_partkey % 3 = 0), n AS (SELECT upper(p_name || ' ' || (p_partkey % 50)) AS title, min(p_partkey) AS id FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT id, title FROM n WHERE lower(trim(title)) NOT IN (SELECT k FROM t)""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name || ' ' || (p_partkey % 50) AS title")
    return rg.insert_if_absent(p.where("id % 3 = 0"), p.where("id % 2 = 1").selectExpr("id", "upper(title) AS title"), "title")


@query("cascade_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rg.cascade_delete(o, table(spark, sf_dir, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("cascade_null", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_custkey END AS parent_key FROM orders")
def cascade_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey AS parent_key")
    return rg.cascade_null(o, table(spark, sf_dir, "customer").where("c_acctbal > 0"), "parent_key", "c_custkey")


@query("stale_transitions", f"""WITH {_STRAT}, x AS (SELECT *, CASE WHEN status = 'running' AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 35 MINUTE THEN 1 WHEN status = 'backtesting' AND job_id IS NOT NULL AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 52 MINUTE THEN 2
  WHEN status = 'quick_testing' AND job_id IS NOT NULL AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 20 MINUTE THEN 3 WHEN status = 'failed' AND retry_count < 3 AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE THEN 4 END AS k FROM strategies)
SELECT id, status AS old, CASE WHEN k = 4 THEN 'pending' ELSE 'failed' END AS new, CASE k WHEN 1 THEN 'research timed out' WHEN 2 THEN 'backtest timed out' WHEN 3 THEN 'quick test timed out' ELSE 'retry' END AS reason, retry_count + CASE WHEN k = 4 THEN 1 ELSE 0 END AS retry_count, CAST(NULL AS VARCHAR) AS job_id FROM x WHERE k IS NOT NULL""")
def stale_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.stale_jobs(strategies(spark, sf_dir), AS_OF, key="id")


def _classify_sql(col: str) -> str:
    def esc(p: str) -> str:
        return p.replace("'", "''")
    q = " OR ".join(f"contains(lower({col}), '{esc(p)}')" for p in rg.QUALITY_PHRASES)
    i = " OR ".join(f"contains(lower({col}), '{esc(p)}')" for p in rg.INFRASTRUCTURE_PHRASES)
    b = " OR ".join(f"regexp_matches({col}, '{esc(p)}')" for p in rg.CODE_BUG_PATTERNS)
    return f"""CASE WHEN {col} IS NULL OR {col} = '' THEN 'unknown' WHEN contains(lower({col}), 'optimization_regression') THEN 'code_bug' WHEN {q} THEN 'quality_rejection'
  WHEN {i} THEN 'infrastructure' WHEN {b} THEN 'code_bug' ELSE 'unknown' END"""


@query("archive_transitions", f"""WITH {_STRAT}, x AS (SELECT *, {_classify_sql('error_log')} AS cls FROM strategies WHERE status = 'failed' AND updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR)
SELECT id, status AS old, 'archived' AS new, CASE WHEN cls = 'quality_rejection' THEN 'quality rejection' WHEN NOT has_code THEN 'no code to fix' ELSE 'retry limit' END AS reason
FROM x WHERE cls = 'quality_rejection' OR NOT has_code OR retry_count >= 3""")
def archive_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.transitions(strategies(spark, sf_dir), rg.archive_rules(AS_OF), key="id")


@query("weak_variations", f"WITH {_STRAT} SELECT id, sharpe, trades FROM strategies WHERE NOT is_campaign_root AND sharpe < 0 AND trades < 30")
def weak_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strategies(spark, sf_dir)
    return s.where(~F.col("is_campaign_root") & rg.weak_variation(F.col("sharpe"), F.col("trades"))).select("id", "sharpe", "trades")


@query("classify_errors", f"""WITH e AS (SELECT d.doc_id, text || ' ' || {_ERR_EXPR.replace('o_orderkey', 'd.doc_id')} AS t FROM documents d)
SELECT {_classify_sql('t')} AS error_class, count(*) AS n FROM e GROUP BY 1""")
def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = F.concat("text", F.lit(" "), F.expr(_ERR_EXPR.replace("o_orderkey", "doc_id")))
    return d.groupBy(rg.classify_error(t).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


@query("promising", f"""WITH {_STRAT}, tf AS (SELECT id, CASE id % 3 WHEN 0 THEN '1h' WHEN 1 THEN '4h' ELSE '1d' END AS tf, trades, sharpe FROM strategies)
SELECT idea_id, bool_or(trades >= 10 AND sharpe >= 0.3) AS promising FROM (SELECT s.idea_id, x.tf, max(x.trades) AS trades, max(x.sharpe) AS sharpe FROM tf x JOIN strategies s USING (id) GROUP BY 1, 2) GROUP BY 1""")
def promising(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strategies(spark, sf_dir).withColumn("tf", F.expr("CASE id % 3 WHEN 0 THEN '1h' WHEN 1 THEN '4h' ELSE '1d' END"))
    grid = s.groupBy("idea_id", "tf").agg(F.max("trades").alias("trades"), F.max("sharpe").alias("sharpe")).groupBy("idea_id").agg(
        F.map_from_entries(F.collect_list(F.struct("tf", F.struct("trades", "sharpe")))).alias("grid"))
    return grid.select("idea_id", rg.promising(F.col("grid")).alias("promising"))


_TASKS = """tasks AS (SELECT c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'done' END AS status,
  CASE WHEN c_custkey % 11 <> 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'EURUSD' WHEN 1 THEN 'GBPUSD' ELSE 'USDJPY' END END AS symbol, c_custkey % 4 = 0 AS fanned_out,
  CASE WHEN c_custkey % 6 = 5 THEN c_custkey - 1 END AS parent_task_id, CASE WHEN c_custkey % 7 <> 0 THEN '1h' END AS timeframe FROM customer)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _TASKS[_TASKS.index("SELECT") + 6:_TASKS.index(" FROM customer")]
    return table(spark, sf_dir, "customer").selectExpr(*[c.strip() for c in _split(body)])


@query("fan_out", f"""WITH {_TASKS}, s AS (SELECT unnest(['EURUSD', 'GBPUSD', 'USDJPY', 'AUDUSD', 'USDCAD', 'NZDUSD']) AS sym),
t AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'Trend of ' || symbol ELSE 'Trend' END AS title, 'Does ' || symbol || ' trend?' AS question FROM tasks)
SELECT id AS parent_task_id, sym AS symbol, timeframe, CASE WHEN contains(title, symbol) THEN replace(title, symbol, sym) ELSE title || ' — ' || sym END AS title, replace(question, symbol, sym) AS question, 'pending' AS status
FROM t, s WHERE status = 'done' AND NOT fanned_out AND parent_task_id IS NULL AND symbol IS NOT NULL AND timeframe IS NOT NULL AND sym <> symbol""")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir).withColumns({
        "title": F.expr("CASE WHEN id % 2 = 0 THEN 'Trend of ' || symbol ELSE 'Trend' END"), "question": F.expr("'Does ' || symbol || ' trend?'")})
    return rg.fan_out(t)


@query("dependencies_done", f"""WITH {_TASKS}, s AS (SELECT o_orderkey AS id, unnest(CASE o_orderkey % 10 WHEN 0 THEN [NULL] WHEN 1 THEN [-1] ELSE [o_custkey, o_custkey + 1, o_custkey + 2] END) AS task_id FROM orders)
SELECT s.id, coalesce(bool_and(t.status IN ('done', 'failed')), false) AS all_done, count(*) FILTER (WHERE t.status = 'done') AS n_done, count(t.id) AS n_tasks,
  CASE WHEN count(t.id) = 0 THEN 'filtered' WHEN bool_and(t.status IN ('done', 'failed')) THEN 'ready' END AS next FROM s LEFT JOIN tasks t ON t.id = s.task_id GROUP BY 1""")
def dependencies_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE o_orderkey % 10 WHEN 0 THEN array() WHEN 1 THEN array(-1L) ELSE array(o_custkey, o_custkey + 1, o_custkey + 2) END AS pending_ids")
    return rg.dependencies_done(s, tasks(spark, sf_dir))


@query("status_counts", f"""WITH {_STRAT} SELECT has_code, count(*) AS total, count(*) FILTER (WHERE status IN ('running', 'backtesting', 'quick_testing')) AS busy,
  count(*) FILTER (WHERE status IN ('failed', 'archived')) AS lost, count(*) FILTER (WHERE status = 'live') AS live FROM strategies GROUP BY 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.status_counts(strategies(spark, sf_dir), ["has_code"], {
        "busy": ["running", "backtesting", "quick_testing"], "lost": ["failed", "archived"], "live": ["live"]})


_PRICES = {"small": (0.00025, 0.00125), "large": (0.015, 0.075)}
_MODEL = "CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END"


@query("daily_spend", f"""WITH c AS (SELECT CAST(ts AS DATE) AS date, {_MODEL} AS m, user_id AS i, CAST(floor(value) AS BIGINT) AS o FROM events)
SELECT strftime(date, '%Y-%m-%d') AS date, round(sum(cost), 6) AS spent, round(greatest(0, 10.0 - sum(cost)), 6) AS remaining FROM (SELECT date, (i * CASE m WHEN 'small' THEN 0.00025 WHEN 'large' THEN 0.015 ELSE 0.003 END
  + o * CASE m WHEN 'small' THEN 0.00125 WHEN 'large' THEN 0.075 ELSE 0.015 END) / 1000 AS cost FROM c) GROUP BY 1""")
def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cost = rg.token_cost(F.expr(_MODEL), F.col("user_id"), F.floor("value"), _PRICES)
    log = e.select(F.to_date("ts").alias("date"), cost.alias("cost_usd"))
    return rg.daily_spend(log, 10.0).select(F.date_format("date", "yyyy-MM-dd").alias("date"), r("spent").alias("spent"), r("remaining").alias("remaining"))


_KB = """kb AS (SELECT o_orderkey AS id, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '+EMA' ELSE '' END AS indicator, CASE o_orderkey % 4 WHEN 0 THEN 'works' WHEN 1 THEN 'fails' ELSE 'partial' END AS category,
  CASE o_orderkey % 5 WHEN 0 THEN '1d' WHEN 1 THEN '4h' ELSE '1h' END AS timeframe, round((o_totalprice - 250000.0) / 100000.0, 8) AS sharpe_ref FROM orders)"""


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _KB[_KB.index("SELECT") + 6:_KB.index(" FROM orders")]
    return table(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _split(body)])


@query("knowledge_rollup", f"""WITH {_KB} SELECT trim(split_part(indicator, '+', 1)) AS indicator, count(*) AS n, max(sharpe_ref) AS best_sharpe, min(sharpe_ref) AS worst_sharpe,
  string_agg(DISTINCT category, '/' ORDER BY category) AS categories, string_agg(DISTINCT timeframe, '/' ORDER BY timeframe) AS timeframes FROM kb GROUP BY 1""")
def knowledge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.knowledge_rollup(knowledge(spark, sf_dir))


@query("campaign_rollup", f"""WITH {_STRAT}, m AS (SELECT *, CASE WHEN is_campaign_root THEN id ELSE campaign_id END AS root_id FROM strategies),
a AS (SELECT root_id, count(*) FILTER (WHERE NOT is_campaign_root) AS variations, count(*) FILTER (WHERE sharpe > 0 AND trades >= 30) AS passed, count(*) FILTER (WHERE NOT is_campaign_root AND status = 'archived') AS archived,
  coalesce(bool_and(status IN ('quick_tested', 'awaiting_review', 'backtesting', 'validating', 'live', 'failed', 'archived')) FILTER (WHERE NOT is_campaign_root), false) AS complete FROM m GROUP BY 1),
b AS (SELECT root_id, string_agg(CAST(id AS VARCHAR), '/' ORDER BY k) AS best_ids FROM (SELECT root_id, id, row_number() OVER (PARTITION BY root_id ORDER BY sharpe DESC, id) AS k FROM m) WHERE k <= 10 GROUP BY 1)
SELECT a.*, best_ids FROM a LEFT JOIN b USING (root_id) WHERE variations > 0""")
def campaign_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rg.campaign_rollup(strategies(spark, sf_dir))
    return c.withColumn("best_ids", F.array_join(F.transform("best_ids", lambda x: x.cast("string")), "/"))


@query("ideas_grouped", f"""WITH {_STRAT} SELECT c_custkey AS idea_id, count(id) AS total, count(*) FILTER (WHERE status IN ('live', 'quick_tested')) AS passed, count(*) FILTER (WHERE status IN ('failed', 'archived')) AS failed,
  count(*) FILTER (WHERE status NOT IN ('live', 'quick_tested', 'failed', 'archived')) AS in_progress, max(sharpe) FILTER (WHERE status IN ('live', 'quick_tested')) AS best_sharpe FROM customer LEFT JOIN strategies ON idea_id = c_custkey GROUP BY 1""")
def ideas_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ideas = table(spark, sf_dir, "customer").selectExpr("c_custkey AS idea_id")
    return rg.ideas_grouped(ideas, strategies(spark, sf_dir), ["live", "quick_tested"], ["failed", "archived"])


@query("strategy_page", f"WITH {_STRAT} SELECT id, status, sharpe FROM strategies ORDER BY sharpe DESC NULLS LAST, id OFFSET 40 LIMIT 20")
def strategy_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strategies(spark, sf_dir).select("id", "status", "sharpe")
    return rg.page(s, [F.col("sharpe").desc_nulls_last(), F.col("id").asc()], 20, 40)


@query("filtered_list", f"""WITH {_STRAT} SELECT id, status, sharpe FROM strategies WHERE status IN ('live', 'quick_tested') AND (sharpe >= 1.0 OR trades <= 5) AND error_log ILIKE '%LEAK%' AND campaign_id IS NOT NULL""")
def filtered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return strategies(spark, sf_dir).where(
        c("status").isin("live", "quick_tested") & ((c("sharpe") >= 1.0) | (c("trades") <= 5)) & c("error_log").ilike("%LEAK%")
        & c("campaign_id").isNotNull()).select("id", "status", "sharpe")


@query("top_knowledge", f"""WITH {_KB}, k AS (SELECT id, category, sharpe_ref, row_number() OVER (PARTITION BY category ORDER BY sharpe_ref DESC, id) AS rank FROM kb)
SELECT id, category, sharpe_ref, rank FROM k WHERE rank <= CASE category WHEN 'fails' THEN 10 ELSE 20 END""")
def top_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = rg.top_per_group(knowledge(spark, sf_dir), ["category"], [F.desc("sharpe_ref"), F.col("id")],
                         {"works": 20, "partial": 20, "fails": 10}, "category")
    return k.select("id", "category", "sharpe_ref", F.col("rank").cast("long"))


@query("knowledge_search", f"WITH {_KB} SELECT id, indicator, category FROM kb WHERE contains(lower(indicator), 'high') OR contains(lower(category), 'work')")
def knowledge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.search(knowledge(spark, sf_dir), ["indicator", "category"], "HIGH").unionByName(
        rg.search(knowledge(spark, sf_dir), ["category"], "work").where("NOT contains(lower(indicator), 'high')")).select("id", "indicator", "category")


@query("indicator_shortlist", f"WITH {_STRAT} SELECT CAST(id AS VARCHAR) AS spec_id, sharpe AS best_sharpe FROM strategies WHERE NOT is_campaign_root AND sharpe >= 0.6 ORDER BY sharpe DESC, CAST(id AS VARCHAR) LIMIT 10")
def indicator_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = strategies(spark, sf_dir).selectExpr("CAST(id AS STRING) AS spec_id", "sharpe AS best_sharpe", "is_campaign_root AS strategy_generated")
    return rg.shortlist(lib).select("spec_id", "best_sharpe")


@query("title_sets", """WITH a AS (SELECT DISTINCT lower(p_name) AS t FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT lower(p_name) AS t FROM part WHERE p_partkey % 3 = 0)
SELECT 'only_first' AS kind, count(*) AS n FROM (SELECT t FROM a EXCEPT SELECT t FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT t FROM a INTERSECT SELECT t FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT t FROM a UNION SELECT t FROM b)""")
def title_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("t"))
    a, b = p.where("p_partkey % 2 = 0").select("t").distinct(), p.where("p_partkey % 3 = 0").select("t").distinct()
    parts = {"only_first": a.exceptAll(b), "both": a.intersect(b), "either": a.unionByName(b).distinct()}
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("metric_cleaning", """SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice / 7 END, 3) AS metric FROM orders""")
def metric_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE o_orderkey % 3 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE o_totalprice / 7 END")
    return table(spark, sf_dir, "orders").select("o_orderkey", finite(raw, 3).alias("metric"))


# --- text -----------------------------------------------------------------------

_SNIPPETS = {
    0: "y = x.shift(-1)\nsc = MinMaxScaler()", 1: "# y = x.shift(-1)\nclass S:\n  def init(self):\n    pass", 2: "z = df.bfill()\nfit = m.fit(self.data.df)",
    3: "class S:\n  def next(self):\n    a = 1\n    b = pandas_ta.rsi(c)", 4: "def next(self):\n  i = np.argmax(v)", 5: "w = x.pct_change( -2)\nq = iloc[i + 1]\n v = d.diff(-1)", 6: "plain",
}


def _chr10(text: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def _scan_sql(src: str, key: str, text: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {_chr10(v)}" for k, v in _SNIPPETS.items())

    def hits(level: str) -> str:
        tests = " + ".join("CAST(regexp_matches(l, '" + p.replace("'", "''") + "', 'i') AS INTEGER)" for p, s in tx.LEAKAGE_RULES if s == level)
        return f"coalesce(list_sum(list_transform(list_filter(string_split(code, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*#')), lambda l: {tests})), 0)"
    return f"""WITH c AS (SELECT {key} AS id, {text} || chr(10) || CASE {key} % 7 {cases} END AS code FROM {src}),
s AS (SELECT id, CAST({hits('critical')} + CASE WHEN NOT contains(code, 'class') AND NOT contains(code, 'def next') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(code, '{tx.CALL_IN_NEXT}') THEN 1 ELSE 0 END AS INTEGER) AS critical,
  CAST({hits('warning')} + CASE WHEN NOT contains(code, 'self.I(') AND contains(code, 'def init') THEN 1 ELSE 0 END AS INTEGER) AS warnings FROM c)
SELECT id, critical, warnings, CAST(round(greatest(0.0, 10 - 2.5 * critical - 0.5 * warnings), 1) AS DOUBLE) AS score, greatest(0.0, 10 - 2.5 * critical - 0.5 * warnings) >= 7 AS passed FROM s"""


def _scan(df: DataFrame, key: str, text: str) -> DataFrame:
    snippet = F.element_at(F.create_map(*[F.lit(x) for kv in _SNIPPETS.items() for x in kv]), (F.col(key) % 7).cast("int"))
    code = df.select(F.col(key).alias("id"), F.concat(F.col(text), F.lit("\n"), snippet).alias("code"))
    return tx.leakage_scan(code, "code").drop("code")


@query("leakage_scan_documents", _scan_sql("documents", "doc_id", "text"))
def leakage_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("leakage_scan_pages", _scan_sql("pages", "page_id", "html"))
def leakage_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(table(spark, sf_dir, "pages"), "page_id", "html")


@query("json_salvage", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 END AS parsed FROM events WHERE event_id % 4 <> 3
UNION ALL SELECT event_id, NULL, 0 FROM events WHERE event_id % 4 = 3""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncated arrays of the events' properties, repaired; rows beyond repair keep a mark."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    raw = (F.when(k == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 1, F.concat(F.lit("["), "props", F.lit(", {\"cut")))
           .when(k == 2, F.concat("props", F.lit(",  "))).otherwise(F.lit("no json at all")))
    v = e.select("event_id", tx.salvage_json_array(raw).alias("v"))
    return v.select("event_id", F.expr("try_variant_get(v, '$[0].k', 'int')").alias("k"), F.when(F.col("v").isNotNull(), 1).otherwise(0).alias("parsed"))


@query("entry_validation", """WITH e AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'works' WHEN 1 THEN 'odd' WHEN 2 THEN NULL WHEN 3 THEN 'edge_case' ELSE '' END AS category, CASE WHEN doc_id % 6 = 0 THEN ' ab  ' ELSE text END AS summary FROM documents)
SELECT doc_id, CASE WHEN category IN ('works', 'fails', 'partial', 'edge_case') THEN category ELSE 'partial' END AS category FROM e WHERE category IS NOT NULL AND category <> '' AND length(trim(summary)) >= 5""")
def entry_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("CASE doc_id % 5 WHEN 0 THEN 'works' WHEN 1 THEN 'odd' WHEN 2 THEN NULL WHEN 3 THEN 'edge_case' ELSE '' END").alias("category"),
        F.when(F.col("doc_id") % 6 == 0, " ab  ").otherwise(F.col("text")).alias("summary"))
    return tx.validate_entries(e).select("doc_id", "category")


_PAPERS = """p AS (SELECT doc_id, source AS title, text AS abstract, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id END AS arxiv_id, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE '' END AS doi, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS VARCHAR) END AS paper_id FROM documents)"""


@query("new_papers", f"""WITH {_PAPERS}, u AS (SELECT doc_id, coalesce('https://arxiv.org/abs/' || arxiv_id, 'https://doi.org/' || nullif(doi, ''), 'https://www.semanticscholar.org/paper/' || paper_id) AS url, md5(abstract) AS digest FROM p WHERE trim(title) <> '' AND length(abstract) >= 50)
SELECT doc_id, url, digest FROM u WHERE url IS NOT NULL AND url NOT IN (SELECT 'https://doi.org/d' || doc_id FROM labels)""")
def new_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id END").alias("arxiv_id"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE '' END").alias("doi"),
        F.expr("CASE WHEN doc_id % 7 <> 0 THEN string(doc_id) END").alias("paper_id"))
    seen = table(spark, sf_dir, "labels").select(F.concat(F.lit("https://doi.org/d"), "doc_id").alias("url"))
    return tx.unseen(tx.paper_rows(d), seen, "url").select("doc_id", "url", F.md5("abstract").alias("digest"))
