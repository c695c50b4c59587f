"""Keeping and summarising the result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.session import materialise

TERMINAL = ("quick_tested", "awaiting_review", "backtesting", "validating", "live", "failed", "archived")
FAN_OUT_SYMBOLS = ("EURUSD", "GBPUSD", "USDJPY", "AUDUSD", "USDCAD", "NZDUSD")

# fixed values: phrases that classify an error text, looked for in this order
QUALITY_PHRASES = (
    "leakage check failed",
    "oos degradation",
    "walk-forward",
    "overfitting detected",
    "sharpe",
    "calmar",
    "unprofitable in recent",
    "correction limit reached",
    "corrections_applied",
    "not consistently profitable",
    "mean oos sharpe",
    "curve-fitted",
    "below minimum",
    "multi-timeframe validation failed",
)
INFRASTRUCTURE_PHRASES = (
    "no module named 'db'",
    "no module named 'agents'",
    "no module named 'backtest'",
    "no module named 'backtesting'",
    "timeouterror",
    "memoryerror",
    "sigkill",
    "killed",
    "container exited",
)
CODE_BUG_PATTERNS = (
    r"SyntaxError",
    r"IndentationError",
    r"NameError",
    r"AttributeError",
    r"TypeError",
    r"ImportError",
    r"ModuleNotFoundError",
    r"ValueError",
    r"KeyError",
    r"ZeroDivisionError",
    r"in <strategy>",
    r"No Strategy subclass found",
    r"strategy_classes",
    r"exec\(",
    r"compile\(",
    r"zero trades on all timeframes",
    r"0 trades on all timeframes",
    r"zero signals",
    r"Zero trades on ALL",
    r"Too few trades: 0 ",
    r"zero_trades_all_timeframes",
)


def upsert(base: DataFrame, updates: DataFrame, *, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of both tables, the highest version per key; an update wins a tie.

    A partial aggregation: many versions of one key shrink before the shuffle.
    """
    values = [c for c in base.columns if c not in keys]
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(version, "_new", F.to_json(F.struct(*values)))).alias("_row"))
    return picked.select(*keys, "_row.*").select(*base.columns)


def upsert_path(updates: DataFrame, path: str, *, keys: Sequence[str], version: str, partition: Sequence[str]) -> None:
    """Merge into a Parquet table, rewriting only the partitions the updates touch."""
    spark = updates.sparkSession
    base = spark.read.schema(updates.schema).parquet(path)
    touched = updates.select(*partition).distinct()
    merged = materialise(upsert(base.join(touched, list(partition), "left_semi"), updates, keys=keys, version=version), "upsert")
    (merged.repartition(*partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition).parquet(path))


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key (case-insensitive text) the table does not have, one per key."""
    k = F.lower(F.trim(key))
    fresh = rows.withColumn("_k", k).join(table.select(k.alias("_k")).distinct(), "_k", "left_anti")
    first = fresh.groupBy("_k").agg(F.min(F.struct(*[F.col(c) for c in rows.columns])).alias("_row"))
    return first.select("_row.*")


def cascade_delete(children: DataFrame, parents: DataFrame, fk: str, key: str) -> DataFrame:
    """Children whose parent still exists (or that have none)."""
    kept = children.where(F.col(fk).isNotNull()).join(parents.select(F.col(key).alias(fk)), fk, "left_semi")
    return kept.select(*children.columns).unionByName(children.where(F.col(fk).isNull()))


def cascade_null(children: DataFrame, parents: DataFrame, fk: str, key: str) -> DataFrame:
    """Children with the reference emptied where the parent is gone."""
    known = parents.select(F.col(key).alias(fk), F.lit(True).alias("_known")).distinct()
    return children.join(known, fk, "left").withColumn(fk, F.when(F.col("_known"), F.col(fk))).select(*children.columns)


def transitions(table: DataFrame, rules: Sequence[tuple[Column, str, str]], *, key: str, status: str = "status",
                carry: Sequence[Column] = ()) -> DataFrame:
    """Status changes by the first rule (test, new status, reason) that holds."""
    new, why = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, target, reason in reversed(rules):
        new = F.when(test, target).otherwise(new)
        why = F.when(test, reason).otherwise(why)
    return table.select(key, F.col(status).alias("old"), new.alias("new"), why.alias("reason"), *carry).where("new IS NOT NULL")


def older_than(column: str, as_of: str, minutes: int) -> Column:
    """Whether a time lies so long before ``as_of``; a missing time does."""
    return F.col(column).isNull() | (F.col(column) < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def stale_rules(as_of: str) -> list[tuple[Column, str, str]]:
    """Jobs that ran past their limit, and failed ones that may try again.

    A test counts as stuck only while it holds a ``job_id``; without one it was never sent off.
    """
    s = F.col("status")
    sent = F.col("job_id").isNotNull()
    return [
        ((s == "running") & older_than("updated_at", as_of, 35), "failed", "research timed out"),
        ((s == "backtesting") & sent & older_than("updated_at", as_of, 52), "failed", "backtest timed out"),
        ((s == "quick_testing") & sent & older_than("updated_at", as_of, 20), "failed", "quick test timed out"),
        ((s == "failed") & (F.coalesce("retry_count", F.lit(0)) < 3) & older_than("updated_at", as_of, 15), "pending", "retry"),
    ]


def stale_jobs(table: DataFrame, as_of: str, *, key: str) -> DataFrame:
    """The stale transitions with the columns they set: a retry raises ``retry_count``, every one clears ``job_id``."""
    tries = F.coalesce("retry_count", F.lit(0)).cast("long")
    changed = transitions(table, stale_rules(as_of), key=key, carry=[tries.alias("_tries")])
    return changed.select(key, "old", "new", "reason", (F.col("_tries") + F.when(F.col("new") == "pending", 1).otherwise(0)).alias("retry_count"),
                          F.lit(None).cast("string").alias("job_id"))


def classify_error(text: Column) -> Column:
    """'quality_rejection', 'infrastructure', 'code_bug' or 'unknown' by the first list that matches."""
    low = F.lower(text)

    def any_of(phrases: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))

    bug = text.rlike("|".join(CODE_BUG_PATTERNS))
    return (
        F.when(text.isNull() | (text == ""), "unknown").when(F.contains(low, F.lit("optimization_regression")), "code_bug")
        .when(any_of(QUALITY_PHRASES), "quality_rejection").when(any_of(INFRASTRUCTURE_PHRASES), "infrastructure")
        .when(bug, "code_bug").otherwise("unknown"))


def archive_rules(as_of: str, max_retries: int = 3) -> list[tuple[Column, str, str]]:
    old = (F.col("status") == "failed") & older_than("updated_at", as_of, 24 * 60)
    return [
        (old & (classify_error(F.col("error_log")) == "quality_rejection"), "archived", "quality rejection"),
        (old & ~F.col("has_code"), "archived", "no code to fix"),
        (old & (F.col("retry_count") >= max_retries), "archived", "retry limit"),
    ]


def weak_variation(sharpe: Column, trades: Column) -> Column:
    return (F.coalesce(sharpe, F.lit(0.0)) < 0) & (F.coalesce(trades, F.lit(0)) < 30)


def promising(by_timeframe: Column) -> Column:
    """Any timeframe with at least ten trades and a Sharpe of 0.3."""
    return F.exists(F.map_values(by_timeframe), lambda m: (m["trades"] >= 10) & (m["sharpe"] >= 0.3))


def fan_out(tasks: DataFrame, symbols: Sequence[str] = FAN_OUT_SYMBOLS, batch: int | None = None) -> DataFrame:
    """Copies of finished tasks that name a symbol and a timeframe for the other symbols; ``batch``, where given, is the number made per cycle."""
    todo = tasks.where("status = 'done' AND NOT coalesce(fanned_out, false) AND parent_task_id IS NULL AND symbol IS NOT NULL AND timeframe IS NOT NULL")
    copies = todo.withColumn("new_symbol", F.explode(F.array(*[F.lit(s) for s in symbols]))).where("new_symbol <> symbol")
    title = F.when(F.contains("title", "symbol"), F.replace("title", "symbol", "new_symbol")).otherwise(
        F.concat("title", F.lit(" — "), "new_symbol"))
    order = F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col("new_symbol"))
    rows = copies.select(
        F.col("id").alias("parent_task_id"), order.alias("_order"), F.col("new_symbol").alias("symbol"), "timeframe", title.alias("title"),
        F.replace("question", "symbol", "new_symbol").alias("question"), F.lit("pending").alias("status"))
    if batch is None:
        return rows.drop("_order")
    return rows.orderBy("parent_task_id", "_order").limit(batch).drop("_order")


def status_counts(table: DataFrame, groups: Sequence[str], buckets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows per group in total and per bucket of statuses."""
    return table.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status").isin(*states)).alias(name) for name, states in buckets.items()])


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: Mapping[str, tuple[float, float]],
               default: tuple[float, float] = (0.003, 0.015)) -> Column:
    """Cost from prices per thousand tokens."""
    pin, pout = F.lit(default[0]), F.lit(default[1])
    for name, (a, b) in prices.items():
        pin, pout = F.when(model == name, a).otherwise(pin), F.when(model == name, b).otherwise(pout)
    return (tokens_in * pin + tokens_out * pout) / 1000


def daily_spend(log: DataFrame, cap: float) -> DataFrame:
    """Cost per day and what is left of the cap."""
    return log.groupBy("date").agg(F.sum("cost_usd").alias("spent")).withColumn(
        "remaining", F.greatest(F.lit(0.0), F.lit(cap) - F.col("spent")))


def knowledge_rollup(entries: DataFrame) -> DataFrame:
    """Per base indicator: variants, best and worst Sharpe, categories and timeframes seen.

    The first aggregation is over the distinct pairs, so a popular indicator is
    counted down before its lists are joined.
    """
    base = F.trim(F.split_part(F.coalesce("indicator", F.lit("unknown")), F.lit("+"), F.lit(1)))
    cells = entries.groupBy(base.alias("indicator"), "category", "timeframe").agg(
        F.count(F.lit(1)).alias("n"), F.max("sharpe_ref").alias("hi"), F.min("sharpe_ref").alias("lo"))
    return cells.groupBy("indicator").agg(
        F.sum("n").alias("n"), F.max("hi").alias("best_sharpe"), F.min("lo").alias("worst_sharpe"),
        F.array_join(F.array_sort(F.collect_set("category")), "/").alias("categories"),
        F.array_join(F.array_sort(F.collect_set("timeframe")), "/").alias("timeframes"))


def campaign_rollup(strategies: DataFrame, top: int = 10) -> DataFrame:
    """Per campaign root: variations, passed, archived, whether all are through, and the best by Sharpe."""
    ok = (F.coalesce("sharpe", F.lit(0.0)) > 0) & (F.coalesce("trades", F.lit(0)) >= 30)
    root = F.when(F.col("is_campaign_root"), F.col("id")).otherwise(F.col("campaign_id"))
    members = strategies.withColumn("root_id", root).where("root_id IS NOT NULL")
    child = ~F.col("is_campaign_root")
    agg = members.groupBy("root_id").agg(
        F.count_if(child).alias("variations"), F.count_if(ok & F.col("sharpe").isNotNull()).alias("passed"),
        F.count_if(child & (F.col("status") == "archived")).alias("archived"),
        F.coalesce(F.bool_and(F.when(child, F.col("status").isin(*TERMINAL))), F.lit(False)).alias("complete"))
    w = Window.partitionBy("root_id").orderBy(F.desc("sharpe"), "id")
    best = (members.where("sharpe IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
            .groupBy("root_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("best_ids")))
    return agg.where("variations > 0").join(best, "root_id", "left")


def ideas_grouped(ideas: DataFrame, strategies: DataFrame, passed: Sequence[str], failed: Sequence[str]) -> DataFrame:
    """Per idea how its strategies fare; strategies are counted before the join."""
    s = F.col("status")
    per = strategies.groupBy("idea_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s.isin(*passed)).alias("passed"), F.count_if(s.isin(*failed)).alias("failed"),
        F.count_if(~s.isin(*passed, *failed)).alias("in_progress"), F.max(F.when(s.isin(*passed), F.col("sharpe"))).alias("best_sharpe"))
    return ideas.join(per, "idea_id", "left").na.fill(0, ["total", "passed", "failed", "in_progress"])


def dependencies_done(strategies: DataFrame, tasks: DataFrame) -> DataFrame:
    """For every strategy: whether all its known tasks are done or failed, how many are done, and what follows.

    ``next`` is 'filtered' for a strategy that names no task, or none that is still there,
    'ready' when all are finished, else null: it goes on waiting.
    """
    pairs = strategies.select("id", F.explode_outer("pending_ids").alias("task_id"))
    known = tasks.select(F.col("id").alias("task_id"), F.coalesce("status", F.lit("")).alias("task_status"))
    per = pairs.join(known, "task_id", "left").groupBy("id").agg(
        F.coalesce(F.bool_and(F.col("task_status").isin("done", "failed")), F.lit(False)).alias("all_done"),
        F.count_if(F.col("task_status") == "done").alias("n_done"), F.count("task_status").alias("n_tasks"))
    return per.withColumn("next", F.when(F.col("n_tasks") == 0, "filtered").when(F.col("all_done"), "ready"))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: Mapping[str, int] | int, key: str | None = None) -> DataFrame:
    """First rows of each group; ``k`` may differ by the value of ``key``."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    if isinstance(k, int):
        return ranked.where(F.col("rank") <= k)
    most = max(k.values())
    limit = F.lit(0)
    for value, n in k.items():
        limit = F.when(F.col(key) == value, n).otherwise(limit)
    return ranked.where(F.col("rank") <= most).where(F.col("rank") <= limit)


def shortlist(indicators: DataFrame, min_sharpe: float = 0.6, top: int = 10) -> DataFrame:
    return (indicators.where(~F.col("strategy_generated") & (F.col("best_sharpe") >= min_sharpe))
            .orderBy(F.col("best_sharpe").desc_nulls_last(), "spec_id").limit(top))


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows in which any of the columns contains the text, ignoring case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return df.where(hit)
