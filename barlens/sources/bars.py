"""Reading, building, checking and writing bars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.functions.core import KEYS
from barlens.operators.blocks import timeframe_seconds

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("timeframe", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

# fixed values: instruments that carry a class prefix
FX_PAIRS = (
    "EURUSD", "GBPUSD", "USDJPY", "AUDUSD", "USDCHF",
    "USDCAD", "NZDUSD", "EURJPY", "GBPJPY", "EURGBP",
    "EURAUD", "GBPAUD", "AUDCAD", "AUDCHF", "AUDJPY",
    "CADJPY", "CHFJPY", "EURCHF", "EURCAD", "GBPCAD",
)
CRYPTO_PAIRS = (
    "BTCUSD", "ETHUSD", "SOLUSD", "ADAUSD", "XRPUSD",
    "DOTUSD", "LINKUSD", "MATICUSD",
)

UNITS = {"m": ("minutes", 60), "h": ("hours", 3600), "d": ("days", 86400), "w": ("weeks", 604800)}
#: The first Monday of the epoch, from which weeks are counted.
MONDAY = 4 * 86400


def width_of(timeframe: str) -> tuple[int, str]:
    """(15, 'm') of '15m', ' 15M ' and the like; anything else is an error."""
    found = re.fullmatch(r"(\d+)([mhdw])", timeframe.strip().lower())
    if not found or int(found[1]) == 0:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return int(found[1]), found[2]


def interval_of(timeframe: str) -> str:
    """'15 minutes' of '15m'."""
    n, unit = width_of(timeframe)
    return f"{n} {UNITS[unit][0]}"


def bucket_start(ts: str, width: str) -> Column:
    """Start of the bar a time falls into, as a plain timestamp; weeks start on Monday."""
    n, unit = width_of(width)
    step, origin = n * UNITS[unit][1], MONDAY if unit == "w" else 0
    return F.timestamp_seconds(F.floor((F.unix_seconds(ts) - origin) / step) * step + origin)


def number(name: str) -> Column:
    """A price or volume as a double; NaN, which Spark orders above all numbers, is a missing value."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars partitioned by timeframe and symbol; filters on those prune folders, and NaN is a missing value."""
    bars = spark.read.schema(BAR_SCHEMA).parquet(path)
    return bars.select(*[number(f.name).alias(f.name) if f.dataType == T.DoubleType() else f.name for f in BAR_SCHEMA])


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per timeframe and symbol, sorted by time for row-group pruning.

    The month keeps a hot series from being written by a single task.
    """
    (
        bars.withColumn("_month", F.date_trunc("month", "ts"))
        .repartition("timeframe", "symbol", "_month")
        .sortWithinPartitions("timeframe", "symbol", "ts")
        .drop("_month")
        .write.mode(mode).partitionBy("timeframe", "symbol").parquet(path)
    )


def normalise_bars(raw: DataFrame, arrival: str | None = None) -> DataFrame:
    """Epoch milliseconds to UTC, doubles, NaN and missing volume 0, last row of a duplicate wins.

    Without ``arrival``, and where arrivals are equal, the larger values win, so one input gives one result.
    A partial aggregation picks the last row, so copies of one bar are reduced
    before the shuffle however many there are.
    """
    values = ["open", "high", "low", "close", "volume"]
    typed = raw.select(
        "symbol", "timeframe", F.timestamp_millis("ts_ms").alias("ts"),
        *[number(c).alias(c) for c in values[:-1]],
        F.coalesce(number("volume"), F.lit(0.0)).alias("volume"),
        *([F.col(arrival).alias("_arrival")] if arrival else [F.lit(0).alias("_arrival")]),
    )
    picked = typed.groupBy(*KEYS, "ts").agg(F.max(F.struct("_arrival", F.struct(*values).alias("bar"))).alias("_last"))
    return picked.select(*KEYS, "ts", "_last.bar.*")


def normalise_symbol(symbol: Column, fx: tuple[str, ...] = FX_PAIRS,
                     crypto: tuple[str, ...] = CRYPTO_PAIRS) -> Column:
    """Upper case without separators, with the class prefix of the instrument."""
    plain = F.regexp_replace(F.upper(symbol), "[/-]", "")
    return (
        F.when(plain.isin(*fx), F.concat(F.lit("C:"), plain))
        .when(plain.isin(*crypto), F.concat(F.lit("X:"), plain))
        .otherwise(plain)
    )


def parse_timeframe(tf: Column) -> Column:
    """'15m' to (15, 'minute'); anything else is an error."""
    plain = F.lower(F.trim(tf))
    amount = F.regexp_extract(plain, r"^(\d+)([mhdw])$", 1)
    unit = F.regexp_extract(plain, r"^(\d+)([mhdw])$", 2)
    name = (
        F.when(unit == "m", "minute").when(unit == "h", "hour").when(unit == "d", "day")
        .when(unit == "w", "week")
        .otherwise(F.raise_error(F.concat(F.lit("unknown timeframe "), tf)).cast("string"))
    )
    return F.struct(amount.try_cast("int").alias("multiplier"), name.alias("span"))


def missing_price() -> Column:
    """Whether any of the four prices is null or NaN."""
    return F.greatest(*[(F.col(c).isNull() | F.isnan(c)) for c in ("open", "high", "low", "close")])


def validate_bars(bars: DataFrame) -> DataFrame:
    """Counts of faulty rows per series.

    Duplicates are counted by a first aggregation on the timestamp, so that no
    task ever holds a whole series.
    """
    per_ts = bars.groupBy(*KEYS, "ts").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("high") < F.col("low")).alias("bad_range"),
        F.count_if(F.col("close") <= 0).alias("bad_close"),
        F.count_if(missing_price()).alias("missing"),
    )
    return per_ts.groupBy(*KEYS).agg(
        F.sum("n").alias("n_rows"),
        F.sum("bad_range").alias("n_high_lt_low"),
        F.sum("bad_close").alias("n_nonpositive_close"),
        F.sum(F.col("n") - 1).alias("n_dup_ts"),
        F.sum("missing").alias("n_missing_price"),
    )


def require_valid(bars: DataFrame) -> DataFrame:
    """The bars, failing at run time on a row with high < low, a close that is not positive, or a missing price."""
    ok = (F.col("high") >= F.col("low")) & (F.col("close") > 0) & ~missing_price()
    return bars.withColumn(
        "close", F.when(ok, F.col("close")).otherwise(F.raise_error(F.lit("faulty bar")).cast("double"))
    )


def date_chunks(ranges: DataFrame, days: int) -> DataFrame:
    """Split each (start_date, end_date) row into pieces of at most ``days`` days."""
    starts = F.explode(F.sequence("start_date", "end_date", F.make_dt_interval(F.lit(days))))
    return ranges.withColumn("chunk_start", starts).withColumn(
        "chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col("end_date"))
    )


def bars_from_ticks(ticks: DataFrame, *, symbol: Column, ts: Column, price: Column, size: Column,
                    width: str, tie: list[Column] | None = None) -> DataFrame:
    """Aggregate ticks into bars of ``width`` ('5m', '2h', '1w' …).

    Map-side combined; a busy symbol or bucket sends one row per task.
    """
    t = ticks.select(
        symbol.alias("symbol"), ts.cast("timestamp").alias("_t"), F.nanvl(price.cast("double"), F.lit(None)).alias("_p"),
        F.nanvl(size.cast("double"), F.lit(None)).alias("_s"), *[c.alias(f"_tie{i}") for i, c in enumerate(tie or [])],
    )
    t = t.where("_p IS NOT NULL")  # a tick without price, null or NaN, makes no bar
    # a plain timestamp keeps the aggregation in hash maps; a struct makes Spark sort
    order = F.struct("_t", *[f"_tie{i}" for i in range(len(tie))]) if tie else F.col("_t")
    return (
        t.groupBy("symbol", bucket_start("_t", width).alias("ts"))
        .agg(
            F.min_by("_p", order).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
            F.max_by("_p", order).alias("close"), F.sum("_s").alias("volume"),
        )
        .select("symbol", F.lit(width.strip().lower()).alias("timeframe"), "ts",
                "open", "high", "low", "close", "volume")
    )


def resample_bars(bars: DataFrame, to: str) -> DataFrame:
    """Bars of a coarser timeframe; bars of several timeframes in one symbol are an error, choose one before."""
    mixed = F.raise_error(F.concat(F.lit("several timeframes of "), F.coalesce("symbol", F.lit("null")))).cast("string")
    return (
        bars.groupBy("symbol", bucket_start("ts", to).alias("_at"))
        .agg(
            F.min("timeframe").alias("_least"), F.max("timeframe").alias("_most"),
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        )
        .select("symbol", F.when(F.col("_least") < F.col("_most"), mixed).otherwise(F.lit(to.strip().lower())).alias("timeframe"), F.col("_at").alias("ts"),
                "open", "high", "low", "close", "volume")
    )


def recent_bars(bars: DataFrame, n: int = 500) -> DataFrame:
    """The last ``n`` bars of each series as one array, rounded for display.

    Ranks only inside time slices first: a slice keeps its own last ``n`` rows, so
    the final ranking sees few rows however long the series is.
    """
    slice_ = F.floor(F.unix_seconds("ts") / (timeframe_seconds(F.col("timeframe")) * 4096))
    inner = Window.partitionBy(*KEYS, "_slice").orderBy(F.desc("ts"))
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    sliced = bars.withColumn("_slice", slice_)
    counts = (
        sliced.groupBy(*KEYS, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_newer", F.coalesce(F.sum("_n").over(newest), F.lit(0)))
        .where(F.col("_newer") < n)
    )
    picked = (
        sliced.join(counts, [*KEYS, "_slice"])
        .withColumn("_rank", F.row_number().over(inner) + F.col("_newer"))
        .where(F.col("_rank") <= n)
    )
    bar = F.struct(
        F.col("ts").alias("t"), *[F.round(c, 5).alias(c[0]) for c in ("open", "high", "low", "close")],
        F.round("volume", 2).alias("v"),
    )
    return picked.groupBy(*KEYS).agg(F.array_sort(F.collect_list(bar)).alias("recent"))
