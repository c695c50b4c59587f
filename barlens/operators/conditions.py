"""The market conditions: one boolean column each, all from one blocked pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from barlens.functions.core import KEYS
from barlens.operators import indicators as ind
from barlens.operators.blocks import Step, compute, lag_sql, rolling_sql, sql_columns
from barlens.operators.recurrence import ewm, span_alpha, wilder_alpha


@dataclass(frozen=True)
class Condition:
    condition_id: str
    category: str
    rule: str  # SQL over the columns that ``inputs`` makes


# rules are read as SQL expressions; c1, o1 … are earlier bars. RSI rises or falls only with the close: both averages shrink
# alike on an unchanged close, and the rounding of their quotient is no direction
CONDITIONS: tuple[Condition, ...] = tuple(
    Condition(name, category, rule)
    for category, rules in {
        "candle": {
            "prev_candle_bullish": "c1 > o1",
            "prev_candle_bearish": "c1 < o1",
            "prev_candle_bull_large": "c1 > o1 AND c1 - o1 > atr14",
            "prev_candle_bear_large": "c1 < o1 AND o1 - c1 > atr14",
            "prev_2_bullish": "c1 > o1 AND c2 > o2",
            "prev_2_bearish": "c1 < o1 AND c2 < o2",
            "prev_3_bullish": "c1 > o1 AND c2 > o2 AND c3 > o3",
            "prev_3_bearish": "c1 < o1 AND c2 < o2 AND c3 < o3",
            "close_near_high": "coalesce((close - low) / nullif(high - low, 0), 0.5D) >= 0.75D",
            "close_near_low": "coalesce((close - low) / nullif(high - low, 0), 0.5D) <= 0.25D",
            "inside_bar": "high < h1 AND low > l1",
            "doji": "abs(close - open) < 0.1D * nullif(high - low, 0)",
            "large_body": "abs(close - open) > 0.7D * nullif(high - low, 0)",
            "new_5bar_high": "close >= max5",
            "new_5bar_low": "close <= min5",
            "new_20bar_high": "close >= max20",
            "new_20bar_low": "close <= min20",
            "gap_up": "open - c1 > 0.1D * atr14",
            "gap_down": "c1 - open > 0.1D * atr14",
        },
        "ema": {
            "above_ema20": "close > ema20",
            "below_ema20": "close < ema20",
            "above_ema50": "close > ema50",
            "below_ema50": "close < ema50",
            "above_ema200": "close > ema200",
            "below_ema200": "close < ema200",
            "ema20_above_ema50": "ema20 > ema50",
            "ema20_below_ema50": "ema20 < ema50",
            "cross_ema20_up": "close > ema20 AND c1 <= ema20_1",
            "cross_ema20_dn": "close < ema20 AND c1 >= ema20_1",
            "far_above_ema50": "close - ema50 > 1.5D * atr14",
            "far_below_ema50": "ema50 - close > 1.5D * atr14",
            "near_ema50": "abs(close - ema50) < 0.3D * atr14",
        },
        "session": {
            "session_asian": "hour(ts) < 7",
            "session_london": "hour(ts) >= 7 AND hour(ts) < 13",
            "session_overlap": "hour(ts) >= 13 AND hour(ts) < 17",
            "session_ny": "hour(ts) >= 13 AND hour(ts) < 22",
            "hour_10_12": "hour(ts) IN (10, 11)",
            "hour_13_15": "hour(ts) IN (13, 14)",
            "hour_18_22": "hour(ts) IN (18, 19, 20, 21)",
            "weekday_monday": "weekday(ts) = 0",
            "weekday_tuesday": "weekday(ts) = 1",
            "weekday_wednesday": "weekday(ts) = 2",
            "weekday_thursday": "weekday(ts) = 3",
            "weekday_friday": "weekday(ts) = 4",
            "weekday_mid": "weekday(ts) IN (1, 2, 3)",
            "month_end": "day(ts) >= day(last_day(ts)) - 2",
            "month_start": "day(ts) <= 3",
        },
        "volatility": {
            "high_atr": "atr14 > atr_q75",
            "low_atr": "atr14 < atr_q25",
            "above_bb_upper": "close > bb_upper",
            "below_bb_lower": "close < bb_lower",
            "inside_bb": "close <= bb_upper AND close >= bb_lower",
            "bb_squeeze": "bb_width < bbw_q25",
            "bb_expansion": "bb_width > bbw_q75",
        },
        "momentum": {
            "rsi_oversold": "rsi14 < 30",
            "rsi_overbought": "rsi14 > 70",
            "rsi_mid_bull": "rsi14 >= 45 AND rsi14 <= 55 AND rsi14 > rsi14_1 AND close > c1",
            "rsi_mid_bear": "rsi14 >= 45 AND rsi14 <= 55 AND rsi14 < rsi14_1 AND close < c1",
            "rsi_above_50": "rsi14 > 50",
            "rsi_below_50": "rsi14 < 50",
            "rsi_cross_50_up": "rsi14 > 50 AND rsi14_1 <= 50",
            "rsi_cross_50_dn": "rsi14 < 50 AND rsi14_1 >= 50",
            "bb_lower_rsi_oversold": "close < bb_lower AND rsi14 < 30",
            "bb_upper_rsi_overbought": "close > bb_upper AND rsi14 > 70",
            "bb_lower_rsi_mid": "close < bb_lower AND rsi14 >= 30 AND rsi14 <= 50",
        },
    }.items()
    for name, rule in rules.items()
)
BY_ID = {x.condition_id: x for x in CONDITIONS}


def inputs() -> list[Step]:
    """Every column the rules name, each computed once."""
    lags = {
        **{f"c{k}": lag_sql("close", k) for k in (1, 2, 3)}, **{f"o{k}": lag_sql("open", k) for k in (1, 2, 3)},
        "h1": lag_sql("high"), "l1": lag_sql("low"),
    }
    extremes = {f"{f}{n}": rolling_sql(f"{f}(close)", "close", n) for f in ("max", "min") for n in (5, 20)}
    return [
        sql_columns([], lags, before=3), sql_columns([], extremes, before=20),
        ind.true_range("tr"), ind.rsi_inputs(),
        ewm([
            ("ema20", "close", span_alpha(20)), ("ema50", "close", span_alpha(50)),
            ("ema200", "close", span_alpha(200)), ("atr14", "tr", wilder_alpha(14)),
            ("gain14", "gain", wilder_alpha(14)), ("loss14", "loss", wilder_alpha(14)),
        ]),
        ind.rsi_value("rsi14", "gain14", "loss14"),
        ind.bollinger(20, 2.0),
        sql_columns(["rsi14", "ema20"], {"rsi14_1": lag_sql("rsi14"), "ema20_1": lag_sql("ema20")}, before=1),
        ind.rolling_quantiles({"atr_q25": 0.25, "atr_q75": 0.75}, "atr14"),
        ind.rolling_quantiles({"bbw_q25": 0.25, "bbw_q75": 0.75}, "bb_width"),
    ]


def check_ids(ids: list[str] | None) -> list[str]:
    chosen = [x.condition_id for x in CONDITIONS] if ids is None else list(ids)
    unknown = [i for i in chosen if i not in BY_ID]
    if unknown:
        raise ValueError(f"unknown conditions: {unknown}")
    return chosen


def rule(condition_id: str) -> str:
    """The rule as SQL; a comparison with a missing value is false."""
    return f"coalesce({BY_ID[condition_id].rule}, false)"


def with_conditions(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.selectExpr("*", *[f"{rule(i)} AS {i}" for i in ids])


def conditions_wide(bars: DataFrame, ids: list[str] | None = None, **layout: int) -> DataFrame:
    """Bars plus one boolean column per condition; indicators that no rule needs are pruned."""
    chosen = check_ids(ids)
    step = Step((), (), lambda df: with_conditions(df, chosen).select(
        *bars.columns, *chosen, *[x for x in df.columns if x.startswith("_")]))
    return compute(bars, [*inputs(), step], **layout)


def conditions_long(bars: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """(symbol, timeframe, ts, condition_id, hit)."""
    chosen = check_ids(ids)
    wide = conditions_wide(bars, chosen).select(*KEYS, "ts", *chosen)
    return wide.unpivot([*KEYS, "ts"], chosen, "condition_id", "hit")


def condition_catalogue(spark) -> DataFrame:
    rows = [(x.condition_id, x.category, x.rule) for x in CONDITIONS]
    return spark.createDataFrame(rows, "condition_id string, category string, rule string")
