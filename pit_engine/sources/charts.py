"""Price-chart JSON and HTML lists, parsed by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHART = (
    "struct<chart:struct<result:array<struct<meta:struct<symbol:string,exchangeTimezoneName:string>,timestamp:array<bigint>,"
    "events:struct<dividends:map<string,struct<amount:double,date:bigint>>,splits:map<string,struct<date:bigint,numerator:double,denominator:double>>>,"
    "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>,adjclose:array<struct<adjclose:array<double>>>>>>>>"
)


def attribute_values(html: Column, tag: str, attribute: str) -> Column:
    """All values of an attribute that directly follows the tag's name."""
    return F.regexp_extract_all(html, F.lit(f'<{tag} {attribute}="([^"]*)">'), F.lit(1))


def parse_charts(raw: DataFrame, content: str = "value") -> DataFrame:
    """ticker, date (exchange's day), open, high, low, close, adjusted_close, volume: one row per bar."""
    r = raw.select(F.explode(F.from_json(content, CHART)["chart"]["result"]).alias("r"))
    q, zone = F.col("r.indicators.quote")[0], F.col("r.meta.exchangeTimezoneName")
    z = F.arrays_zip(F.col("r.timestamp").alias("ts"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("adjusted_close"), q["volume"].alias("volume"))
    bars = r.select(F.col("r.meta.symbol").alias("ticker"), zone.alias("zone"), F.explode(z).alias("b"))
    return bars.select("ticker", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("b.ts"), F.col("zone"))).alias("date"), "b.open", "b.high", "b.low", "b.close", "b.adjusted_close", "b.volume")


def parse_actions(raw: DataFrame, content: str = "value") -> DataFrame:
    """ticker, date, cash_distribution, split_new_per_old from the chart's events."""
    r = raw.select(F.explode(F.from_json(content, CHART)["chart"]["result"]).alias("r"))
    zone = F.col("r.meta.exchangeTimezoneName")
    day = lambda ts: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts), F.col("zone")))
    cash = r.select(F.col("r.meta.symbol").alias("ticker"), zone.alias("zone"), F.explode(F.map_values("r.events.dividends")).alias("e")).select("ticker", day(F.col("e.date")).alias("date"), F.col("e.amount").alias("cash_distribution"), F.lit(None).cast("double").alias("split_new_per_old"))
    split = r.select(F.col("r.meta.symbol").alias("ticker"), zone.alias("zone"), F.explode(F.map_values("r.events.splits")).alias("e")).select("ticker", day(F.col("e.date")).alias("date"), F.lit(None).cast("double").alias("cash_distribution"), (F.col("e.numerator") / F.col("e.denominator")).alias("split_new_per_old"))
    return cash.unionByName(split).groupBy("ticker", "date").agg(F.sum("cash_distribution").alias("cash_distribution"), F.product("split_new_per_old").alias("split_new_per_old"))


def fill_latest_bar(bars: DataFrame, recovered: DataFrame) -> DataFrame:
    """The bars, plus from a second response only bars later than each ticker's last one."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("_last"))
    more = recovered.join(last, "ticker").where(F.col("date") > F.col("_last")).drop("_last")
    return bars.unionByName(more)
