"""Landed responses of search-metric services, as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "rows array<struct<keys: array<string>, clicks: string, impressions: string, position: string>>"
NESTED = "count int, text_indicator_to_statistics array<struct<text_indicator: struct<type: string, value: string>, statistics: array<struct<date: string, field: string, value: string>>>>"
FIELDS = ("CLICKS", "IMPRESSIONS", "POSITION", "CTR")
MAX_PAYLOAD_BYTES = 2 * 1024 * 1024
ROW_CAP = 10_000


def require(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def row_payload(landed: DataFrame, payload_col: str = "payload") -> DataFrame:
    """metric_date, url, clicks, impressions, position of payloads whose rows are keyed by date and address."""
    fits = F.octet_length(payload_col) <= MAX_PAYLOAD_BYTES
    body = F.from_json(require(fits, F.col(payload_col), "a payload is over 2 MiB"), ROWS, {"mode": "FAILFAST"})
    rows = landed.select(F.explode(body["rows"]).alias("r"))
    return rows.select(F.to_date(F.col("r.keys")[0]).alias("metric_date"), F.col("r.keys")[1].alias("url"), "r.clicks", "r.impressions", "r.position")


def nested_statistics(landed: DataFrame, payload_col: str = "payload") -> DataFrame:
    """metric_date, url, field, value of payloads that nest statistics below each address."""
    fits = F.octet_length(payload_col) <= MAX_PAYLOAD_BYTES
    body = F.from_json(require(fits, F.col(payload_col), "a payload is over 2 MiB"), NESTED, {"mode": "FAILFAST"})
    items = landed.select(F.explode(body["text_indicator_to_statistics"]).alias("i")).select(require(F.col("i.text_indicator.type") == "URL", F.col("i.text_indicator.value"), "an indicator isn't an address").alias("url"), F.explode("i.statistics").alias("s"))
    return items.select(F.to_date("s.date").alias("metric_date"), "url", require(F.col("s.field").isin(*FIELDS), F.col("s.field"), "an unknown statistic").alias("field"), F.col("s.value").alias("value"))


def pivoted(statistics: DataFrame) -> DataFrame:
    """metric_date, url, clicks, impressions, position. A field that comes twice for a date and address is an error."""
    once = statistics.groupBy("metric_date", "url", "field").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("v"))
    value = F.when(F.col("n") > 1, F.raise_error(F.lit("a statistic comes twice")).cast("string")).otherwise(F.col("v"))
    pick = lambda name: F.max(F.when(F.col("field") == name, F.col("value"))).alias(name.lower())
    return once.select("metric_date", "url", "field", value.alias("value")).groupBy("metric_date", "url").agg(*(pick(f) for f in FIELDS[:3]))


def capped(rows: DataFrame, cap: int = ROW_CAP) -> tuple[DataFrame, Column]:
    """A sync takes at most cap rows in order of date and address and is partial if there are more. The cap is the services' own limit."""
    return rows.orderBy("metric_date", "url").limit(cap), F.lit(rows.limit(cap + 1).count() > cap)
