"""Search metrics: validation, upserts, click rates and crawl coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagetide.functions.decimals import canonical_position
from pagetide.functions.urls import bare_host, host_of, normalize_url, normalized

MAX_URL = 2_048
SHOWN_ERRORS = 100


def ctr(clicks: Column, impressions: Column) -> Column:
    return F.when(impressions > 0, clicks / impressions).otherwise(0.0)


def ctr_text(clicks: Column, impressions: Column) -> Column:
    return F.format_string("%.2f %%", ctr(clicks, impressions) * 100)


def origin_of(url: Column) -> Column:
    """Scheme, host and port of a normalized address."""
    return F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)


def validated(rows: DataFrame, site_url: str) -> DataFrame:
    """rows (line, page, clicks, impressions, position as text) with normalized_url, clicks_n, impressions_n, position_text, errors (codes, in order).

    An address that comes twice once normalized is an error of its later lines, which name the first. Only rows whose
    address is otherwise sound count as first.
    """
    whole = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))
    trimmed = rows.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("page", "clicks", "impressions", "position")})
    typed = trimmed.withColumns({"normalized_url": normalize_url(F.col("page")), "clicks_n": whole(F.col("clicks")), "impressions_n": whole(F.col("impressions")), "position_text": canonical_position(F.col("position"))})
    own = re.match(r"https?://[^/?#]*", normalized(site_url) or "")
    url = F.col("normalized_url")
    long_url = (F.length("page") > MAX_URL) | url.isNull()
    foreign = origin_of(url) != F.lit(own[0] if own else "")
    sound = (F.col("page") != "") & ~long_url & (F.length(url) <= MAX_URL) & ~foreign
    first = F.min(F.when(sound, F.col("line"))).over(W.partitionBy(F.when(sound, url).otherwise(F.concat(F.lit("\x00"), F.col("line").cast("string")))))
    numbered = typed.withColumn("first_line", F.when(sound, first))
    missing = lambda c: F.col(c) == ""
    errors = F.array_compact(
        F.array(
            F.when(missing("page"), "no page"),
            F.when(missing("clicks"), "no clicks"),
            F.when(missing("impressions"), "no impressions"),
            F.when(~missing("clicks") & F.col("clicks_n").isNull(), "bad clicks"),
            F.when(~missing("impressions") & F.col("impressions_n").isNull(), "bad impressions"),
            F.when(F.col("clicks_n") > F.col("impressions_n"), "clicks over impressions"),
            F.when(~missing("position") & F.col("position_text").isNull(), "bad position"),
            F.when(~missing("page") & long_url, "bad url").when(~missing("page") & (F.length(url) > MAX_URL), "long url").when(~missing("page") & foreign, "other origin").when(F.col("first_line") < F.col("line"), F.concat(F.lit("same url as line "), F.col("first_line").cast("string"))),
        )
    )
    return numbered.withColumn("errors", errors)


def error_report(checked: DataFrame, shown: int = SHOWN_ERRORS) -> DataFrame:
    """line, place, error: the first errors in the order of lines; all of them count, and any of them stops the import."""
    return checked.select("line", F.posexplode("errors").alias("place", "error")).orderBy("line", "place").limit(shown)


def period_errors(start: Column, end: Column, today: Column) -> Column:
    return F.array_compact(F.array(F.when(start.isNull(), "no start"), F.when(end.isNull(), "no end"), F.when(start > today, "start in the future"), F.when(end > today, "end in the future"), F.when(start > end, "start after end")))


def upserted(stored: DataFrame, incoming: DataFrame, key: list[str], values: list[str], stamps: tuple[str, ...] = (), touch_unchanged: bool = True) -> DataFrame:
    """stored after the upsert, with action: added, updated, unchanged, or kept for rows that incoming doesn't have.

    stamps: columns that say who last wrote a row. An unchanged row takes incoming's unless touch_unchanged is off.
    """
    old = stored.select(*key, F.struct(*values, *stamps).alias("old"))
    new = incoming.select(*key, F.struct(*values, *stamps).alias("new"))
    both = new.join(old, key, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old.{v}").eqNullSafe(F.col(f"new.{v}"))
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(same, "unchanged").otherwise("updated")
    take = lambda c, always: F.when(F.col("new").isNull() | (F.lit(not always) & (F.col("action") == "unchanged")), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)
    return both.withColumn("action", action).select(*key, *(take(v, True) for v in values), *(take(s, touch_unchanged) for s in stamps), "action")


def unique_batch(incoming: DataFrame, key: list[str]) -> DataFrame:
    """incoming, or an error if a key comes twice: then the whole batch is refused."""
    n = incoming.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *(F.first(c).alias(c) for c in incoming.columns if c not in key))
    return n.withColumn(key[0], F.when(F.col("__n") > 1, F.raise_error(F.lit("a batch has a key twice")).cast(dict(incoming.dtypes)[key[0]])).otherwise(F.col(key[0]))).drop("__n")


def outcome(upsert: DataFrame) -> DataFrame:
    """row_count, added, updated, unchanged of an upsert."""
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    return upsert.agg(F.count_if(F.col("action") != "kept").alias("row_count"), n("added"), n("updated"), n("unchanged"))


def periods(metrics: DataFrame) -> DataFrame:
    """site_id, period_start, period_end, newest first."""
    return metrics.select("site_id", "period_start", "period_end").distinct().orderBy("site_id", F.desc("period_end"), F.desc("period_start"))


def coverage(metrics: DataFrame, latest_runs: DataFrame, pages: DataFrame, key: str = "site_id") -> DataFrame:
    """metrics with in_crawl: whether the site's latest run has the address; null where the site has no such run."""
    run = latest_runs.select(key, F.col("run_id").alias("latest_run_id"))
    known = pages.select(F.col("run_id").alias("latest_run_id"), F.col("url").alias("normalized_url")).distinct().withColumn("found", F.lit(True))
    joined = metrics.join(run, key, "left").join(known, ["latest_run_id", "normalized_url"], "left")
    return joined.withColumn("in_crawl", F.when(F.col("latest_run_id").isNotNull(), F.coalesce("found", F.lit(False)))).drop("found", "latest_run_id")


def provider_rows(rows: DataFrame, site_url: str) -> DataFrame:
    """metric_date, normalized_url, clicks, impressions, position_text of a service's rows (text values); rows that don't hold are errors."""
    fail = lambda ok, value, message, kind: F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))
    url = normalize_url(F.col("url"))
    own = F.lit(bare_host(normalized(site_url) or ""))
    typed = rows.withColumns({"normalized_url": url, "host": host_of(url)})
    whole = lambda c: F.when(F.col(c).isNull(), F.lit(None).cast("long")).otherwise(fail(F.coalesce(F.col(c).rlike(r"^[0-9]+(\.0*)?$"), F.lit(False)), F.col(c).try_cast("decimal(38,10)").cast("long"), "a count isn't a whole number", "long"))
    out = typed.select(
        fail(F.col("metric_date").isNotNull(), F.col("metric_date"), "a date is missing", "date").alias("metric_date"),
        fail((F.length("url") <= MAX_URL) & (F.col("host") == own), F.col("normalized_url"), "an address belongs to another host", "string").alias("normalized_url"),
        whole("clicks").alias("clicks"),
        whole("impressions").alias("impressions"),
        zero_position(F.col("position")).alias("position_text"),
    )
    return out.withColumn("clicks", fail(F.coalesce(F.col("clicks") <= F.col("impressions"), F.lit(True)), F.col("clicks"), "clicks over impressions", "long"))


@F.pandas_udf(StringType())
def zero_position(values):
    from pagetide.functions.decimals import position

    return values.map(lambda v: position(v, True), na_action="ignore")
