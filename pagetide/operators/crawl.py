"""What landed responses and robots.txt files mean for a crawl."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HTML_BYTES = 2 * 1024 * 1024


def page_outcome(status: Column, failure: Column, content_type: Column, declared_bytes: Column, body_bytes: Column, parsed: Column) -> Column:
    """The outcome of a page's request. failure: timeout, network_error or null; parsed: whether its html could be read."""
    media = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    large = (F.coalesce(declared_bytes, F.lit(0)) > MAX_HTML_BYTES) | (F.coalesce(body_bytes, F.lit(0)) > MAX_HTML_BYTES)
    return (
        F.when(failure.isNotNull(), failure)
        .when(status.between(300, 399), "redirect")
        .when(~F.coalesce(status.between(200, 299), F.lit(False)), "http_error")
        .when(~media.isin("text/html", "application/xhtml+xml"), "non_html")
        .when(large, "oversized")
        .when(~F.coalesce(parsed, F.lit(False)), "parse_error")
        .otherwise("html")
    )


def robots_status(status: Column, failure: Column) -> Column:
    """What a site's robots.txt says of its crawl as a whole: completed lets it begin, everything else puts it off."""
    return (
        F.when(failure == "timeout", "robots_timeout")
        .when(failure.isNotNull(), "robots_network_error")
        .when(status.between(300, 399), "robots_redirect")
        .when((status == 404) | status.between(200, 299), "completed")
        .otherwise("robots_deferred")
    )


#: Characters of robots.txt files that are sent to all workers together.
SENT_RULES = 32 << 20


def allowed(pages: DataFrame, robots: DataFrame, user_agent: str) -> DataFrame:
    """pages (site_id, url) with allowed. robots: site_id, status, body; a site with 404 or no row allows everything.

    Rules of up to SENT_RULES characters in all are sent to each worker once, and pages move nowhere. Beyond that the rules
    are joined to the pages, with which they then travel.
    """
    spark = pages.sparkSession
    rules = robots.where(F.coalesce(F.col("status") != 404, F.lit(True)) & F.col("body").isNotNull()).select("site_id", F.col("body").alias("__rules"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields) + ", allowed boolean"
    columns = pages.columns
    size = rules.agg(F.sum(F.length("__rules") + 50)).first()[0] or 0
    sent = spark.sparkContext.broadcast({r["site_id"]: r["__rules"] for r in rules.collect()}) if size <= SENT_RULES else None
    joined = pages if sent else pages.join(rules, "site_id", "left").select(*columns, "__rules")

    def of(frames):
        known: dict[str, RobotFileParser] = {}
        for f in frames:
            texts = [sent.value.get(s) for s in f["site_id"]] if sent else f["__rules"]
            out = []
            for url, text in zip(f["url"], texts, strict=True):
                if text is None or pd.isna(text):
                    out.append(True)
                    continue
                if text not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[text] = RobotFileParser()
                    known[text].parse(text.splitlines())
                out.append(url is not None and known[text].can_fetch(user_agent, url))
            yield f[columns].assign(allowed=out)

    return joined.mapInPandas(of, schema)


def encoded_links(links: Column) -> Column:
    return F.to_json(links)


def decoded_links(text: Column) -> Column:
    """An array of strings from its JSON text. No JSON, another kind of JSON and an element that isn't a string are three errors."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    fail = lambda m: F.raise_error(F.lit(m)).cast("array<string>")
    return (
        F.when(text.isNull(), F.lit(None).cast("array<string>"))
        .when(value.isNull(), fail("links aren't JSON"))
        .when(~kind.startswith("ARRAY<"), fail("links aren't an array"))
        .when(~kind.isin("ARRAY<STRING>", "ARRAY<VOID>") | text.rlike(r"^\s*\[\s*null|,\s*null\s*[,\]]"), fail("a link isn't a string"))
        .otherwise(F.from_json(text, "array<string>"))
    )
