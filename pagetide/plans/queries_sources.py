"""Queries of the sources, addresses and imports, over texts that are made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.functions import titles
from pagetide.functions.decimals import canonical_position
from pagetide.functions.text import normalize_readable_text
from pagetide.functions.urls import external_url, host_of, normalize_url
from pagetide.operators import crawl, diff, metrics
from pagetide.operators import runs as run_ops
from pagetide.plans import bindings as b
from pagetide.plans.registry import FOLDED, query
from pagetide.plans.storage import shared_dir
from pagetide.sources import csv_pages, landed, payloads
from pagetide.sources.pages import extract_pages

def eid():
    return F.col("event_id")


def unescaped(text: str) -> str:
    """SQL: the character references that the driver's pages use."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{sign}')"
    return text


PARTS = rf"""WITH p AS (SELECT page_id, url, html, regexp_extract(html, '<title>(.*?)</title>', 1) AS t, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS home,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<body>(.*)$', 1, 's'), '<!--.*?-->', '', 'g'), '<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'gs'), '<br>', '', 'g'), '<[^>]*>', ' ', 'g') AS body,
regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)"""


@query(rf"""{PARTS}, x AS (SELECT page_id, {unescaped("t")} AS title, {unescaped("h")} AS h1, {unescaped("body")} AS text FROM p)
SELECT page_id, trim(regexp_replace(nfc_normalize(title), '\s+', ' ', 'g')) AS title, CAST(NULL AS VARCHAR) AS description, trim(regexp_replace(nfc_normalize(h1), '\s+', ' ', 'g')) AS h1, {FOLDED} AS normalized_text, sha256({FOLDED}) AS content_hash, CAST(0 AS BIGINT) AS n_prices FROM x""")
def page_fields(spark, sf_dir):
    """What extract_page reads of each page, but its links; lists as counts."""
    out = extract_pages(b.table(spark, sf_dir, "pages"), max_bytes=None)
    return out.select("page_id", "title", "description", "h1", "normalized_text", "content_hash", F.size("prices").cast("long").alias("n_prices"))


@query(rf"""{PARTS}, x AS (SELECT page_id, url, home, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS k FROM p),
y AS (SELECT page_id, k, home || {unescaped("href")} AS link, regexp_replace(url, '#.*', '') AS own FROM x),
z AS (SELECT page_id, link, min(k) AS k FROM y WHERE link <> own GROUP BY 1, 2)
SELECT p.page_id, coalesce(string_agg(link, ' ' ORDER BY k), '') AS links, count(link) > 200 AS links_limited FROM p LEFT JOIN z USING (page_id) GROUP BY 1""")
def page_links(spark, sf_dir):
    out = extract_pages(b.table(spark, sf_dir, "pages"), max_bytes=None)
    return out.select("page_id", F.array_join("internal_links", " ").alias("links"), "links_limited")


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE NULL END AS description, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'h ' || p_partkey END AS h1,
lower(regexp_replace('h ' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END || ' ' || p_name || ' picture ' || p_size || ' end', '\\s+', ' ')) AS normalized_text,
CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'https://shop.example.com/a/' || p_partkey || ' https://shop.example.com/q?x=1' END AS links FROM part""".replace("'h ' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END || ' ' ||", "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'h ' || p_partkey || ' ' END ||"))
def page_synthetic(spark, sf_dir):
    """Metadata that is missing or empty, excluded elements, images and links in every form."""
    k = F.col("p_partkey")
    text = k.cast("string")
    html = F.concat(
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("<title> "), "p_name", F.lit("</title>"))),
        F.when(k % 3 == 0, F.concat(F.lit('<meta name="Description" content=" '), "p_type", F.lit('">'))).otherwise(""),
        F.lit("<body><nav>menu</nav><div hidden>no</div><div role='Banner'>no</div><form>no</form><!-- no --><h1>"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("h "), text)),
        F.lit("</h1><p>"),
        "p_name",
        F.concat(F.lit("<img alt='Picture "), F.col("p_size").cast("string"), F.lit("'></p><script>no</script>")),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("<a href='/a/./"), text, F.lit("#x'></a><a href='HTTPS://Shop.example.com:443/a/"), text, F.lit("'></a><a href='../q?x=1'></a><a href='mailto:x@y'></a><a href='http://shop.example.com/'></a><a href='https://u@shop.example.com/b'></a>"))),
        F.lit("<p>END</body>"),
    )
    out = extract_pages(b.table(spark, sf_dir, "part").select(k.alias("page_id"), F.lit("https://shop.example.com/dir/page").alias("url"), html.alias("html")))
    return out.select("page_id", "title", "description", "h1", "normalized_text", F.array_join("internal_links", " ").alias("links"))


@query("""SELECT p_partkey AS page_id, CASE p_partkey % 6 WHEN 0 THEN printf('%d.5 USD price json-ld', p_size) WHEN 1 THEN printf('%d EUR low json-ld|%d EUR high json-ld', p_size, p_size + 10) WHEN 2 THEN printf('%d.25 GBP price microdata', p_size) WHEN 3 THEN ''
WHEN 4 THEN printf('%d USD price json-ld|%d USD price json-ld', p_size, p_size + 1) ELSE printf('%d EUR price json-ld', p_size) END AS prices FROM part""")
def page_prices(spark, sf_dir):
    """Products as JSON-LD and as microdata, ranges, lists, repeats and amounts that are none."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    ld = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *parts, F.lit("</script>"))
    plain = ld(F.lit('{"@type": "Product", "priceCurrency": "usd", "offers": {"@type": "Offer", "price": "'), size, F.lit(',50"}}'))
    span = ld(F.lit('{"@type": "AggregateOffer", "priceCurrency": "EUR", "lowPrice": '), size, F.lit(', "highPrice": "'), (F.col("p_size") + 10).cast("string"), F.lit('"}'))
    micro = lambda amount, currency: F.concat(F.lit('<div itemscope itemtype="https://schema.org/Offer"><b itemprop="price" content="'), size, F.lit(f'{amount}">x</b><meta itemprop="priceCurrency" content="{currency}"></div>'))
    none = ld(F.lit('{"@type": "Offer", "price": "-1"}'))
    two = ld(F.lit('{"@graph": [{"@type": "Product", "offers": [{"@type": "Offer", "priceCurrency": "USD", "price": '), size, F.lit('}, {"@type": "http://schema.org/Offer", "priceCurrency": "USD", "price": '), (F.col("p_size") + 1).cast("string"), F.lit("}]}]}"))
    both = F.concat(ld(F.lit('{"@type": "Offer", "priceCurrency": "EUR", "price": '), size, F.lit("}")), micro(".00", "eur"))
    html = F.when(k % 6 == 0, plain).when(k % 6 == 1, span).when(k % 6 == 2, micro(".250", "gbp")).when(k % 6 == 3, none).when(k % 6 == 4, F.concat(two, two)).otherwise(both)
    out = extract_pages(b.table(spark, sf_dir, "part").select(k.alias("page_id"), F.lit("https://shop.example.com/").alias("url"), html.alias("html")))
    return out.select("page_id", F.array_join(F.transform("prices", lambda p: F.concat_ws(" ", p["amount"], p["currency"], p["kind"], p["source"])), "|").alias("prices"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\\.', '') AS host, regexp_replace(url, '#.*', '') AS normalized, url AS shown FROM pages""")
def page_hosts(spark, sf_dir):
    url = F.col("url")
    return b.table(spark, sf_dir, "pages").select("page_id", host_of(url).alias("host"), normalize_url(url).alias("normalized"), external_url(url).alias("shown"))


URL_CASES = ["HTTP://Example.com:80/a/../b/./c//d?q=1#f", "https://example.com", "https://u:p@example.com/", "ftp://example.com/", "https://example.com:8443/x/", "https://example.com/%zz", "//example.com", "https://[::1]:443/"]
URL_WANT = ["http://example.com/b/c/d?q=1", "https://example.com/", None, None, "https://example.com:8443/x/", "https://example.com/%zz", None, "https://[::1]/"]


@query("SELECT event_id, list_extract([" + ", ".join("NULL" if x is None else f"'{x}'" for x in URL_WANT) + "], CAST(event_id % 8 + 1 AS INT)) AS normalized FROM events")
def url_forms(spark, sf_dir):
    cases = F.array(*map(F.lit, URL_CASES))
    return b.table(spark, sf_dir, "events").select("event_id", normalize_url(F.get(cases, (eid() % 8).cast("int"))).alias("normalized"))


@query("SELECT event_id, list_extract(['1.25', NULL, '7', '10.5', NULL, '3', NULL, '0.01'], CAST(event_id % 8 + 1 AS INT)) AS position FROM events")
def positions(spark, sf_dir):
    cases = F.array(*map(F.lit, ["1,250", "0", "7", " 10.50 ", "-2", "3.000", "abc", "1e-2"]))
    return b.table(spark, sf_dir, "events").select("event_id", canonical_position(F.get(cases, (eid() % 8).cast("int"))).alias("position"))


def csv_files(spark, sf_dir):
    """A file of each user's events, in one of three delimiters, some with a preamble and some that can't be read."""
    user = F.col("user_id")
    sep = F.when(user % 3 == 0, ",").when(user % 3 == 1, ";").otherwise("\t")
    line = F.concat_ws("\x01", F.concat(F.lit("https://example.com/p/"), eid().cast("string")), (eid() % 40).cast("string"), (eid() % 50 + 40).cast("string"), F.concat((eid() % 9 + 1).cast("string"), F.lit(".50")))
    each = b.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))
    head = F.concat(F.when(user % 5 == 0, "Report\n\n").otherwise(""), F.lit("Page\x01CLICKS\x01Impressions\x01Average  position\n"))
    body = F.concat(F.array_join(F.col("x.line"), "\n"), F.when(user % 7 == 0, "\nonly one").otherwise(""), F.lit("\n"))
    text = F.translate(F.concat(head, body), "\x01", "|")
    return each.select("user_id", F.concat(F.lit("/in/"), user.cast("string"), F.lit(".csv")).alias("path"), F.encode(F.replace(text, F.lit("|"), sep), "UTF-8").alias("content"))


CSV_N = "n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)"


@query(f"WITH {CSV_N} SELECT '/in/' || user_id || '.csv' AS path, user_id % 7 = 0 AS failed, CASE WHEN user_id % 7 > 0 THEN list_extract([',', ';', chr(9)], CAST(user_id % 3 + 1 AS INT)) END AS delimiter, CASE WHEN user_id % 7 > 0 THEN 'Page|CLICKS|Impressions|Average  position' END AS headers, CASE WHEN user_id % 7 > 0 THEN 4 END AS mapped, CASE WHEN user_id % 7 > 0 THEN CAST(n AS INT) END AS row_count FROM n")
def csv_headers(spark, sf_dir):
    found = csv_pages.parse_files(csv_files(spark, sf_dir).select("path", "content"))
    return found.select("path", F.col("error").isNotNull().alias("failed"), "delimiter", F.array_join("headers", "|").alias("headers"), F.when(F.col("mapping").isNotNull(), F.size("mapping")).alias("mapped"), "row_count")


CSV_ROWS = "r AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN user_id % 5 = 0 THEN 3 ELSE 1 END AS INT) AS line FROM events WHERE user_id % 7 > 0)"


@query(f"WITH {CSV_ROWS} SELECT '/in/' || user_id || '.csv' AS path, line, 'https://example.com/p/' || event_id AS page, CAST(event_id % 40 AS VARCHAR) AS clicks, CAST(event_id % 50 + 40 AS VARCHAR) AS impressions, (event_id % 9 + 1) || '.50' AS position FROM r")
def csv_rows(spark, sf_dir):
    rows = csv_pages.parse_rows(csv_files(spark, sf_dir).select("path", "content"))
    return rows.where("error IS NULL").select("path", "line", "page", "clicks", "impressions", "position")


@query(f"""WITH {CSV_ROWS}, new AS (SELECT 'https://example.com/p/' || event_id AS normalized_url, event_id, event_id % 40 AS clicks, event_id % 50 + 40 AS impressions, (event_id % 9 + 1) || '.5' AS position_text FROM r)
SELECT normalized_url, clicks, impressions, position_text, CASE event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'unchanged' ELSE 'updated' END AS action FROM new""")
def csv_import(spark, sf_dir):
    """From the files to the stored metrics: parsed, mapped, validated, and upserted over what an earlier import left."""
    rows = csv_pages.parse_rows(csv_files(spark, sf_dir).select("path", "content")).where("error IS NULL")
    checked = metrics.validated(rows.select("line", "page", "clicks", "impressions", "position"), "https://example.com/")
    new = checked.where(F.size("errors") == 0).select("normalized_url", F.col("clicks_n").alias("clicks"), F.col("impressions_n").alias("impressions"), "position_text")
    old = b.table(spark, sf_dir, "events").where("event_id % 3 > 0 AND user_id % 7 > 0").select(F.concat(F.lit("https://example.com/p/"), eid().cast("string")).alias("normalized_url"), F.when(eid() % 3 == 1, eid() % 40).otherwise(eid() % 40 + 1).alias("clicks"), (eid() % 50 + 40).alias("impressions"), F.concat((eid() % 9 + 1).cast("string"), F.lit(".5")).alias("position_text"))
    return metrics.upserted(old, metrics.unique_batch(new, ["normalized_url"]), ["normalized_url"], ["clicks", "impressions", "position_text"])


@query("SELECT CAST(count(*) FILTER (event_id % 2 = 1) AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS added, CAST(count(*) FILTER (event_id % 4 = 1) AS BIGINT) AS updated, CAST(count(*) FILTER (event_id % 4 = 3) AS BIGINT) AS unchanged FROM events")
def import_outcome(spark, sf_dir):
    old = b.table(spark, sf_dir, "events").select("event_id", (eid() % 50).alias("clicks"))
    new = old.where("event_id % 2 = 1").withColumn("clicks", F.when(eid() % 4 == 1, F.col("clicks") + 1).otherwise(F.col("clicks")))
    return metrics.outcome(metrics.upserted(old, new, ["event_id"], ["clicks"]))


@query("""SELECT event_id, event_id % 50 + CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS clicks, CASE event_id % 4 WHEN 1 THEN 'new' ELSE 'old' END AS updated_by, CASE event_id % 4 WHEN 1 THEN 'updated' WHEN 3 THEN 'unchanged' ELSE 'kept' END AS action FROM events""")
def daily_upsert(spark, sf_dir):
    """As services' syncs do it: a row that hasn't changed keeps its stamp."""
    old = b.table(spark, sf_dir, "events").select("event_id", (eid() % 50).alias("clicks"), F.lit("old").alias("updated_by"))
    new = old.where("event_id % 2 = 1").select("event_id", F.when(eid() % 4 == 1, F.col("clicks") + 1).otherwise(F.col("clicks")).alias("clicks"), F.lit("new").alias("updated_by"))
    return metrics.upserted(old, new, ["event_id"], ["clicks"], ("updated_by",), touch_unchanged=False)


@query(f"WITH {b.METRICS} SELECT metric_date, 'https://example.com/u/' || site_id AS url, CAST(clicks AS VARCHAR) AS clicks, CAST(impressions AS VARCHAR) AS impressions, CAST(site_id % 30 + 1 AS VARCHAR) || '.5' AS position FROM metrics", ("metric_date",))
def row_payloads(spark, sf_dir):
    """Daily metrics as rows keyed by date and address, read back."""
    m = b.daily_metrics(spark, sf_dir)
    url = F.concat(F.lit("https://example.com/u/"), F.col("site_id").cast("string"))
    row = F.struct(F.array(F.col("metric_date").cast("string"), url).alias("keys"), "clicks", "impressions", F.concat((F.col("site_id") % 30 + 1).cast("string"), F.lit(".5")).alias("position"))
    landed = m.groupBy("site_id").agg(F.collect_list(row).alias("rows")).select(F.to_json(F.struct("rows")).alias("payload"))
    return payloads.row_payload(landed)


@query(f"WITH {b.METRICS} SELECT metric_date, 'https://example.com/u/' || site_id AS normalized_url, CASE WHEN site_id % 4 = 0 THEN NULL ELSE clicks END AS clicks, impressions, CASE site_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '2.5' END AS position_text FROM metrics", ("metric_date",))
def provider_metrics(spark, sf_dir):
    """A service's counts as whole numbers in any dress, positions down to 0, hosts with and without www."""
    site = F.col("site_id")
    rows = b.daily_metrics(spark, sf_dir).select(
        "metric_date",
        F.concat(F.when(site % 2 == 0, "https://EXAMPLE.com:443/u/./").otherwise("https://example.com/u/"), site.cast("string")).alias("url"),
        F.when(site % 4 == 0, F.lit(None)).otherwise(F.concat(F.col("clicks").cast("string"), F.when(site % 4 == 1, ".0").otherwise(""))).alias("clicks"),
        F.concat(F.col("impressions").cast("string"), F.lit(".00")).alias("impressions"),
        F.when(site % 3 == 0, "0.0").when(site % 3 == 1, "2,50").alias("position"),
    )
    return metrics.provider_rows(rows, "https://www.example.com/")


@query("""WITH p AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST('2024-01-10' AS DATE) + CAST(event_id % 9 AS INT) END AS s, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST('2024-01-12' AS DATE) + CAST(event_id % 4 AS INT) END AS e FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN s IS NULL THEN 'no start' END, CASE WHEN e IS NULL THEN 'no end' END, CASE WHEN s > DATE '2024-01-14' THEN 'start in the future' END, CASE WHEN e > DATE '2024-01-14' THEN 'end in the future' END, CASE WHEN s > e THEN 'start after end' END], lambda x: x IS NOT NULL), '|') AS errors FROM p""")
def period_checks(spark, sf_dir):
    day = lambda d, n, gap: F.when(eid() % gap == 0, F.lit(None)).otherwise(F.date_add(F.to_date(F.lit(d)), (eid() % n).cast("int")))
    return b.table(spark, sf_dir, "events").select("event_id", F.array_join(metrics.period_errors(day("2024-01-10", 9, 5), day("2024-01-12", 4, 7), F.to_date(F.lit("2024-01-14"))), "|").alias("errors"))


@query(f"WITH {b.METRICS} SELECT site_id, metric_date, printf('%.2f %%', CASE WHEN impressions > 0 THEN 100.0 * clicks / impressions ELSE 0 END) AS ctr_text FROM metrics WHERE (200 * clicks) % impressions = 0", ("metric_date",))
def ctr_texts(spark, sf_dir):
    """Where the rate has a finite number of digits, which all engines round alike."""
    m = b.daily_metrics(spark, sf_dir).where("(200 * clicks) % impressions = 0")
    return m.select("site_id", "metric_date", metrics.ctr_text(F.col("clicks"), F.col("impressions")).alias("ctr_text"))


STATUS = "CAST(200 + 100 * (event_id % 4) + event_id % 5 AS INT)"


@query(f"""WITH x AS (SELECT event_id, {STATUS} AS status, CASE event_id % 11 WHEN 3 THEN 'timeout' WHEN 4 THEN 'network_error' END AS failure, event_id % 6 AS t, event_id % 13 = 5 AS large, event_id % 17 <> 2 AS parsed FROM events)
SELECT event_id, CASE WHEN failure IS NOT NULL THEN failure WHEN status BETWEEN 300 AND 399 THEN 'redirect' WHEN status NOT BETWEEN 200 AND 299 THEN 'http_error' WHEN t = 0 THEN 'non_html' WHEN large THEN 'oversized' WHEN NOT parsed THEN 'parse_error' ELSE 'html' END AS outcome,
CASE WHEN failure = 'timeout' THEN 'robots_timeout' WHEN failure IS NOT NULL THEN 'robots_network_error' WHEN status BETWEEN 300 AND 399 THEN 'robots_redirect' WHEN status = 404 OR status BETWEEN 200 AND 299 THEN 'completed' ELSE 'robots_deferred' END AS robots FROM x""")
def crawl_outcomes(spark, sf_dir):
    status = (200 + 100 * (eid() % 4) + eid() % 5).cast("int")
    failure = F.when(eid() % 11 == 3, "timeout").when(eid() % 11 == 4, "network_error")
    media = F.when(eid() % 6 == 0, "application/pdf").when(eid() % 6 == 1, "TEXT/HTML; charset=utf-8").otherwise("application/xhtml+xml")
    large, body = F.when(eid() % 26 == 5, 3_000_000).otherwise(100), F.when(eid() % 26 == 18, 3_000_000).otherwise(100)
    return b.table(spark, sf_dir, "events").select("event_id", crawl.page_outcome(status, failure, media, large, body, eid() % 17 != 2).alias("outcome"), crawl.robots_status(status, failure).alias("robots"))


@query(f"WITH {b.SITES}, {b.RUNS}, {b.PAGES} SELECT page_id, site_id, NOT (site_id % 3 = 1 AND url IN ('https://example.com/p/1', 'https://example.com/p/2')) AS allowed FROM pages JOIN runs USING (run_id)")
def robots_allowed(spark, sf_dir):
    """Some sites' robots.txt forbid two pages, some have none, some can't be found."""
    site = F.col("site_id")
    robots = b.sites(spark, sf_dir).where("site_id % 3 > 0").select("site_id", F.when(site % 3 == 2, 404).otherwise(200).alias("status"), F.lit("User-agent: *\nDisallow: /p/1\nDisallow: /p/2\n").alias("body"))
    pages = b.pages(spark, sf_dir).join(b.runs(spark, sf_dir).select("run_id", "site_id"), "run_id").select("page_id", "site_id", "url")
    return crawl.allowed(pages, robots, "pagetide").select("page_id", "site_id", "allowed")


@query(f"WITH {b.PAGES} SELECT page_id, array_to_string(internal_links, ' ') AS links FROM pages")
def link_codec(spark, sf_dir):
    links = crawl.decoded_links(crawl.encoded_links(F.col("internal_links")))
    return b.pages(spark, sf_dir).select("page_id", F.array_join(links, " ").alias("links"))


@query(f"WITH {b.PAGES} SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(price AS VARCHAR) || ' USD price json-ld' ELSE CAST(price AS VARCHAR) || ' USD low json-ld|' || CAST(price AS VARCHAR) || ' USD high json-ld' END AS prices FROM pages WHERE CAST(price * 100 AS BIGINT) % 10 > 0")
def page_versions(spark, sf_dir):
    """Snapshots put together with their prices, which lie apart and out of order."""
    rows = b.pages(spark, sf_dir).withColumn("amount", F.col("prices")[0]["amount"]).where(F.col("amount").rlike(r"\.\d[1-9]$"))
    row = lambda n, kind: F.struct(F.lit(n).alias("sequence_number"), "amount", F.lit("USD").alias("currency"), F.lit(kind).alias("kind"), F.lit("json-ld").alias("source"))
    lists = F.when(F.col("page_id") % 3 == 1, F.array(row(1, "price"))).when(F.col("page_id") % 3 == 2, F.array(row(2, "high"), row(1, "low")))
    prices = rows.select("page_id", F.explode(lists).alias("p")).select("page_id", "p.*")
    out = diff.versions(rows.drop("prices", "amount"), prices)
    return out.select("page_id", F.array_join(F.transform("prices", lambda p: F.concat_ws(" ", p["amount"], p["currency"], p["kind"], p["source"])), "|").alias("prices"))


@query(r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS readable FROM documents WHERE text IS NOT NULL")
def readable_texts(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", normalize_readable_text(F.col("text")).alias("readable"))


def cases(table: dict[str, str], key: str, unknown: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{unknown}' END"


@query(f"""{b.GRAPH} SELECT page_id, {cases(titles.ERROR_OUTCOME, "outcome", titles.OUTCOME_UNKNOWN)} AS outcome_title, {cases(titles.AVAILABILITY, "outcome", titles.AVAILABILITY_UNKNOWN)} AS availability_title, page_id || ' ' || CASE WHEN page_id % 10 = 1 AND page_id % 100 <> 11 THEN 'запись' WHEN page_id % 10 BETWEEN 2 AND 4 AND page_id % 100 NOT BETWEEN 12 AND 14 THEN 'записи' ELSE 'записей' END AS count_text,
left('a' || repeat(' b ', CAST(page_id % 90 AS INT)), 200) AS header FROM gpages""")
def title_texts(spark, sf_dir):
    o = F.col("outcome")
    noisy = F.concat(F.lit("a"), F.repeat(F.lit("\tb\n"), (F.col("page_id") % 90).cast("int")))
    return b.graph_pages(spark, sf_dir).select("page_id", titles.title(titles.ERROR_OUTCOME, o, titles.OUTCOME_UNKNOWN).alias("outcome_title"), titles.title(titles.AVAILABILITY, o, titles.AVAILABILITY_UNKNOWN).alias("availability_title"), titles.count_text(F.col("page_id"), "запись", "записи", "записей").alias("count_text"), titles.header_fragment(noisy).alias("header"))


@query(f"WITH {b.RUNS} SELECT run_id, {cases(titles.RUN_STATUS, 'status', titles.STATUS_UNKNOWN)} AS title, CASE WHEN status = 'failed' THEN 'interrupted' ELSE status END AS recovered FROM runs")
def run_titles(spark, sf_dir):
    """Titles of runs; and failed ones taken as running, which a restart interrupts."""
    rows = b.runs(spark, sf_dir)
    after = run_ops.interrupted(rows.withColumn("status", F.when(F.col("status") == "failed", "running").otherwise(F.col("status")))).select("run_id", F.col("status").alias("recovered"))
    return rows.select("run_id", titles.title(titles.RUN_STATUS, F.col("status"), titles.STATUS_UNKNOWN).alias("title")).join(after, "run_id")


@query("""SELECT url, CASE page_id % 5 WHEN 0 THEN 'http_error' WHEN 1 THEN 'redirect' WHEN 2 THEN 'non_html' ELSE 'html' END AS outcome, CASE WHEN page_id % 5 > 2 THEN html END AS html,
CAST(octet_length(encode(html)) AS BIGINT) AS body_bytes FROM pages""")
def landed_outcomes(spark, sf_dir):
    """The pages as responses of all kinds in WARC files, read back through the data source."""
    landed.register(spark)
    kind = F.col("page_id") % 5
    status = F.when(kind == 0, "404 Not Found").when(kind == 1, "302 Found").otherwise("200 OK")
    head = F.concat(F.lit("HTTP/1.1 "), status, F.lit("\r\nContent-Type: "), F.when(kind == 2, "application/pdf").otherwise("text/html"), F.lit("\r\n\r\n"))
    block = F.concat(head, "html")
    record = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), "url", F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)
    path = shared_dir(spark)
    b.table(spark, sf_dir, "pages").select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    return landed.with_outcome(spark.read.format("landed_crawl").load(path)).select("url", "outcome", "html", "body_bytes")
