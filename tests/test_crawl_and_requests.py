from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pagetide.functions import requests
from pagetide.operators import crawl, feed
from pyspark.sql import functions as F


def test_page_outcomes(spark):
    rows = [
        (200, None, "text/HTML; charset=x", None, 10, True, "html"),
        (200, None, "application/pdf", None, 10, None, "non_html"),
        (200, None, None, None, 10, None, "non_html"),
        (200, None, "text/html", 3_000_000, None, None, "oversized"),
        (200, None, "text/html", None, 2 * 1024 * 1024 + 1, None, "oversized"),
        (200, None, "text/html", None, 10, False, "parse_error"),
        (302, None, None, None, None, None, "redirect"),
        (404, None, None, None, None, None, "http_error"),
        (None, "timeout", None, None, None, None, "timeout"),
        (200, "network_error", "text/html", None, None, None, "network_error"),
    ]
    df = spark.createDataFrame(rows, "s int, f string, c string, d long, b long, p boolean, want string")
    assert df.where(crawl.page_outcome(*(F.col(c) for c in "sfcdbp")) != F.col("want")).isEmpty()


def test_robots(spark, monkeypatch):
    rows = [(200, None, "completed"), (404, None, "completed"), (301, None, "robots_redirect"), (503, None, "robots_deferred"), (None, "timeout", "robots_timeout"), (None, "network_error", "robots_network_error")]
    df = spark.createDataFrame(rows, "s int, f string, want string")
    assert df.where(crawl.robots_status(F.col("s"), F.col("f")) != F.col("want")).isEmpty()
    pages = spark.createDataFrame([(1, "https://a/x"), (1, "https://a/private/x"), (2, "https://b/private"), (3, "https://c/private")], "site_id long, url string")
    robots = spark.createDataFrame([(1, 200, "User-agent: *\nDisallow: /private\n"), (2, 404, "Disallow: /")], "site_id long, status int, body string")
    want = {"https://a/x": True, "https://a/private/x": False, "https://b/private": True, "https://c/private": True}
    assert {r.url: r.allowed for r in crawl.allowed(pages, robots, "bot").collect()} == want
    plan = crawl.allowed(pages, robots, "bot")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "body" not in plan
    monkeypatch.setattr(crawl, "SENT_RULES", 10)  # more rules than are sent
    assert {r.url: r.allowed for r in crawl.allowed(pages, robots, "bot").collect()} == want


def test_link_codec(spark):
    df = spark.createDataFrame([('["a","b"]',), ("[]",), (None,)], "t string")
    assert [r[0] for r in df.select(crawl.decoded_links(F.col("t"))).collect()] == [["a", "b"], [], None]
    for text, why in (("{", "JSON"), ("nope", "JSON"), ('{"a":1}', "array"), ('["a",1]', "string"), ("[1]", "string"), ('["a",null]', "string")):
        with pytest.raises(Exception, match=why):
            spark.createDataFrame([(text,)], "t string").select(crawl.decoded_links(F.col("t"))).collect()
    assert spark.range(1).select(crawl.encoded_links(F.array(F.lit("é"), F.lit("b")))).first()[0] == '["é","b"]'


FORM = {"max_pages": "10", "max_depth": "2", "delay": "0,5", "timeout": "30", "user_agent": " bot "}


def test_crawl_settings():
    assert requests.crawl_settings(FORM) == ({"max_pages": 10, "max_depth": 2, "delay": 0.5, "timeout": 30.0, "user_agent": "bot"}, {})
    bad = {"max_pages": "201", "max_depth": "x", "delay": "0.4", "timeout": "1e2", "user_agent": "a\nb"}
    values, errors = requests.crawl_settings(bad)
    assert values is None and set(errors) == set(bad)


def test_structure_filters():
    values, errors = requests.structure_filters("/a", "3", "html", "yes", "no", "island", "2")
    assert errors == {} and values == {"url": "/a", "depth": 3, "outcome": "html", "broken": True, "unchecked": False, "signal": "island", "page": 2}
    _, errors = requests.structure_filters("\x01", "03", "odd", "maybe", "x", "y", "0")
    assert set(errors) == {"url", "depth", "outcome", "broken", "unchecked", "signal", "page"}


def test_feed_filters():
    values, _ = requests.feed_filters("text_changed", "2026-03-28", "2026-03-29", "1", "viewed", "7", ZoneInfo("Europe/Berlin"))
    assert values["from_time"] == datetime(2026, 3, 27, 23, tzinfo=UTC) and values["before_time"] == datetime(2026, 3, 29, 22, tzinfo=UTC)
    assert values["viewed"] is True and values["site_id"] == 7 and values["event_types"] == ["text_changed"]
    assert requests.feed_filters()[0]["viewed"] is None
    _, errors = requests.feed_filters("x", "2026-1-1", "2026-13-01", "+1", "maybe", "01")
    assert set(errors) == {"event_type", "date_from", "date_to", "page", "view_status", "site_id"}
    assert "date_range" in requests.feed_filters(date_from="2026-02-01", date_to="2026-01-01")[1]
    assert "date_to" in requests.feed_filters(date_to="9999-12-31")[1]


def test_counts_and_properties():
    assert [requests.count_phrase(n) for n in (1, 2, 5, 11, 12, 21, 22, 111)] == ["1 запись", "2 записи", "5 записей", "11 записей", "12 записей", "21 запись", "22 записи", "111 записей"]
    known = [{"id": "sc-domain:example.com"}, {"id": "https://www.example.com/"}, {"id": "https://other.com/"}, {"id": "https://example.com/", "permission": "siteUnverifiedUser"}]
    found = requests.matching_properties("https://example.com/", known)
    assert [p["id"] for p in found] == ["sc-domain:example.com", "https://www.example.com/"] and requests.only_property("https://example.com/", found)["id"] == "sc-domain:example.com"


def test_price_sides_and_exports(spark, tmp_path):
    price = "array<struct<amount: string, currency: string, kind: string, source: string>>"
    pages = spark.createDataFrame([(1, None, None, None, "", [], [("10.5", "EUR", "price", "x")]), (2, None, None, None, "", [], [("1", "EUR", "low", "x"), ("20", "EUR", "high", "x")])], f"page_id long, title string, description string, h1 string, normalized_text string, internal_links array<string>, prices {price}")
    events = spark.createDataFrame([(1, "n", "u", "price", 5, "price_changed", datetime(2026, 1, 1), "/x", None, None, None, 1, 2)], "site_id long, site_name string, site_url string, source string, event_id long, event_type string, current_completed_at timestamp, url string, importance string, weight int, viewed_at timestamp, current_page_id long, previous_page_id long")
    full = feed.with_sides(events, pages)
    row = feed.csv_rows(full).first()
    assert (row.current, row.previous, row.importance, row.view_status) == ("10.5 EUR", "1–20 EUR", feed.NOT_RATED, feed.NOT_VIEWED)
    feed.write_json(full, str(tmp_path / "j"))
    import json

    document = json.loads(feed.json_document(str(tmp_path / "j"), spark))
    e = document["events"][0]
    assert document["schema_version"] == 1 and e["current"]["state"] == "price" and e["previous"] == {"state": "price_range", "text": None, "links": None, "currency": "EUR", "low": "1", "high": "20"} and e["detected_at"] == "2026-01-01T00:00:00Z"
    feed.write_csv(full, str(tmp_path / "c"))
    part = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert part.count(b"\r\n") == 2 and part.startswith(b"\xef\xbb\xbfsite_id,")
    with pytest.raises(ValueError, match="over 0"):
        feed.json_document(str(tmp_path / "j"), spark, most=0)
    never = tmp_path / "never"
    for broken in (full.withColumn("event_type", F.lit("page_added")), full.withColumn("event_type", F.lit("h1_changed"))):
        for write in (feed.write_csv, feed.write_json):
            with pytest.raises(Exception, match="contradicts"):
                write(full.unionByName(broken), str(never))
            assert not list(tmp_path.glob("never*"))
    feed.write_csv(full, str(never))  # the corrected export takes the path that a refused one asked for
    assert len(list(never.glob("part-*.csv"))) == 1
    for write in (feed.write_csv, feed.write_json):
        with pytest.raises(FileExistsError):
            write(full, str(never))
    assert [p.name for p in tmp_path.glob("never*")] == ["never"] and len(list(never.glob("part-*.csv"))) == 1
