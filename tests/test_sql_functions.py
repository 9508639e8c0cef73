from datetime import datetime

import pytest
from pagetide.functions import titles
from pagetide.operators import schedule
from pagetide.sources import sql_functions
from pagetide.sources.pages import internal_links
from pyspark.sql import functions as F

HTML = '<a href="/b">b</a><a href="/a#x">a</a><a href="/b">again</a><a href="https://other.org/">out</a>'


def test_links_by_sql(spark):
    sql_functions.register(spark)
    sql_functions.register(spark)
    many = "".join(f'<a href="/p{k}">x</a>' for k in range(300))
    rows = [("https://e.org/", HTML), ("https://e.org/x", None), ("not an address", HTML), (None, HTML), ("https://e.org/many", many), ("https://e.org/none", "")]
    spark.createDataFrame(rows, "url string, html string").repartition(3).createOrReplaceTempView("sql_pages")
    got = [tuple(r) for r in spark.sql("SELECT url, position, link FROM explode_links(TABLE(SELECT url, html FROM sql_pages)) ORDER BY url, position").collect()]
    assert got[:2] == [("https://e.org/", 0, "https://e.org/b"), ("https://e.org/", 1, "https://e.org/a")]
    assert got[2:] == [("https://e.org/many", k, link) for k, link in enumerate(internal_links(many, "https://e.org/many", None)[0])] and len(got) == 302
    assert spark.sql("SELECT * FROM explode_links(TABLE(SELECT url, html FROM sql_pages WHERE false))").isEmpty()


def test_scalars_by_sql(spark):
    sql_functions.register(spark)
    row = spark.sql("SELECT normalize_url('HTTP://E.org:80/a/../b#c') u, url_host('https://www.E.org/') h, external_url('javascript:x') e, normalize_text(' Ein GROẞES, Wort ') t, readable_text(' a  b ') r, fold_case('ẞ') f, edit_distance('kitten', 'sitting') d, edit_distance(NULL, 'x') n").first()
    assert tuple(row) == ("http://e.org/b", "e.org", None, "ein grosses wort", "a b", "ss", 3, None)


ENTRIES = "id long, site_id long, status string, max_pages int, max_depth int, delay double, timeout double, user_agent string"


def test_retries_keep_their_settings(spark):
    entries = spark.createDataFrame([(1, 9, "failed", 5, 1, 0.5, 3.0, "a"), (2, 9, "completed", 6, 2, 1.0, 4.0, "b"), (3, 8, "interrupted", 7, 3, 1.5, 5.0, "c")], ENTRIES)
    ask = lambda *rows: spark.createDataFrame(rows, "site_id long, entry_id long")
    now = F.lit(datetime(2026, 1, 1)).cast("timestamp")
    out = schedule.retried(entries, ask((9, 1), (8, 3)), now).orderBy("retry_of_id").collect()
    assert [tuple(r) for r in out] == [(9, None, datetime(2026, 1, 1), "pending", schedule.RETRY_MESSAGE, 5, 1, 0.5, 3.0, "a", 1, "not_applicable"), (8, None, datetime(2026, 1, 1), "pending", schedule.RETRY_MESSAGE, 7, 3, 1.5, 5.0, "c", 3, "not_applicable")]
    with pytest.raises(LookupError, match="no entry 3"):  # another site's
        schedule.retried(entries, ask((9, 1), (9, 3)), now)
    with pytest.raises(ValueError, match="completed"):
        schedule.retried(entries, ask((9, 2)), now)
    assert schedule.retried(entries, ask((9, 1)).limit(0), now).isEmpty()


def test_weekday_titles(spark):
    rows = spark.createDataFrame([(0,), (6,), (7,), (None,)], "d int").select(titles.weekday_title(F.col("d")))
    assert [r[0] for r in rows.collect()] == ["Понедельник", "Воскресенье", None, None]
