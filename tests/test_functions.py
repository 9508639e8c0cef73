from datetime import datetime
from decimal import Decimal
from fractions import Fraction
from itertools import product

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pagetide.functions import calendar, decimals, ratio, text, urls
from pyspark.sql import functions as F


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_of_all_short_strings():
    every = ["".join(p) for n in range(4) for p in product("aя🦔", repeat=n)]
    assert all(text.edit_distance(a, b) == slow_distance(a, b) for a in every for b in every)


@given(st.text("abc", max_size=80), st.text("abc", max_size=80))
def test_distance_of_long_strings(a, b):
    assert text.edit_distance(a, b) == slow_distance(a, b) == text.edit_distance(b, a)


def test_distance_in_a_plan(spark, monkeypatch):
    rows = spark.createDataFrame([("кот", "крот"), ("ёжик 🦔", "ежик 🐾"), ("", "abc"), ("a" * 600, "b" * 600), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(text.distance(F.col("a"), F.col("b"))).collect()] == [1, 2, 3, 600, None]


def test_normalization():
    assert text.main_text("  \u0415\u0308ЖИК, Straße™\nслово—слово  е ё  ") == "ёжик strasse слово слово е ё"
    assert text.readable_text(" A \n e\u0301 ") == "A é"


def test_ratio(spark):
    pairs = [(1, 20), (1, 10), (3, 10), (2, 100001), (7, 7), (2**61, 2**62), (12, 18)]
    rows = spark.createDataFrame(pairs, "n long, d long").select("n", "d", ratio.reduced(F.col("n"), F.col("d")).alias("r"), ratio.weight(F.col("n"), F.col("d")).alias("w")).collect()
    assert all(Fraction(r.n, r.d) == Fraction(r.r.num, r.r.den) and Fraction(r.n, r.d).denominator == r.r.den for r in rows)
    assert [r.w for r in rows][:3] == [1, 2, 3]
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(ratio.weight(F.lit(0), F.lit(5))).collect()


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM:80/a/./b/../c/?Q=1#x", "http://example.com/a/c/?Q=1"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:8443/x//y", "https://example.com:8443/x/y"),
        ("https://[2001:DB8::1]:443/", "https://[2001:db8::1]/"),
        ("https://user:pass@example.com/", None),
        ("ftp://example.com/", None),
        ("https://example.com:99999/", None),
        ("/relative", None),
        (None, None),
    ],
)
def test_urls(url, want):
    assert urls.normalized(url) == want


def test_hosts():
    assert urls.bare_host("https://www.Example.com./x") == urls.bare_host("sc-domain:example.com") == "example.com"
    assert urls.displayable("https://a.b/\x07") is None and urls.displayable("https://a.b/") == "https://a.b/"


def test_decimals(spark):
    assert decimals.canonical(Decimal("1.2300")) == "1.23" and decimals.canonical(Decimal("1E+3")) == "1000" and decimals.canonical(Decimal("0.00")) == "0"
    with pytest.raises(ValueError):
        decimals.canonical(Decimal(-1))
    assert decimals.position("1,2300", False) == "1.23" and decimals.position("0", False) is None and decimals.position("0", True) == "0" and decimals.position("x", True) is None
    rows = spark.createDataFrame([("10.5",), ("10.50",), ("-1",), ("1e3",)], "t string").select(decimals.decoded(F.col("t"))).collect()
    assert [r[0] for r in rows] == [Decimal("10.5"), None, None, None]


def test_next_run(spark):
    now = F.lit("2026-07-21 12:00:00").cast("timestamp")
    row = spark.range(1).select(*(calendar.next_run(now, F.lit(f), F.lit(1), F.lit("09:00"), "Europe/Moscow").cast("string") for f in ("daily", "weekly"))).first()
    assert list(row) == ["2026-07-22 06:00:00", "2026-07-28 06:00:00"]


def test_advance_over_a_clock_change(spark):
    at = F.lit("2026-03-28 08:00:00").cast("timestamp")  # 09:00 in Berlin, and the clocks change the night after
    row = spark.range(1).select(calendar.advanced(at, F.lit("daily"), "Europe/Berlin").cast("string")).first()
    assert row[0] == "2026-03-29 07:00:00"
    later = lambda t: F.lit(t).cast("timestamp")
    n = spark.range(1).select(*(calendar.missed_periods(at, F.lit("daily"), later(t), "Europe/Berlin") for t in ("2026-03-28 07:59:59", "2026-03-28 08:00:00", "2026-03-29 06:59:59", "2026-03-29 07:00:00"))).first()
    assert list(n) == [0, 1, 1, 2]


def test_iso(spark):
    row = spark.createDataFrame([(datetime(2026, 1, 2, 3, 4, 5), datetime(2026, 1, 2, 3, 4, 5, 600))], "a timestamp, b timestamp").select(calendar.utc_iso(F.col("a")), calendar.utc_iso(F.col("b"))).first()
    assert list(row) == ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.000600Z"]
