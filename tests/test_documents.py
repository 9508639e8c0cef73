import csv
import io
import json
from datetime import datetime

import pytest
from pagetide.operators import feed
from pyspark.sql import functions as F

SIDE = "state string, text string, links array<string>, currency string, low string, high string"
EVENTS = f"site_id long, site_name string, site_url string, source string, source_rank int, event_id long, event_type string, current_completed_at timestamp, url string, importance string, weight int, viewed_at timestamp, current struct<{SIDE.replace(' ', ': ')}>, previous struct<{SIDE.replace(' ', ': ')}>".replace(",: ", ", ")


def text(value):
    return ("text", value, None, None, None, None)


def rows(spark, *titles):
    made = [(1, 'a "name", quoted', "https://e.org/", "snapshot", 0, k, "title_changed", datetime(2026, 1, 1 + k % 3), f"/{k}", "high", 3, None, text(t), text("before")) for k, t in enumerate(titles)]
    return spark.createDataFrame(made, EVENTS)


def test_one_json_document(spark, tmp_path):
    path = tmp_path / "out.json"
    feed.write_document(rows(spark, "x", "line\nbreak", "=1+1", "ü").repartition(3), str(path))
    document = json.loads(path.read_text())
    assert document["schema_version"] == 1 and [e["event_id"] for e in document["events"]] == [2, 1, 3, 0]  # newest first, then by id from the last
    assert document["events"][1]["current"]["text"] == "line\nbreak" and document["events"][1]["viewed_at"] is None
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.json"]


def test_one_csv_document(spark, tmp_path):
    path = tmp_path / "out.csv"
    feed.write_document(rows(spark, "x", "line\nbreak", "=1+1", 'a,"b"').repartition(3), str(path), "csv")
    raw = path.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfsite_id,") and raw.count(b"\xef\xbb\xbf") == 1 and raw.endswith(b"\r\n")
    read = list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert [r["event_id"] for r in read] == ["2", "1", "3", "0"] and [r["current"] for r in read] == ["'=1+1", "line\r\nbreak", 'a,"b"', "x"]
    assert read[0]["site_name"] == 'a "name", quoted' and read[0]["viewed_at"] == ""


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_refused_and_empty_documents(spark, tmp_path, kind):
    path = tmp_path / "out"
    good = rows(spark, *map(str, range(50)))
    bad = good.withColumn("event_type", F.when(F.col("event_id") == 33, "page_added").otherwise(F.col("event_type")))
    with pytest.raises(Exception, match="contradicts"):
        feed.write_document(bad, str(path), kind)
    assert not list(tmp_path.iterdir())
    feed.write_document(good.limit(0), str(path), kind)
    assert json.loads(path.read_text())["events"] == [] if kind == "json" else path.read_text("utf-8-sig").count("\n") == 1
    with pytest.raises(FileExistsError):
        feed.write_document(good, str(path), kind)
    with pytest.raises(ValueError):
        feed.write_document(good, str(path) + "x", "xml")


def test_a_document_of_many_events(spark, tmp_path):
    one = rows(spark, "x").drop("event_id")
    many = one.crossJoin(spark.range(200_000).withColumnRenamed("id", "event_id"))
    path = tmp_path / "many.csv"
    feed.write_document(many, str(path), "csv")
    with path.open(encoding="utf-8-sig", newline="") as f:
        ids = [int(r["event_id"]) for r in csv.DictReader(f)]
    assert ids == list(range(199_999, -1, -1))


def test_links_as_the_page_has_them(spark):
    pages = spark.createDataFrame([(1, "b a b".split()), (2, ["a"]), (3, ["a", "b"])], "page_id long, internal_links array<string>").withColumns({c: F.lit(None).cast("string") for c in ("title", "description", "h1", "normalized_text")} | {"prices": F.lit(None).cast("array<struct<amount: string, currency: string, kind: string, source: string>>")})
    event = lambda c, p: spark.createDataFrame([(c, p, "/x", "internal_links_changed")], "current_page_id long, previous_page_id long, url string, event_type string")
    raw, told = feed.with_sides(event(1, 2), pages, raw=True).first(), feed.with_sides(event(1, 2), pages).first()
    assert raw.current.links == ["b", "a", "b"] and told.current.links == ["a", "b"] and raw.previous.links == told.previous.links == ["a"]
    for r in (True, False):  # the same set in another order is no change
        with pytest.raises(Exception, match="contradicts"):
            feed.verified(feed.with_sides(event(1, 3), pages, raw=r)).collect()
