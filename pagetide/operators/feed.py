"""The change feed: both kinds of events as one table, filtered, ordered and paged."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.calendar import midnight_utc, utc_iso
from pagetide.operators.diff import all_events, matched, price_profile
from pagetide.plans import storage
from pagetide.plans.storage import files, published, removed, renamed
from pagetide.schemas import EVENT_TYPES

COLUMNS = [
    "event_id", "source", "source_rank", "site_id", "site_name", "site_url", "site_type", "event_type", "url", "current_completed_at", "importance", "weight", "current_run_id", "previous_run_id",
    "current_page_id", "previous_page_id", "text_distance", "ratio_numerator", "ratio_denominator", "viewed_at", "price_profile", "price_currency",
]
MAX_PAGE = 200
#: Titles, explanations and words of the exports.
TITLES = {
    "page_added": "Новая страница",
    "page_removed": "Удалённая страница",
    "title_changed": "Изменение Title",
    "description_changed": "Изменение Description",
    "h1_changed": "Изменение H1",
    "text_changed": "Изменение текста",
    "internal_links_changed": "Изменение внутренних ссылок",
    "price_changed": "Изменение цены",
}
EXPLANATIONS = {
    "page_added": "В текущем завершённом обходе найдена страница, которой не было в предыдущем завершённом обходе.",
    "page_removed": "Страница была в предыдущем завершённом обходе, но отсутствует в текущем завершённом обходе.",
    "title_changed": "Значение Title страницы отличается от предыдущего завершённого обхода.",
    "description_changed": "Значение Description страницы отличается от предыдущего завершённого обхода.",
    "h1_changed": "Значение H1 страницы отличается от предыдущего завершённого обхода.",
    "text_changed": "Нормализованный текст страницы отличается от предыдущего завершённого обхода.",
    "internal_links_changed": "Набор внутренних ссылок страницы отличается от предыдущего завершённого обхода.",
    "price_changed": "Точная цена однозначной товарной посадочной страницы отличается от предыдущего завершённого обхода.",
}
IMPORTANCE_TITLES = {"low": "Низкая", "medium": "Средняя", "high": "Высокая"}
NOT_RATED = "Не оценивалась"
VIEWED, NOT_VIEWED = "Просмотрено", "Не просмотрено"
STATE_TITLES = {"absent_side": "Сторона отсутствует", "none": "Нет значения", "empty_text": "Пустая строка", "empty_links": "Пустой список ссылок"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def feed(events: DataFrame, runs: DataFrame, sites: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """The columns of COLUMNS of events as diff.all_events() gives them, with an event_id that is unique within their source.

    views: source, event_id, viewed_at of the events that have been viewed.
    """
    run = runs.select(F.col("run_id").alias("current_run_id"), "site_id")
    site = sites.select("site_id", F.col("name").alias("site_name"), F.col("url").alias("site_url"), "site_type")
    return of_sites(events.join(run, "current_run_id").join(site, "site_id"), views)


def of_sites(named: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """feed() of events that have their site's columns already."""
    price = F.col("event_type") == "price_changed"
    named = named.withColumns({"source": F.when(price, "price").otherwise("snapshot"), "source_rank": F.when(price, 1).otherwise(0)})
    columns = [*COLUMNS, *(c for c in ("cur", "prev") if c in named.columns)]
    if views is None:
        return named.withColumn("viewed_at", F.lit(None).cast("timestamp")).select(*columns)
    return named.join(views.select("source", "event_id", "viewed_at"), ["source", "event_id"], "left").select(*columns)


def asked_pairs(pairs: DataFrame, sites: DataFrame, site_id: int | None = None, site_type: str | None = None, from_time: datetime | None = None, before_time: datetime | None = None) -> DataFrame:
    """The pairs of runs whose events such conditions of filtered() can let through: they are known before a page is read."""
    at = F.col("current_completed_at")
    if site_id is not None:
        pairs = pairs.where(F.col("site_id") == site_id)
    if from_time is not None:
        pairs = pairs.where(at >= F.lit(from_time))
    if before_time is not None:
        pairs = pairs.where(at < F.lit(before_time))
    return pairs if site_type is None else pairs.join(sites.where(F.col("site_type") == site_type).select("site_id"), "site_id", "left_semi")


def changes(pairs: DataFrame, pages: DataFrame, runs: DataFrame, sites: DataFrame, with_ids: Callable[[DataFrame], DataFrame], views: DataFrame | None = None, sides: bool = False, **conditions) -> DataFrame:
    """filtered(feed()) straight from the pages: only pairs that the conditions let through are compared, and only for the events that are asked for. with_ids adds event_id.

    Sites join the pairs, not the events, which are many for a page and hold its versions: they are dealt out no more. Nor
    are runs read for them: pairs know their site.
    """
    early = {k: v for k, v in conditions.items() if k in ("site_id", "site_type", "from_time", "before_time")}
    each = F.struct(F.col("name").alias("site_name"), F.col("url").alias("site_url"), "site_type")
    named = asked_pairs(pairs, sites, **early).join(sites.groupBy("site_id").agg(F.collect_list(each).alias("named")), "site_id")
    carried = ["site_id", "named"]
    events = with_ids(all_events(matched(named, pages, carried=carried), conditions.get("event_types"), sides, carried))
    return filtered(of_sites(events.select("*", F.inline("named")), views), **conditions)


def filtered(
    events: DataFrame,
    site_id: int | None = None,
    site_type: str | None = None,
    event_types: list[str] | None = None,
    importance: list[str] | None = None,
    from_time: datetime | None = None,
    before_time: datetime | None = None,
    viewed: bool | None = None,
) -> DataFrame:
    """Every given condition holds. Times have a zone and bound a half-open range; price events have no importance and drop out where it is asked for."""
    for t in (from_time, before_time):
        if t is not None and t.tzinfo is None:
            raise ValueError("a time must have a zone")
    if from_time is not None and before_time is not None and from_time >= before_time:
        raise ValueError("from_time must lie before before_time")
    if event_types is not None and set(event_types) - set(EVENT_TYPES):
        raise ValueError("an unknown event type")
    if importance is not None and set(importance) - {"low", "medium", "high"}:
        raise ValueError("an unknown importance")
    conditions = {
        "site": None if site_id is None else F.col("site_id") == site_id,
        "type": None if site_type is None else F.col("site_type") == site_type,
        "events": None if event_types is None else F.col("event_type").isin(*event_types),
        "importance": None if importance is None else F.col("importance").isin(*importance),
        "from": None if from_time is None else F.col("current_completed_at") >= F.lit(from_time),
        "before": None if before_time is None else F.col("current_completed_at") < F.lit(before_time),
        "viewed": None if viewed is None else F.col("viewed_at").isNotNull() if viewed else F.col("viewed_at").isNull(),
    }
    for c in conditions.values():
        events = events if c is None else events.where(c)
    return events


def local_days(events: DataFrame, first: str, last: str, zone: str) -> DataFrame:
    """Events of local days, both ends included."""
    at = F.col("current_completed_at")
    return events.where((at >= midnight_utc(F.to_date(F.lit(first)), zone)) & (at < midnight_utc(F.date_add(F.to_date(F.lit(last)), 1), zone)))


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("current_completed_at"), F.asc("source_rank"), F.desc("event_id"))


def page(events: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the feed. limit lies between 1 and 200; the page is the feature, so the rest isn't read out."""
    if isinstance(limit, bool) or isinstance(offset, bool) or not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must lie between 1 and 200, and offset not below 0")
    return ordered(events).offset(offset).limit(limit)


def page_count(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("long")


def exists(events: DataFrame) -> bool:
    return not events.isEmpty()


def amount_text(c: Column) -> Column:
    """A decimal without final zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def side(event_type: Column, url: Column, version: Column, raw: bool = False) -> Column:
    """struct(state, text, links, currency, low, high) of what an event shows of one side.

    state is absent_side, none, empty_text, text, empty_links, links, price or price_range. links: each once, sorted; or, raw,
    as the page has them.
    """
    value = F.when(event_type == "title_changed", version["title"]).when(event_type == "description_changed", version["description"]).when(event_type == "h1_changed", version["h1"]).otherwise(version["normalized_text"])
    whole = event_type.isin("page_added", "page_removed")
    price = F.when(event_type == "price_changed", price_profile(version["prices"]))
    state = (
        F.when(version.isNull(), "absent_side")
        .when(event_type == "price_changed", F.when(price["profile"] == "range", "price_range").otherwise("price"))
        .when(whole, "text")
        .when(event_type == "internal_links_changed", F.when(F.coalesce(F.size(version["internal_links"]), F.lit(0)) == 0, "empty_links").otherwise("links"))
        .when(value.isNull(), "none")
        .when(value == "", "empty_text")
        .otherwise("text")
    )
    text = F.when(state == "text", F.when(whole, url).otherwise(value))
    links = F.when(state == "links", version["internal_links"] if raw else F.sort_array(F.array_distinct(version["internal_links"])))
    return F.struct(state.alias("state"), text.alias("text"), links.alias("links"), price["currency"].alias("currency"), amount_text(price["low"]).alias("low"), amount_text(price["high"]).alias("high"))


def with_sides(events: DataFrame, pages: DataFrame | None = None, raw: bool = False) -> DataFrame:
    """events with current and previous sides, from the page versions that they carry (cur and prev), or else name; each is read once. raw: links as the pages have them."""
    kind, url = F.col("event_type"), F.col("url")
    if "cur" in events.columns and "prev" in events.columns:
        return events.withColumns({"current": side(kind, url, F.col("cur"), raw), "previous": side(kind, url, F.col("prev"), raw)}).drop("cur", "prev")
    version = F.struct("title", "description", "h1", "normalized_text", "internal_links", "prices")
    at = lambda key, name: pages.select(F.col("page_id").alias(key), version.alias(name))
    joined = events.join(at("current_page_id", "c"), "current_page_id", "left").join(at("previous_page_id", "p"), "previous_page_id", "left")
    return joined.withColumns({"current": side(kind, url, F.col("c"), raw), "previous": side(kind, url, F.col("p"), raw)}).drop("c", "p")


def faulty() -> Column:
    """Whether an event's sides contradict it: a side that must be there or not, a value of another kind of event, or equal values."""
    kind, here, before = F.col("event_type"), F.col("current.state") != "absent_side", F.col("previous.state") != "absent_side"
    own = lambda s: F.when(kind == "price_changed", s.isin("price", "price_range")).when(kind == "internal_links_changed", s.isin("links", "empty_links")).otherwise(s.isin("text", "none", "empty_text"))
    strange = (here & ~own(F.col("current.state"))) | (before & ~own(F.col("previous.state")))
    sides = F.when(kind == "page_added", here & ~before).when(kind == "page_removed", ~here & before).otherwise(here & before)
    value = lambda s: F.struct(s["state"].alias("s"), s["text"].alias("t"), F.sort_array(F.array_distinct(s["links"])).alias("l"))  # noqa: E731  links in whatever order
    same = ~kind.isin("page_added", "page_removed", "price_changed") & value(F.col("current")).eqNullSafe(value(F.col("previous")))
    return ~sides | strange | same


def inconsistent(events: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Events that the page versions they name contradict."""
    return with_sides(events, pages).where(faulty())


def verified(events: DataFrame) -> DataFrame:
    """with_sides() events, or an error at the first that is faulty: an export that meets one fails as a whole."""
    wrong = F.raise_error(F.concat(F.lit("an event contradicts its pages: "), F.col("event_type"), F.lit(" "), F.col("url"))).cast("boolean")
    return events.where(F.when(faulty(), wrong).otherwise(F.lit(True)))


def set_viewed(views: DataFrame, source: str, event_id: int, at: Column) -> DataFrame:
    """The event counts as viewed; the first time stays."""
    new = views.sparkSession.range(1).select(F.lit(source).alias("source"), F.lit(event_id).cast("long").alias("event_id"), at.alias("viewed_at"))
    return views.unionByName(new.join(views, ["source", "event_id"], "left_anti"))


def clear_viewed(views: DataFrame, source: str, event_id: int) -> DataFrame:
    return views.where(~((F.col("source") == source) & (F.col("event_id") == event_id)))


def safe_cell(c: Column) -> Column:
    """A spreadsheet takes no cell for a formula, and line breaks are CRLF."""
    text = F.regexp_replace(F.regexp_replace(c.cast("string"), "\r\n?", "\n"), "\n", "\r\n")
    return F.when(c.cast("string").rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def side_text(s: Column) -> Column:
    price = F.concat(F.concat_ws("–", s["low"], s["high"]), F.lit(" "), s["currency"])
    return F.when(s["state"] == "text", s["text"]).when(s["state"] == "links", F.array_join(s["links"], "\n")).when(s["state"].isin("price", "price_range"), price).otherwise(lookup(STATE_TITLES, s["state"]))


def csv_rows(events: DataFrame, zone: str = "UTC", *more: Column) -> DataFrame:
    """The 15 columns of the CSV export, cells made safe, and more. events: with_sides() of the feed."""
    local = lambda c: F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd'T'HH:mm:ss")
    cells = {
        "site_id": F.col("site_id"),
        "site_name": F.col("site_name"),
        "site_url": F.col("site_url"),
        "source": F.col("source"),
        "event_id": F.col("event_id"),
        "event_type": lookup(TITLES, F.col("event_type")),
        "detected_at": local("current_completed_at"),
        "url": F.col("url"),
        "importance": F.coalesce(lookup(IMPORTANCE_TITLES, F.col("importance")), F.lit(NOT_RATED)),
        "weight": F.coalesce(F.col("weight").cast("string"), F.lit("")),
        "explanation": lookup(EXPLANATIONS, F.col("event_type")),
        "view_status": F.when(F.col("viewed_at").isNull(), NOT_VIEWED).otherwise(VIEWED),
        "viewed_at": F.coalesce(local("viewed_at"), F.lit("")),
        "current": side_text(F.col("current")),
        "previous": side_text(F.col("previous")),
    }
    return events.select(*(safe_cell(c).alias(n) for n, c in cells.items()), *more)


def json_rows(events: DataFrame, *more: str) -> DataFrame:
    """value: an event's JSON object, for write.text(), nulls kept; and more columns of events."""
    fields = F.struct(
        "site_id", "site_name", "site_url", "source", "event_id", "event_type", utc_iso(F.col("current_completed_at")).alias("detected_at"), "url", "importance", F.col("weight").alias("importance_weight"), lookup(EXPLANATIONS, F.col("event_type")).alias("explanation"),
        F.col("viewed_at").isNotNull().alias("viewed"), utc_iso(F.col("viewed_at")).alias("viewed_at"), "current", "previous",
    )
    return events.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"), *more)


def write_csv(events: DataFrame, path: str, zone: str = "UTC") -> None:
    """A folder of parts; each is a whole CSV file with a byte order mark, the header, quotes where needed and CRLF line ends.

    Events are verified(), and path appears when all of them are written: a refused export leaves nothing, and the corrected
    one may take the same path. A path that is there already stays as it is and is an error.
    """
    rows = csv_rows(verified(events), zone)
    marked = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    with published(events.sparkSession, path) as staged:
        marked.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(staged)


def write_json(events: DataFrame, path: str) -> None:
    """A folder of parts, an event's JSON object to a line. Events are verified(), and path appears as write_csv()'s does."""
    with published(events.sparkSession, path) as staged:
        json_rows(verified(events)).write.text(staged)


def write_document(events: DataFrame, path: str, kind: str = "json", zone: str = "UTC") -> None:
    """One file: the JSON document, or CSV with one byte order mark and header, of all events in the order of the feed.

    Events are verified() and made to text in parallel; as one file has one writer, a last task sorts the lines, spilling
    what it can't hold, and passes them on batch by batch. The file appears when it is whole: a refused export leaves
    nothing. What path has already stays: it is an error.
    """
    spark = events.sparkSession
    if kind not in ("json", "csv"):
        raise ValueError("a document is json or csv")
    keys = ["current_completed_at", "source_rank", "event_id"]
    sound = verified(events)
    if kind == "json":
        lines, first, last, before = json_rows(sound, *keys), '{"schema_version":1,"events":[', "]}", ","
    else:
        cells = csv_rows(sound, zone)
        lines = csv_rows(sound, zone, *(F.col(k).alias(f"__{k}") for k in keys))
        lines = lines.select(F.to_csv(F.struct(*cells.columns), {"escape": '"', "nullValue": "", "emptyValue": ""}).alias("value"), *(F.col(f"__{k}").alias(k) for k in keys))
        first, last, before = "\ufeff" + ",".join(cells.columns), None, ""

    def of(batches):
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.string())], ["value"])
        begun = False
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t is not None]
            out = [t if k == 0 and not begun else before + t for k, t in enumerate(texts)]
            begun = begun or bool(texts)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.string())], ["value"])

    if storage.exists(spark, path):
        raise FileExistsError(path)
    staged = f"{path}.{uuid.uuid4().hex}"
    try:
        none = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema.fields))  # so that there is a task where there is no event
        one = lines.unionByName(none).repartition(1).sortWithinPartitions(F.desc_nulls_last(keys[0]), F.asc_nulls_last(keys[1]), F.desc_nulls_last(keys[2]))
        one.select("value").mapInArrow(of, "value string").write.option("lineSep", "\n" if kind == "json" else "\r\n").text(staged)
        (part,) = [f for f in files(spark, staged) if f.rsplit("/", 1)[-1].startswith("part-")]
        renamed(spark, part, path)
    finally:
        removed(spark, staged)


#: Events of an export that may be put together to one document on the driver.
DOCUMENT_EVENTS = 100_000


def json_document(path: str, spark, most: int = DOCUMENT_EVENTS) -> str:
    """The parts of write_json() as one document. More than so many events are an error: they stay in parts."""
    rows = [r["value"] for r in spark.read.text(path).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} events: take the parts")
    return '{"schema_version":1,"events":[' + ",".join(rows) + "]}\n"
