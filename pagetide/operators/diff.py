"""Snapshot comparison: typed change events between consecutive completed runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.functions import ratio
from pagetide.functions.decimals import decoded
from pagetide.functions.text import distance
from pagetide.schemas import EVENT_COLUMNS, EVENT_TYPES

COMPARED = ["page_id", "title", "description", "h1", "normalized_text", "internal_links", "prices"]
#: What each metadata change weighs, in the order of the events.
METADATA_WEIGHTS = {"title": 3, "description": 2, "h1": 3}


def unique_urls(pages: DataFrame) -> DataFrame:
    """pages, or an error where a run has a url twice."""
    n = pages.groupBy("run_id", "url").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in pages.columns if c not in ("run_id", "url")))
    return n.withColumn("url", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("a run has a url twice: "), "url")).cast("string")).otherwise(F.col("url"))).drop("n")


def versions(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Snapshots with their prices as a list in order; an amount that isn't canonical becomes null."""
    amount = F.when(decoded(F.col("amount")).isNotNull(), F.col("amount"))
    each = prices.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("sequence_number", amount.alias("amount"), "currency", "kind", "source"))).alias("p"))
    listed = F.transform("p", lambda p: F.struct(p["amount"].alias("amount"), p["currency"].alias("currency"), p["kind"].alias("kind"), p["source"].alias("source")))
    empty = F.array().cast("array<struct<amount: string, currency: string, kind: string, source: string>>")
    return records.join(each, "page_id", "left").withColumn("prices", F.coalesce(listed, empty)).drop("p")


#: Bits of what perhaps_paired() knows of runs, 32,768 to a row of 4 KB: 16 MB of bits at most, however many runs there are.
RUN_BITS = 1 << 27


def perhaps_paired(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """rows without most of those whose run (key, a whole number) is in no pair: no row of a run in a pair is lost, a share of the others may stay (with 26 million runs in pairs about 18 of 100, by computation), which a join with the pairs then drops.

    A bit for each hash of a run is sent to the rows before they are dealt out.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(RUN_BITS)) + 1
    known = pairs.where(F.col("previous_run_id").isNotNull())
    runs = known.select(F.explode(F.array("current_run_id", "previous_run_id")).alias("run_id")).select(place(F.col("run_id")).alias("at"))
    bits = runs.groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    at = F.bitmap_bit_position(place(F.col(key)))
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = (F.bitmap_bucket_number(place(F.col(key))) == F.col("__bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return rows.join(F.broadcast(bits), near, "left_semi")


def matched(pairs: DataFrame, pages: DataFrame, compared: list[str] | None = None, carried: Iterable[str] = ()) -> DataFrame:
    """current_run_id, previous_run_id, current_completed_at, url, cur, prev: the pages of both runs of each pair by url; and the columns of pairs that are carried, which follow from the site.

    pairs: as predecessors() gives them, all or some; baselines take no part. The versions of a url of a site lie in the
    order of their runs, so that a page's other version is its neighbour if it is anywhere: each page is read, dealt out and
    sorted once, for the pair it is new in and the one it is old in; pages that are dealt out by their run already join its
    pairs where they lie. A pair whose current run has no pages still has its
    previous ones. A url that a run has twice is an error.
    """
    columns = [c for c in (compared or COMPARED) if c in pages.columns]
    known = pairs.where(F.col("previous_run_id").isNotNull())
    site = ["site_id", *(c for c in carried if c != "site_id")]
    new = known.select(F.col("current_run_id").alias("run_id"), "previous_run_id", F.col("current_completed_at").alias("new_at"), F.struct(*site).alias("new_site"))
    old = known.select(F.col("previous_run_id").alias("run_id"), F.col("current_run_id").alias("next_run_id"), F.col("current_completed_at").alias("next_at"), F.struct(*site).alias("old_site"))
    current, previous = F.col("previous_run_id").isNotNull(), F.col("next_run_id").isNotNull()
    roles = pages.select("run_id", "url", F.struct(*columns).alias("version")).join(new, "run_id", "left").join(old, "run_id", "left").where(current | previous)
    of_site = F.coalesce("new_site", "old_site")
    # A run that is only the previous one of a pair lies right before that pair's current run: it has no previous_run_id.
    place = {"at": F.when(current, F.col("new_at")).otherwise(F.col("next_at")), "id": F.when(current, F.col("run_id")).otherwise(F.col("next_run_id"))}
    dealt = roles.select("run_id", "url", "version", "previous_run_id", "next_run_id", "next_at", *(c.alias(k) for k, c in place.items()), *(of_site[c].alias(c) for c in site))
    order = W.partitionBy("site_id", "url").orderBy("at", "id", F.asc_nulls_first("previous_run_id"))
    before, after = F.lag("run_id").over(order), F.lead("run_id").over(order)
    rows = dealt.withColumns({"before": before, "after": after, "earlier": F.lag("version").over(order)})
    twice = F.raise_error(F.concat(F.lit("a run has a url twice: "), "url")).cast("boolean")
    none = F.lit(None)
    kind = rows.schema["version"].dataType
    entry = lambda run, other, at, cur, prev: F.struct(F.col(run).alias("current_run_id"), F.col(other).alias("previous_run_id"), F.col(at).alias("current_completed_at"), "url", cur.cast(kind).alias("cur"), prev.cast(kind).alias("prev"), *carried)
    present = F.when(current, entry("run_id", "previous_run_id", "at", F.col("version"), F.when(F.col("before") == F.col("previous_run_id"), F.col("earlier"))))
    gone = F.when(previous & ~F.col("after").eqNullSafe(F.col("next_run_id")), entry("next_run_id", "run_id", "next_at", none, F.col("version")))
    checked = rows.where(F.when(F.col("before") == F.col("run_id"), twice).otherwise(F.lit(True)))
    return checked.select(F.explode(F.array_compact(F.array(present, gone))).alias("m")).select("m.*")


def one_sided(pairs: DataFrame, pages: DataFrame, added: bool) -> DataFrame:
    """current_run_id, previous_run_id, url, page_id of pages that only the current run of a pair has, or only the previous one; nothing else of a page is read."""
    known = pairs.where(F.col("previous_run_id").isNotNull()).select("current_run_id", "previous_run_id")
    near, far = ("current_run_id", "previous_run_id") if added else ("previous_run_id", "current_run_id")
    own = known.join(pages.select(F.col("run_id").alias(near), "url", "page_id"), near)
    return own.join(pages.select(F.col("run_id").alias(far), "url"), [far, "url"], "left_anti").select("current_run_id", "previous_run_id", "url", "page_id")


def with_ratio(rows: DataFrame, part: str, whole: str, name: str, **more: Column) -> DataFrame:
    """rows with name: struct(more, num, den), the ratio of two columns in lowest terms, or null where the part isn't positive. Each value is a column of its own, as what a condition guards would be computed once for each use of it."""
    some, g = F.col(part) > 0, f"{name}__gcd"
    rows = rows.withColumn(g, F.when(some, ratio.gcd(F.col(part), F.col(whole))))
    lowest = {k: F.expr(f"{c} div {g}") for k, c in (("num", part), ("den", whole))}
    return rows.withColumn(name, F.when(some, F.struct(*(c.alias(k) for k, c in {**more, **lowest}.items())))).drop(g)


def with_text_change(rows: DataFrame, cur: Column, prev: Column, name: str) -> DataFrame:
    """rows with name: struct(distance, num, den), or null if the texts are the same or one is missing. Hashes that are stored aren't trusted: the texts are compared."""
    differ = cur.isNotNull() & prev.isNotNull() & (cur != prev)
    part, whole = f"{name}__distance", f"{name}__whole"
    rows = rows.withColumns({part: F.when(differ, distance(cur, prev)), whole: F.when(differ, F.greatest(F.length(cur), F.length(prev)))})
    return with_ratio(rows, part, whole, name, distance=F.col(part)).drop(part, whole)


def with_link_change(rows: DataFrame, cur: Column, prev: Column, name: str) -> DataFrame:
    """rows with name: struct(added, removed, num, den), or null if the sets are the same or one is missing. A pass over both lists for each side, and one over the first where they differ; only what changed is sorted."""
    added, removed, part, whole = (f"{name}__{x}" for x in ("added", "removed", "moved", "whole"))
    rows = rows.withColumns({added: F.array_except(cur, prev), removed: F.array_except(prev, cur)})
    rows = rows.withColumn(part, F.when(F.col(added).isNotNull(), F.size(added) + F.size(removed)))
    rows = rows.withColumn(whole, F.when(F.col(part) > 0, F.size(F.array_distinct(cur)) + F.size(removed)))
    return with_ratio(rows, part, whole, name, added=F.sort_array(added), removed=F.sort_array(removed)).drop(added, removed, part, whole)


def price_profile(prices: Column) -> Column:
    """struct(profile, currency, low, high) of one plain price, or of one low and one high of the same currency in that order; else null."""
    amount = lambda p: decoded(p["amount"])
    sound = F.forall(prices, lambda p: F.coalesce(amount(p) >= 0, F.lit(False)) & (F.coalesce(p["currency"], F.lit("")) != ""))
    low, high = F.filter(prices, lambda p: p["kind"] == "low"), F.filter(prices, lambda p: p["kind"] == "high")
    none = F.lit(None).cast("decimal(38,18)")
    single = F.struct(F.lit("price").alias("profile"), F.get(prices, F.lit(0))["currency"].alias("currency"), amount(F.get(prices, F.lit(0))).alias("low"), none.alias("high"))
    a, b = F.get(low, F.lit(0)), F.get(high, F.lit(0))
    pair = F.struct(F.lit("range").alias("profile"), a["currency"].alias("currency"), amount(a).alias("low"), amount(b).alias("high"))
    two = (F.size(prices) == 2) & (F.size(low) == 1) & (F.size(high) == 1) & (a["currency"] == b["currency"]) & (amount(a) <= amount(b))
    return F.when(sound & (F.size(prices) == 1) & (F.get(prices, F.lit(0))["kind"] == "price"), single).when(sound & two, pair)


def all_events(pages: DataFrame, kinds: Iterable[str] | None = None, sides: bool = False, carried: Iterable[str] = ()) -> DataFrame:
    """Snapshot and price events of matched() pages in one pass, a list of events to a page.

    The columns of EVENT_COLUMNS, price_profile and price_currency; with sides, also cur and prev; and those carried. A field that pages don't
    carry isn't compared, and nothing is computed for events that aren't among kinds.
    """
    asked = set(EVENT_TYPES if kinds is None else kinds)
    cur, prev = F.col("cur"), F.col("prev")
    fields = [f.name for f in pages.schema["cur"].dataType.fields]
    none, long, word = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("string")

    def event(kind, weight, when, text_distance=none, num=long, den=long, profile=word, currency=word):
        values = {"weight": weight.cast("int"), "text_distance": text_distance.cast("int"), "ratio_numerator": num.cast("long"), "ratio_denominator": den.cast("long"), "price_profile": profile, "price_currency": currency}
        return F.when(when, F.struct(F.lit(kind).alias("event_type"), *(v.alias(k) for k, v in values.items())))

    both = cur.isNotNull() & prev.isNotNull()
    events = [event("page_added", F.lit(2), prev.isNull()), event("page_removed", F.lit(3), cur.isNull())]
    events = [e for e, kind in zip(events, ("page_added", "page_removed"), strict=True) if kind in asked]
    events += [event(f"{f}_changed", F.lit(w), both & ~cur[f].eqNullSafe(prev[f])) for f, w in METADATA_WEIGHTS.items() if f in fields and f"{f}_changed" in asked]
    rows = pages
    if "normalized_text" in fields and "text_changed" in asked:
        rows = with_text_change(rows, cur["normalized_text"], prev["normalized_text"], "__text")
        t = F.col("__text")
        events.append(event("text_changed", F.when(t.isNotNull(), ratio.weight(t["num"], t["den"])), t.isNotNull(), t["distance"], t["num"], t["den"]))
    if "internal_links" in fields and "internal_links_changed" in asked:
        rows = with_link_change(rows, cur["internal_links"], prev["internal_links"], "__links")
        k = F.col("__links")
        events.append(event("internal_links_changed", F.when(k.isNotNull(), ratio.weight(k["num"], k["den"])), k.isNotNull(), none, k["num"], k["den"]))
    if "prices" in fields and "price_changed" in asked:
        c, p = F.when(both, price_profile(cur["prices"])), F.when(both, price_profile(prev["prices"]))
        rows = rows.withColumns({"__new": c, "__old": p})
        c, p = F.col("__new"), F.col("__old")
        events.append(event("price_changed", none, price_moved(c, p), profile=c["profile"], currency=c["currency"]))
    more = [*(["cur", "prev"] if sides else []), *carried]
    listed = rows.select("*", F.explode(F.array_compact(F.array(*events))).alias("e"))
    flat = listed.select("current_run_id", "previous_run_id", "url", cur["page_id"].alias("current_page_id"), prev["page_id"].alias("previous_page_id"), "current_completed_at", ratio.importance(F.col("e.weight")).alias("importance"), "e.*", *more)
    return flat.select(*EVENT_COLUMNS, "price_profile", "price_currency", *more)


def price_moved(c: Column, p: Column) -> Column:
    """Whether a profile kept its kind and currency and changed its amounts."""
    same = (c["profile"] == p["profile"]) & (c["currency"] == p["currency"])
    return F.coalesce(same & ~(c["low"].eqNullSafe(p["low"]) & c["high"].eqNullSafe(p["high"])), F.lit(False))


def snapshot_events(pages: DataFrame) -> DataFrame:
    """The columns of EVENT_COLUMNS for each change but those of prices."""
    version = [f.name for f in pages.schema["cur"].dataType.fields if f.name != "prices"]
    trim = lambda name: F.when(F.col(name).isNotNull(), F.struct(*(F.col(name)[f].alias(f) for f in version)))
    return all_events(pages.withColumns({"cur": trim("cur"), "prev": trim("prev")})).select(*EVENT_COLUMNS)


def price_events(pages: DataFrame) -> DataFrame:
    """A row for each page whose price profile kept its kind and currency and changed its amounts; where a price is stated doesn't matter."""
    rows = pages.where(F.col("cur").isNotNull() & F.col("prev").isNotNull()).withColumns({"c": price_profile(F.col("cur.prices")), "p": price_profile(F.col("prev.prices"))})
    return rows.where(price_moved(F.col("c"), F.col("p"))).select("current_run_id", "previous_run_id", "url", F.col("cur.page_id").alias("current_page_id"), F.col("prev.page_id").alias("previous_page_id"), "current_completed_at", F.col("c.profile").alias("price_profile"), F.col("c.currency").alias("price_currency"), F.col("p.low").alias("previous_low"), F.col("c.low").alias("current_low"), F.col("p.high").alias("previous_high"), F.col("c.high").alias("current_high"))


def page_importance(events: DataFrame) -> DataFrame:
    """A changed page weighs as much as its heaviest change."""
    top = events.groupBy("current_run_id", "url").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("changes"))
    return top.withColumn("importance", ratio.importance(F.col("weight")))


EVENT_KEY = ("current_run_id", "previous_run_id", "event_type", "url")
PRICE_KEY = ("current_run_id", "previous_run_id", "url")


def new_events(events: DataFrame, stored: DataFrame, key: tuple[str, ...] = EVENT_KEY) -> DataFrame:
    """Events that aren't stored yet: appending them twice changes nothing."""
    return events.join(stored.select(*key), list(key), "left_anti")


def broken_sequence(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Events whose runs no longer follow each other, as a completed run has since landed between them."""
    from pagetide.operators.runs import predecessors

    now = predecessors(runs).select("current_run_id", F.col("previous_run_id").alias("now_previous"))
    return events.join(now, "current_run_id", "left").where(~F.col("previous_run_id").eqNullSafe(F.col("now_previous"))).drop("now_previous")


def process(runs: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot events and price events of all completed runs."""
    from pagetide.operators.runs import predecessors

    rows = matched(predecessors(runs), pages)
    return snapshot_events(rows), price_events(rows)
