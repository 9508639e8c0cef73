"""Sites and their availability checks: what a user enters, and what becomes of the stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.operators.neighbours import numbered
from pagetide.operators.runs import transferable

TYPES = ("competitor", "owned")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def site_errors(name: Column, url: Column) -> Column:
    """What is wrong with a site, in order: no name; and of its address the first of no url, space in url, bad port, no full url, credentials."""
    text = stripped(F.coalesce(url, F.lit("")))
    place = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    scheme, own = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_replace(place, "^.*@", "")
    port = F.regexp_extract(own, r"^(?:\[[^\]]*\]|[^:\[\]]*):(.*)$", 1)
    bracket = (F.contains(own, F.lit("[")) | F.contains(own, F.lit("]"))) & ~own.rlike(r"^\[[0-9A-Fa-f:.]+\](:.*)?$")
    bad = bracket | (port != "") & ~F.coalesce(port.rlike("^[0-9]+$") & (port.try_cast("long") <= 65535), F.lit(False))
    wrong = (
        F.when(text == "", "no url")
        .when(text.rlike(r"[\s\p{Z}]"), "space in url")
        .when(bad, "bad port")
        .when(~scheme.isin("http", "https") | (F.regexp_extract(own, r"^(\[[^\]]+\]|[^:]*)", 1) == ""), "no full url")
        .when(F.regexp_extract(place, "^(.*)@", 1).rlike("[^:]"), "credentials")
    )
    return F.array_compact(F.array(F.when(stripped(F.coalesce(name, F.lit(""))) == "", "no name"), wrong))


def added(sites: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """sites with the rows of new (name, url, site_type) after them, numbered on; a row with errors, or of an unknown type, stops it."""
    last = sites.agg(F.max("site_id")).first()[0] or 0
    wrong = F.when((F.size(site_errors(F.col("name"), F.col("url"))) > 0) | ~F.col("site_type").isin(*TYPES), F.raise_error(F.lit("a site can't be stored")).cast("long"))
    rows = numbered(new, "name", "url").select(F.coalesce(wrong, F.lit(last) + F.col("place")).alias("site_id"), stripped(F.col("name")).alias("name"), stripped(F.col("url")).alias("url"), "site_type", now.alias("created_at"))
    return sites.unionByName(rows)


def updated(sites: DataFrame, changes: DataFrame) -> DataFrame:
    """sites with the names and addresses that changes (site_id, name, url) gives; other sites, and what else a site has, stay."""
    new = changes.select("site_id", stripped(F.col("name")).alias("new_name"), stripped(F.col("url")).alias("new_url"))
    joined = sites.join(new, "site_id", "left")
    return joined.withColumns({"name": F.coalesce("new_name", "name"), "url": F.coalesce("new_url", "url")}).select(*sites.columns)


def transferred(sites: DataFrame, ids: DataFrame, source: str, target: str, *blocking: DataFrame) -> DataFrame:
    """sites after those of ids that are of the source type become the target's; an owned site with rows in a blocking table (site_id) stays."""
    if {source, target} != set(TYPES):
        raise ValueError("a transfer goes from one type to the other")
    free = ids.select("site_id").distinct()
    if source == "owned":
        free = transferable(free, *blocking)
    marked = sites.join(free.withColumn("moves", F.lit(True)), "site_id", "left")
    return marked.withColumn("site_type", F.when(F.col("moves") & (F.col("site_type") == source), target).otherwise(F.col("site_type"))).select(*sites.columns)


def backfilled(sites: DataFrame) -> DataFrame:
    """Sites from before there were types are competitors'."""
    return sites.withColumn("site_type", F.coalesce("site_type", F.lit(TYPES[0])))


def listed(sites: DataFrame, site_type: str | None = None) -> DataFrame:
    """Sites from the latest on, of one type or of all."""
    if site_type is not None and site_type not in TYPES:
        raise ValueError("an unknown type of site")
    own = sites if site_type is None else sites.where(F.col("site_type") == site_type)
    return own.orderBy(F.desc("created_at"), F.desc("site_id"))


def started_checks(sites: DataFrame, now: Column) -> DataFrame:
    """A running check (site_id, started_at, completed_at, status) for each site."""
    return sites.select("site_id", now.alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit("running").alias("status"))


def completed_checks(checks: DataFrame, results: DataFrame) -> DataFrame:
    """checks with what results (check_id, finished_at, result) says of them. A result without its check is an error; a check without a result goes on."""
    new = results.select("check_id", "finished_at", "result", F.lit(True).alias("told"))
    both = checks.join(new, "check_id", "full_outer")
    lost = F.raise_error(F.concat(F.lit("no such check: "), F.col("check_id").cast("string"))).cast("string")
    told = F.coalesce("told", F.lit(False))
    done = both.withColumns({"completed_at": F.when(told, F.col("finished_at")).otherwise(F.col("completed_at")), "status": F.when(told & F.col("started_at").isNull(), lost).when(told, F.col("result")).otherwise(F.col("status"))})
    return done.select(*checks.columns)
