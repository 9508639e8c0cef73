"""The engine's functions for queries that are written in SQL.

    register(spark)
    spark.sql("SELECT url, link FROM explode_links(TABLE(SELECT url, html FROM pages))")
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagetide.functions import text, urls
from pagetide.sources.pages import internal_links

LINKS = "url string, position int, link string"


@F.arrow_udtf(returnType=LINKS)
class ExplodeLinks:
    """A row for each internal link of a page, once, in order. The table's first two columns are the page's address and html; pages without html, or whose address isn't absolute http(s), give no rows."""

    def eval(self, batch: pa.RecordBatch):
        out: tuple[list, list, list] = ([], [], [])
        for url, html in zip(batch.column(0), batch.column(1), strict=True):
            url, html = url.as_py(), html.as_py()
            if html is None or urls.normalized(url) is None:
                continue
            for position, link in enumerate(internal_links(html, url, None)[0]):
                for column, value in zip(out, (url, position, link), strict=True):
                    column.append(value)
        yield pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["url", "position", "link"])


#: Names in SQL; strings to strings, null to null.
SCALARS = {
    "normalize_url": urls.normalize_url,
    "url_host": urls.host_of,
    "external_url": urls.external_url,
    "normalize_text": text.normalize_main_text,
    "readable_text": text.normalize_readable_text,
    "fold_case": text.casefold,
    "edit_distance": text.long_distance,
}


def register(spark: SparkSession) -> None:
    """SCALARS and explode_links under their names, for this session. Registering again changes nothing."""
    for name, function in SCALARS.items():
        spark.udf.register(name, function)
    spark.udtf.register("explode_links", ExplodeLinks)
