"""Table functions for SQL: URL occurrences of a piece of HTML, and the parsed rows of export items.

``register`` gives them names in a session; they are then called beside a table, once for each of its rows:

    SELECT page_id, u.decoded FROM pages, LATERAL url_occurrences(html) u
    SELECT i.post_id FROM items, LATERAL export_item(item_xml, root_tag) i

Spark takes no Arrow table function beside a table (LATERAL), so rows pass one by one; ``extract_urls`` and ``parse_items`` do the
same work in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sitemigrate import schema
from sitemigrate.functions import item_xml, markup

ITEM_COLUMNS = [*schema.POST_STRINGS, *schema.POST_NUMBERS, "terms", "postmeta", "comments", "failed_casts", "error"]
OCCURRENCES = "ord int, kind string, start int, end int, raw string, decoded string, tld string"


class UrlOccurrences:
    """One row for each URL of the HTML, in order of place; ``tld`` is a domain to check where no scheme was given."""

    def eval(self, html: str) -> Iterator[tuple]:
        for ord_, found in enumerate(markup.occurrences(html or "")):
            yield ord_, *found


class ExportItem:
    """The typed row of an export item (see ``schema.ITEM``), names resolved by its file's root tag; ``error`` if it isn't XML."""

    def eval(self, xml: str, root_tag: str) -> Iterator[tuple]:
        try:
            row = item_xml.parse_item(root_tag or "", xml or "")
        except (item_xml.ET.ParseError, ValueError) as e:
            row = {"error": str(e)}
        row["failed_casts"] = dict(row["failed_casts"]) if "failed_casts" in row else None
        yield tuple(row.get(name) for name in ITEM_COLUMNS)


def register(spark: SparkSession) -> None:
    """Names ``url_occurrences(html)`` and ``export_item(item_xml, root_tag)`` in a session."""
    spark.udtf.register("url_occurrences", F.udtf(UrlOccurrences, returnType=OCCURRENCES, useArrow=False))
    spark.udtf.register("export_item", F.udtf(ExportItem, returnType=schema.ITEM, useArrow=False))
