"""Posts: routing, duplicates within a batch and against the site, parents, attachments' fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemigrate.storage import dealt

#: The columns that are loaded, by the name in the export.
LOADED = {
    "post_id": "import_id", "post_author_id": "post_author", "post_date": "post_date", "post_date_gmt": "post_date_gmt", "post_content": "post_content", "post_excerpt": "post_excerpt", "post_title": "post_title",
    "status": "post_status", "post_name": "post_name", "comment_status": "comment_status", "ping_status": "ping_status", "guid": "guid", "post_parent": "post_parent", "menu_order": "menu_order", "post_type": "post_type", "post_password": "post_password",
}


def route_posts(posts: DataFrame, post_types: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``posts`` with ``route`` (reject, skip, menu, post) and ``reason``, by the first test that holds.

    An unknown type is rejected; an id handled before (``seen``: export_id, post_id), or by an earlier item of the same batch
    that isn't rejected or skipped, is skipped, and so is an automatic draft; menu items go their own way.
    """
    kinds = post_types.select(F.col("post_type").alias("__type")).distinct()
    out = posts.join(kinds, F.col("post_type") == F.col("__type"), "left")
    if seen is not None:
        before = seen.select("export_id", "post_id").distinct().withColumn("__seen", F.lit(True))
        out = out.join(before, ["export_id", "post_id"], "left")
    else:
        out = out.withColumn("__seen", F.lit(None).cast("boolean"))
    has_id = F.coalesce(F.col("post_id"), F.lit(0)) != 0
    reason = F.when(F.col("__type").isNull(), "invalid post type").when(has_id & F.col("__seen").isNotNull(), "already handled").when(F.col("status") == "auto-draft", "auto-draft")
    out = out.withColumn("reason", reason)
    handled = F.col("reason").isNull()
    alone = F.when(~has_id, F.col("doc_pos"))  # items without an id don't meet in one partition
    nth = F.sum(handled.cast("int")).over(Window.partitionBy("export_id", "post_id", alone).orderBy("doc_pos"))
    out = out.withColumn("__nth", F.when(has_id & handled, nth)).withColumn("reason", F.when(F.col("__nth") > 1, "already handled").otherwise(F.col("reason")))
    route = F.when(F.col("reason") == "invalid post type", "reject").when(F.col("reason").isNotNull(), "skip").when(F.col("post_type") == "nav_menu_item", "menu").otherwise("post")
    return out.withColumn("route", route).drop("__type", "__seen", "__nth")


def first_by_id(posts: DataFrame, id_col: str = "post_id") -> DataFrame:
    """Of items with one non-zero id, the first in document order; items without an id all stay."""
    nth = F.row_number().over(Window.partitionBy("export_id", id_col).orderBy("doc_pos"))
    with_id = posts.filter(F.coalesce(F.col(id_col), F.lit(0)) != 0).withColumn("__n", nth).filter("__n = 1").drop("__n")
    return with_id.unionByName(posts.filter(F.coalesce(F.col(id_col), F.lit(0)) == 0))


NATURAL_KEY = ["post_title", "post_date", "post_type"]


def match_existing(posts: DataFrame, site: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """``posts`` with ``existing_id``: the smallest id of a site post with the same title, date and type.

    A part of the key that is null is taken as empty, on both sides. ``override`` (export_id, post_id, existing_id) replaces the match; 0 forces an insert.
    """
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in NATURAL_KEY]
    known = site.groupBy(*key).agg(F.min("ID").alias("existing_id"))
    out = posts.select("*", *key).join(dealt(known), [f"__{c}" for c in NATURAL_KEY], "left").drop(*(f"__{c}" for c in NATURAL_KEY))
    if override is not None:
        out = out.join(override.select("export_id", "post_id", F.col("existing_id").alias("__override")), ["export_id", "post_id"], "left")
        out = out.withColumn("existing_id", F.nullif(F.coalesce("__override", "existing_id"), F.lit(0))).drop("__override")
    return out


def natural_first(posts: DataFrame) -> DataFrame:
    """``posts`` with ``first_pos``: the place of the first item in the batch with the same title, date and type."""
    key = [F.coalesce(F.col(c), F.lit("")) for c in NATURAL_KEY]
    named = posts.withColumn("__key", F.struct(*key))
    first = named.groupBy("export_id", "__key").agg(F.min("doc_pos").alias("first_pos"))
    return named.join(first, ["export_id", "__key"]).drop("__key")


def remap_parents(posts: DataFrame, id_map: DataFrame, parent_col: str = "post_parent", out: str = "new_parent") -> DataFrame:
    """``posts`` with the new id of their parent, 0 if unknown; one join serves references in both directions."""
    parents = id_map.select("export_id", F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
    joined = posts.join(dealt(parents), (posts["export_id"] == parents["export_id"]) & (F.col(parent_col) == F.col("__old")) & (F.col(parent_col) != 0), "left")
    return joined.select(posts["*"], F.coalesce("__new", F.lit(0)).cast("long").alias(out))


def loaded_columns(posts: DataFrame) -> DataFrame:
    """The columns that are loaded, under their names in the site."""
    return posts.select(*(F.col(c).alias(to) for c, to in LOADED.items() if c in posts.columns))


def upload_folder(postmeta: Column | str, post_date: Column | str) -> Column:
    """Year and month of an attachment: of its first ``_wp_attached_file``, else of its date; null for the zero date."""
    meta = F.col(postmeta) if isinstance(postmeta, str) else postmeta
    date = F.col(post_date) if isinstance(post_date, str) else post_date
    file = F.get(F.filter(meta, lambda m: m["key"] == "_wp_attached_file"), 0)["value"]
    of_file = F.nullif(F.regexp_extract(file, r"^(\d{4}/\d{2})", 1), F.lit(""))
    return F.coalesce(of_file, F.date_format(F.try_to_timestamp(F.nullif(date, F.lit("0000-00-00 00:00:00"))), "yyyy/MM"))


def attachment_source(attachment_url: Column | str, guid: Column | str, base_url: Column | str) -> Column:
    """The URL to fetch: the attachment's, else the guid; a path alone gets the base URL in front."""
    a, g, b = (F.col(c) if isinstance(c, str) else c for c in (attachment_url, guid, base_url))
    url = F.coalesce(F.nullif(a, F.lit("")), g)
    return F.when(url.rlike(r"^/[\w\W]+$"), F.concat(F.rtrim(b, F.lit("/")), url)).otherwise(url)


def sticky(posts: DataFrame) -> DataFrame:
    return posts.filter("is_sticky = 1").select("export_id", "post_id")


def key_report(batch: DataFrame, site: DataFrame) -> DataFrame:
    """Each distinct natural key of a batch with ``there``: whether the site has it."""
    keys = batch.select(*NATURAL_KEY).distinct()
    known = keys.intersect(site.select(*NATURAL_KEY))
    return known.withColumn("there", F.lit(True)).unionByName(keys.exceptAll(known).withColumn("there", F.lit(False)))
