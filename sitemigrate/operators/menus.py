"""Menu items: their menu, their object, their parent and their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemigrate.operators.meta import decode_serialized
from sitemigrate.storage import dealt

#: The metadata that describes a menu item.
KEYS = [f"_menu_item_{k}" for k in ("type", "menu_item_parent", "object_id", "object", "target", "classes", "xfn", "url")]


def menu_of(items: DataFrame, menus: DataFrame) -> DataFrame:
    """``items`` (with ``terms``) and the menu that their first ``nav_menu`` term names, or the ``reason`` why none.

    ``menus``: slug, menu_id. Columns added: menu_slug, menu_id, reason.
    """
    slug = F.get(F.filter("terms", lambda t: t["domain"] == "nav_menu"), 0)["slug"]
    joined = items.withColumn("menu_slug", slug).join(menus.select(F.col("slug").alias("menu_slug"), "menu_id"), "menu_slug", "left")
    return joined.withColumn("reason", F.when(F.col("menu_slug").isNull(), "missing menu slug").when(F.col("menu_id").isNull(), "invalid menu slug"))


def link_objects(items: DataFrame, terms: DataFrame, posts: DataFrame) -> DataFrame:
    """``items`` (export_id, item_type, object_id) with ``new_object_id``; items whose object isn't known get a ``reason``.

    Both maps are complete when links are made, so a second attempt isn't needed. ``terms`` and ``posts``: export_id,
    old_id, new_id. A custom item has no object.
    """
    of_terms = terms.select("export_id", F.col("old_id").alias("object_id"), F.col("new_id").alias("__term"))
    of_posts = posts.select("export_id", F.col("old_id").alias("object_id"), F.col("new_id").alias("__post"))
    joined = items.join(of_terms, ["export_id", "object_id"], "left").join(dealt(of_posts), ["export_id", "object_id"], "left")
    new = F.when(F.col("item_type") == "taxonomy", F.col("__term")).when(F.col("item_type") == "post_type", F.col("__post")).when(F.col("item_type") == "custom", F.coalesce("object_id", F.lit(0)))
    linked = joined.withColumn("new_object_id", new).drop("__term", "__post")
    missing = F.when(F.col("new_object_id").isNull(), "missing object")
    return linked.withColumn("reason", F.coalesce(F.col("reason"), missing) if "reason" in items.columns else missing)


def link_parents(items: DataFrame) -> DataFrame:
    """``items`` (export_id, item_id, parent_item, new_id) with ``new_parent``: the parent's new id, 0 if it wasn't imported."""
    parents = items.filter("reason IS NULL").select("export_id", F.col("item_id").alias("parent_item"), F.col("new_id").alias("__new"))
    return items.join(dealt(parents), ["export_id", "parent_item"], "left").withColumn("new_parent", F.coalesce("__new", F.lit(0)).cast("long")).drop("__new")


def css_classes(items: DataFrame, col: str = "classes") -> DataFrame:
    """Serialised lists of classes as one string, joined with blanks; other values as they are."""
    decoded = decode_serialized(items, col, "__json")
    joined = F.array_join(F.from_json("__json", "array<string>"), " ")
    return decoded.withColumn(col, F.when(F.col("__json").isNotNull(), F.coalesce(joined, F.lit(""))).otherwise(F.col(col))).drop("__json")
