"""Comments: one for each id, duplicates in the site, users and parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemigrate.storage import dealt


def last_by_id(comments: DataFrame) -> DataFrame:
    """Of comments of one post with one id, the last in document order."""
    rest = [c for c in comments.columns if c not in ("export_id", "post_doc_pos", "comment_id")]
    return comments.groupBy("export_id", "post_doc_pos", "comment_id").agg(F.max_by(F.struct(*rest), "ord").alias("c")).select("export_id", "post_doc_pos", "comment_id", "c.*")


def drop_known(comments: DataFrame, site_comments: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Comments without those that are there already by author and date, on any post, where their post was there before.

    There are the site's comments and, given an ``order`` of columns, those of ``comments`` that come before: all comments of
    a new post are loaded, and those of a post met again only if none like them came earlier. A null author or date is
    taken as empty. ``comments`` needs ``post_exists``, ``author`` and ``date``; ``site_comments`` has ``author`` and ``date``.
    """
    author, date = (F.coalesce(F.col(c), F.lit("")) for c in ("author", "date"))
    like = (author == F.col("__a")) & (date == F.col("__d"))
    known = site_comments.select(author.alias("__a"), date.alias("__d")).distinct()
    old = comments.filter("post_exists").join(dealt(known), like, "left_anti")
    if order is not None:
        first = comments.groupBy(author.alias("__a"), date.alias("__d")).agg(F.min(F.struct(*order)).alias("__first"))
        old = old.join(dealt(first), like & (F.struct(*order) == F.col("__first"))).drop("__a", "__d", "__first")
    return old.unionByName(comments.filter("NOT coalesce(post_exists, false)"))


def remap_users(comments: DataFrame, users: DataFrame) -> DataFrame:
    """``comments`` with ``new_user_id`` by the author's old id; null if unknown. ``users``: export_id, author_id, user_id."""
    known = users.select("export_id", F.col("author_id").alias("user_id"), F.col("user_id").alias("new_user_id")).filter("user_id <> 0")
    return comments.join(known, ["export_id", "user_id"], "left")


def remap_parents(comments: DataFrame, inserted: DataFrame) -> DataFrame:
    """``comments`` with ``new_parent`` (string): the new id of an inserted comment of the same post with a smaller id, else
    the old value as it was. ``inserted``: export_id, post_doc_pos, comment_id, new_id.
    """
    parents = inserted.select("export_id", "post_doc_pos", F.col("comment_id").alias("__parent"), F.col("new_id").alias("__new"))
    joined = comments.withColumn("__parent", F.col("parent").try_cast("bigint")).join(dealt(parents), ["export_id", "post_doc_pos", "__parent"], "left")
    new = F.when(F.col("__parent") < F.col("comment_id"), F.col("__new").cast("string"))
    return joined.withColumn("new_parent", F.coalesce(new, "parent")).drop("__parent", "__new")


def comment_counts(comments: DataFrame, by: str = "post_id") -> DataFrame:
    return comments.groupBy(by).agg(F.count("*").alias("n_comments"))


def loadable_meta(meta: DataFrame, inserted: DataFrame) -> DataFrame:
    """Metadata with key and value, of comments that were inserted."""
    return meta.filter("key IS NOT NULL AND value IS NOT NULL").join(dealt(inserted.select("export_id", "post_doc_pos", "comment_id", "new_id")), ["export_id", "post_doc_pos", "comment_id"])
