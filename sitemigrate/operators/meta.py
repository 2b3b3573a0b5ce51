"""Post metadata: keys that are left out, references that follow their targets, serialised values, profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemigrate.functions.php_values import to_json
from sitemigrate.storage import dealt

#: Keys that are made anew by the site.
LEFT_OUT = ["_wp_attached_file", "_wp_attachment_metadata", "_edit_lock"]


def filter_keys(meta: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows whose key (``key`` may rewrite it; null or empty drops the row) is none of those left out."""
    own = F.when(F.col("key").isin(*LEFT_OUT), F.lit(None)).otherwise(F.col("key") if key is None else key)
    return meta.withColumn("key", own).filter((F.col("key") != "") & (F.col("key") != "0"))


def remap_references(meta: DataFrame, authors: DataFrame, posts: DataFrame) -> DataFrame:
    """``_edit_last`` takes the mapped user and goes where there is none; ``_thumbnail_id`` takes the new post id where known.

    ``authors``: export_id, author_id, user_id; ``posts``: export_id, old_id, new_id.
    """
    users = authors.select("export_id", F.col("author_id").cast("string").alias("value"), F.col("user_id").cast("string").alias("__user"))
    ids = posts.select("export_id", F.col("old_id").cast("string").alias("value"), F.col("new_id").cast("string").alias("__post"))
    last = meta.filter("key = '_edit_last'").join(users, ["export_id", "value"]).withColumn("value", F.col("__user")).select(*meta.columns)
    image = meta.filter("key = '_thumbnail_id'").join(dealt(ids), ["export_id", "value"], "left").withColumn("value", F.coalesce("__post", "value")).select(*meta.columns)
    return meta.filter("NOT coalesce(key, '') IN ('_edit_last', '_thumbnail_id')").unionByName(last).unionByName(image)


def append(site_meta: DataFrame, new: DataFrame, dedupe: bool = False) -> DataFrame:
    """Site metadata and new rows; a second import repeats rows, unless ``dedupe`` leaves out those that are there."""
    rows = new.select(*site_meta.columns)
    if dedupe:
        rows = rows.distinct().join(site_meta, [rows[c].eqNullSafe(site_meta[c]) for c in site_meta.columns], "left_anti")
    return site_meta.unionByName(rows)


def is_serialized(value: Column | str) -> Column:
    """Whether a value looks like a serialised one: null, or a typed scalar, string, array or object."""
    c = F.trim(value)
    return c.rlike(r"(?s)^(N;|[bid]:[^;]+;|s:\d+:\".*\";|[aOC]:\d+:.*\})$")


def decode_serialized(meta: DataFrame, value_col: str = "value", out: str = "value_json") -> DataFrame:
    """``meta`` with ``out``: serialised values as JSON, objects of any class as plain ones; null for other values and for
    those that can't be read. Each distinct value is decoded once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_json(x) for x in batch.column(0).to_pylist()], pa.string())], ["__value", out])

    distinct = meta.filter(is_serialized(F.col(value_col))).select(F.col(value_col).alias("__value")).distinct()
    decoded = distinct.mapInArrow(run, f"__value string, {out} string")
    return meta.join(decoded, F.col(value_col) == F.col("__value"), "left").drop("__value")


def key_profile(meta: DataFrame) -> DataFrame:
    return meta.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.sum((F.coalesce("value", F.lit("")) == "").cast("long")).alias("n_empty"))


def pivot(meta: DataFrame, keys: list[str], by: list[str], order: str = "ord") -> DataFrame:
    """One row for each ``by``, one column for each key with its last value."""
    return meta.filter(F.col("key").isin(*keys)).groupBy(*by).agg(*(F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col(order))).alias(k) for k in keys))
