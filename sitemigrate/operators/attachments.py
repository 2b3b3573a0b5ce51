"""Attachments as tables: what to fetch, which results hold, file names, and the URLs to remap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemigrate.operators.ids import running_sum
from sitemigrate.operators.posts import attachment_source, upload_folder


def manifest(posts: DataFrame, headers: DataFrame) -> DataFrame:
    """(export_id, post_id, url, folder) for every attachment. ``posts`` has ``postmeta``."""
    joined = posts.filter("post_type = 'attachment'").join(headers.select("export_id", "base_url"), "export_id", "left")
    return joined.select("export_id", "post_id", attachment_source("attachment_url", "guid", "base_url").alias("url"), upload_folder("postmeta", "post_date").alias("folder"))


def validate_fetches(results: DataFrame, size_limit: int = 0) -> DataFrame:
    """``results`` with ``reason``: the first rule that a fetch breaks, null if it holds.

    Columns used: error, status, has_headers, file_size, content_length, content_encoding. A limit of 0 is none.
    """
    differs = F.col("content_length").isNotNull() & F.col("content_encoding").isNull() & (F.col("content_length") != F.col("file_size"))
    rules = [
        (F.col("error").isNotNull(), "request failed"), (F.coalesce(F.col("status"), F.lit(0)) != 200, "unexpected status"), (~F.coalesce(F.col("has_headers"), F.lit(False)), "no response"),
        (F.coalesce(F.col("file_size"), F.lit(0)) == 0, "empty file"), (differs, "wrong size"), (F.lit(size_limit > 0) & (F.col("file_size") > size_limit), "too large"),
    ]
    reason = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        reason = F.when(broken, name).otherwise(reason)
    return results.withColumn("reason", reason)


def disposition_name(header: Column) -> Column:
    """The file name of a Content-Disposition header, without its quotes; null if it names none."""
    found = F.trim(F.regexp_extract(header, r"^[^;]*;(?:.*;)?\s*filename\s*=([^;]*)", 1))
    quoted = F.regexp_extract(found, r'^"(.*)"$', 1)
    return F.nullif(F.when(found.rlike(r'^".*"$'), quoted).otherwise(found), F.lit(""))


def file_name(url: Column, disposition: Column) -> Column:
    """The header's name, else the URL's last path part, else the MD5 of the URL."""
    base = F.nullif(F.regexp_extract(url, r"^[^?#]*/([^/?#]+)/*(?:[?#].*)?$", 1), F.lit(""))
    host_only = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/*(?:[?#].*)?$")
    return F.coalesce(disposition_name(disposition), F.when(~host_only, base), F.md5(url))


def name_files(fetched: DataFrame, mime_types: DataFrame) -> DataFrame:
    """``fetched`` (url, content_disposition, content_type, folder) with ``file_name``, ``extension`` and ``allowed``.

    ``mime_types``: mime_type, extensions (alternatives with ``|``). A name without an extension gets the first one of its
    type; allowed are the extensions of the table.
    """
    first = mime_types.groupBy(F.lower("mime_type").alias("__mime")).agg(F.min(F.split("extensions", r"\|")[0]).alias("__ext"))
    known = mime_types.select(F.explode(F.split(F.lower("extensions"), r"\|")).alias("__known")).distinct()
    named = fetched.withColumn("file_name", file_name(F.col("url"), F.col("content_disposition"))).withColumn("__mime", F.lower(F.trim(F.split("content_type", ";")[0])))
    named = named.join(first, "__mime", "left")
    bare = ~F.col("file_name").rlike(r"\.[A-Za-z0-9]+$")
    named = named.withColumn("file_name", F.when(bare & F.col("__ext").isNotNull(), F.concat("file_name", F.lit("."), "__ext")).otherwise(F.col("file_name")))
    named = named.withColumn("extension", F.lower(F.regexp_extract("file_name", r"\.([A-Za-z0-9]+)$", 1)))
    out = named.join(known, F.col("extension") == F.col("__known"), "left")
    return out.withColumn("allowed", F.col("__known").isNotNull()).drop("__mime", "__ext", "__known")


STEM = r"^(.*?)(\.[A-Za-z0-9]+)?$"


def unique_names(files: DataFrame, order: str = "post_id", existing: DataFrame | None = None) -> DataFrame:
    """``files`` with ``unique_name``, no two alike in a folder, whatever the case of letters.

    The first file of a name keeps it, unless ``existing`` (folder, file_name: the site's files) has it. Every other one gets
    the next free of ``-1``, ``-2`` and so on before its extension; names of other files and of the site aren't free.

    Files of one name, and numbers that are taken, may be any number: both are counted by ranges (``running_sum``). The j-th
    number taken, u, leaves u - j free ones before it; so the n-th free number is n and one for each taken one that leaves
    fewer than n. That count is a running sum over files and taken numbers put in one order.
    """
    spark, at = files.sparkSession, ["__folder", "__name"]
    key = [F.coalesce(F.col("folder"), F.lit("")).alias("__folder"), F.lower("file_name").alias("__name")]
    there = files.select(*key, F.lit(False).alias("__site"))
    if existing is not None:
        there = there.unionByName(existing.select(*key, F.lit(True).alias("__site")))
    names = there.groupBy("__folder", "__name").agg(F.max("__site").alias("__site"))
    stem, extension = F.regexp_extract("__name", STEM, 1), F.regexp_extract("__name", STEM, 2)
    number = F.regexp_extract(stem, r"^.*-([1-9][0-9]{0,8})$", 1)
    used = names.filter(number != "").select("__folder", F.concat(F.regexp_replace(stem, r"-[0-9]+$", ""), extension).alias("__name"), number.try_cast("int").alias("__used"))
    used = running_sum(spark, used.distinct(), at, ["__used"], F.lit(1), "__j").select(*at, (F.col("__used") - F.col("__j")).alias("__n"), F.lit(1).alias("__taken"))
    known = names.join(used.select(*at, F.lit(True).alias("__numbered")).distinct(), at, "left")
    ranked = running_sum(spark, files.select("*", *key).join(known, at), at, [order], F.lit(1), "__n").withColumn("__n", F.col("__n") - F.when(F.col("__site"), 0).otherwise(1))
    meets = F.col("__numbered").isNotNull() & (F.col("__n") > 0)
    met = ranked.filter(meets).withColumn("__taken", F.lit(0)).unionByName(used, allowMissingColumns=True)
    met = running_sum(spark, met, at, ["__n", "__taken"], F.col("__taken"), "__skipped").filter("__taken = 0").drop("__taken")
    ranked = ranked.filter(~meets).withColumn("__skipped", F.lit(0).cast("long")).unionByName(met)
    free = F.col("__n") + F.col("__skipped")
    name = F.concat(F.regexp_extract("file_name", STEM, 1), F.lit("-"), free.cast("string"), F.regexp_extract("file_name", STEM, 2))
    return ranked.withColumn("unique_name", F.when(F.col("__n") == 0, F.col("file_name")).otherwise(name)).select(*files.columns, "unique_name")


def remap_rows(done: DataFrame) -> DataFrame:
    """(export_id, ord, from_url, to_url) of fetched attachments: their URL, their guid, and where the request was sent on to."""
    row = lambda i, c: F.struct((F.col("post_id") * 3 + i).alias("ord"), F.col(c).alias("from_url"), F.col("new_url").alias("to_url"))
    return done.select("export_id", F.explode(F.array(row(0, "url"), row(1, "guid"), row(2, "final_location"))).alias("r")).select("export_id", "r.*").filter("coalesce(from_url, '') <> ''")


def without_failed(posts: DataFrame, checked: DataFrame) -> DataFrame:
    """Posts without those attachments whose fetch broke a rule."""
    return posts.join(checked.filter("reason IS NOT NULL").select("export_id", "post_id"), ["export_id", "post_id"], "left_anti")
