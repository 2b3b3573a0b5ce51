"""Authors: declared or inferred, and mapped to users of the target site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sanitize_login(login: Column | str) -> Column:
    """A login as it is compared: tags, percent and entity escapes and odd characters go, blanks are squeezed.

    The host application's exact rule is not public here; this is the documented one.
    """
    c = F.col(login) if isinstance(login, str) else login
    c = F.regexp_replace(c, r"<[^>]*>", "")
    c = F.regexp_replace(c, r"%[0-9A-Fa-f]{2}|&[A-Za-z0-9#]+;", "")
    c = F.regexp_replace(c, r"[^A-Za-z0-9 _.\-@]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def last_by_login(authors: DataFrame) -> DataFrame:
    """Of authors of one export with one login, the last in document order."""
    rest = [c for c in authors.columns if c not in ("export_id", "author_login")]
    return authors.groupBy("export_id", "author_login").agg(F.max_by(F.struct(*rest), F.struct("doc_pos", "ord")).alias("a")).select("export_id", "author_login", "a.*")


def infer_authors(posts: DataFrame) -> DataFrame:
    """One author for each sanitised login among the posts' authors, shown as at the first post; empty logins fail.

    Columns: export_id, author_login, author_display_name, failed.
    """
    named = posts.withColumn("author_login", sanitize_login("post_author"))
    first = named.groupBy("export_id", "author_login").agg(F.min_by("post_author", "doc_pos").alias("author_display_name"))
    return first.withColumn("failed", F.coalesce(F.col("author_login") == "", F.lit(True)))


def map_authors(authors: DataFrame, policy: DataFrame, users: DataFrame, versions: DataFrame, default_user: int, create_users: bool = True) -> DataFrame:
    """The user for each author of an export: (export_id, author_login, author_id, how, user_id, new_login).

    ``policy`` (export_id, author_login, use_login, new_login) says which existing user an author becomes, or the name
    of a new one. Otherwise a user is made from the export's data, unless its format is 1.0 or users may not be made: then
    the default user stands in. ``users`` is (user_id, user_login). ``how`` is existing, named, created or default.
    """
    own = authors.select("export_id", "author_id", sanitize_login("author_login").alias("author_login"))
    asked = policy.select("export_id", sanitize_login("author_login").alias("author_login"), "use_login", "new_login")
    joined = own.join(asked, ["export_id", "author_login"], "left").join(users.withColumnRenamed("user_login", "use_login"), "use_login", "left").join(versions.select("export_id", "version"), "export_id", "left")
    may = F.lit(create_users)
    how = (
        F.when(F.col("user_id").isNotNull(), "existing").when(may & (F.coalesce("new_login", F.lit("")) != ""), "named")
        .when(may & (F.coalesce("version", F.lit("")) != "1.0") & (F.col("author_login") != ""), "created").otherwise("default")
    )
    out = joined.withColumn("how", how).withColumn("user_id", F.when(F.col("how") == "existing", F.col("user_id")).when(F.col("how") == "default", F.lit(default_user)))
    return out.select("export_id", "author_login", "author_id", "how", "user_id", F.when(F.col("how") == "named", F.col("new_login")).when(F.col("how") == "created", F.col("author_login")).alias("new_login"))


def remap_post_authors(posts: DataFrame, mapped: DataFrame, default_user: int) -> DataFrame:
    """``posts`` with ``post_author_id``: the mapped user, or the default one."""
    users = mapped.select("export_id", F.col("author_login").alias("__login"), F.col("user_id").alias("__user"))
    joined = posts.withColumn("__login", sanitize_login("post_author")).join(users, ["export_id", "__login"], "left")
    return joined.withColumn("post_author_id", F.coalesce("__user", F.lit(default_user)).cast("long")).drop("__login", "__user")
