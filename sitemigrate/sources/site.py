"""Tables of the target site: read where they exist, written as a new version."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemigrate.storage import dealt, exists

SCHEMAS = {
    "users": "user_id bigint, user_login string, display_name string, user_email string",
    "terms": "term_id bigint, taxonomy string, slug string, name string, parent_id bigint",
    "termmeta": "term_id bigint, key string, value string",
    "posts": "ID bigint, post_author bigint, post_date string, post_date_gmt string, post_content string, post_excerpt string, post_title string, post_status string, post_name string, comment_status string, ping_status string, guid string, post_parent bigint, menu_order bigint, post_type string, post_password string",
    "post_terms": "post_id bigint, taxonomy string, term_id bigint",
    "postmeta": "post_id bigint, key string, value string",
    "comments": "comment_id bigint, post_id bigint, author string, author_email string, author_url string, author_ip string, date string, date_gmt string, content string, approved string, type string, parent string, user_id bigint",
    "commentmeta": "comment_id bigint, key string, value string",
    "menu_items": "ID bigint, menu_id bigint, post_title string, item_type string, object_id bigint, menu_item_parent bigint, classes string, url string, target string, xfn string, description string, attr_title string, menu_order bigint, object string, status string",
    "sticky_posts": "post_id bigint",
    "id_map": "export_id string, kind string, old_key string, new_id bigint",
}

#: What tells the rows of a table apart where new ones replace old ones; all other tables only grow.
KEYS = {"id_map": ["export_id", "kind", "old_key"]}


@dataclass
class SiteTables:
    """The site's state, one DataFrame for each table of ``SCHEMAS``."""

    users: DataFrame
    terms: DataFrame
    termmeta: DataFrame
    posts: DataFrame
    post_terms: DataFrame
    postmeta: DataFrame
    comments: DataFrame
    commentmeta: DataFrame
    menu_items: DataFrame
    sticky_posts: DataFrame
    id_map: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> SiteTables:
        return cls(**{name: spark.createDataFrame([], kind) for name, kind in SCHEMAS.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SiteTables:
        """The tables below ``path``; a table that isn't there is empty."""
        return cls(**{n: spark.read.schema(k).parquet(f"{path}/{n}") if exists(spark, f"{path}/{n}") else spark.createDataFrame([], k) for n, k in SCHEMAS.items()})

    def write(self, path: str) -> None:
        """All tables as a new version below ``path``, which must not be where they are read from."""
        for field in fields(self):
            getattr(self, field.name).write.parquet(f"{path}/{field.name}")

    def shaped(self, name: str, new: DataFrame) -> DataFrame:
        """Rows with the columns of a table, those that are missing null."""
        there = set(new.columns)
        return new.select(*((F.col(c) if c in there else F.lit(None)).cast(f.dataType).alias(c) for f in getattr(self, name).schema for c in (f.name,)))

    def append(self, name: str, new: DataFrame) -> DataFrame:
        """A table and new rows, columns that are missing null."""
        return getattr(self, name).unionByName(self.shaped(name, new))

    def fresh(self, name: str, new: DataFrame) -> DataFrame:
        """Of rows for a table, those that it hasn't, each once."""
        old, rows = getattr(self, name), self.shaped(name, new).distinct()
        return rows.join(dealt(old), [rows[c].eqNullSafe(old[c]) for c in old.columns], "left_anti")

    def changed(self, added: dict[str, DataFrame], replaced: dict[str, DataFrame]) -> SiteTables:
        """The tables with rows added, those with keys in ``replaced`` left out before."""
        kept = {n: getattr(self, n).join(dealt(replaced[n]), KEYS[n], "left_anti") if n in replaced else getattr(self, n) for n in added}
        return replace(self, **{n: kept[n].select(*getattr(self, n).columns).unionByName(rows) for n, rows in added.items()})
