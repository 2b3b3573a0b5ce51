"""Terms: made or found by taxonomy and slug, linked to parents and posts, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitemigrate.storage import keep


def legacy_domain(domain: Column | str) -> Column:
    c = F.col(domain) if isinstance(domain, str) else domain
    return F.when(c == "tag", "post_tag").otherwise(c)


def in_load_order(declared: DataFrame, referenced: DataFrame) -> DataFrame:
    """Declared terms (phase 0 to 2) and terms that posts name (phase 3): export_id, phase, doc_pos, ord, taxonomy, slug, name, parent_slug."""
    columns = ["export_id", "phase", "doc_pos", "ord", "taxonomy", "slug", "name", "parent_slug"]
    of_posts = referenced.select("export_id", F.lit(3).alias("phase"), F.col("post_doc_pos").alias("doc_pos"), "ord", legacy_domain("domain").alias("taxonomy"), "slug", "name", F.lit(None).cast("string").alias("parent_slug"))
    return declared.select(*columns).unionByName(of_posts)


def get_or_create(terms: DataFrame, site: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (taxonomy, slug): the term_id it has in the site, or ``is_new``, with the first row's fields."""
    rest = [c for c in terms.columns if c not in ("taxonomy", "slug")]
    first = terms.groupBy("taxonomy", "slug").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("t")).select("taxonomy", "slug", "t.*")
    known = site.groupBy("taxonomy", "slug").agg(F.min("term_id").alias("site_term_id"))
    return first.join(known, ["taxonomy", "slug"], "left").withColumn("is_new", F.col("site_term_id").isNull())


def resolve_parents(terms: DataFrame, site: DataFrame, order: str, resolve_any: bool = False) -> DataFrame:
    """``terms`` (taxonomy, slug, parent_slug, term_id, ``order``, is_new) with ``parent_id`` for new ones.

    A parent is found by slug in the same taxonomy, in the site or in a row that comes earlier (any row, with
    ``resolve_any``); else 0. Terms that the site had keep their parent (null here).
    """
    rows = terms.groupBy("taxonomy", F.col("slug").alias("parent_slug")).agg(F.min(F.struct(F.col(order).alias("o"), F.col("term_id").alias("id"))).alias("__row"))
    old = site.groupBy("taxonomy", F.col("slug").alias("parent_slug")).agg(F.min("term_id").alias("__site"))
    joined = terms.join(old, ["taxonomy", "parent_slug"], "left").join(rows, ["taxonomy", "parent_slug"], "left")
    earlier = F.lit(True) if resolve_any else F.col("__row.o") < F.col(order)
    found = F.coalesce("__site", F.when(earlier, F.col("__row.id")), F.lit(0)).cast("long")
    return joined.withColumn("parent_id", F.when(F.col("is_new"), found)).select(*terms.columns, "parent_id")


def post_terms_bridge(links: DataFrame) -> DataFrame:
    """Each (post, taxonomy, term) once."""
    return links.select("post_id", legacy_domain("taxonomy").alias("taxonomy"), "term_id").distinct()


def term_counts(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("taxonomy", "term_id").agg(F.count("*").alias("n_posts"))


def children_index(terms: DataFrame) -> DataFrame:
    """The sorted children of each parent, by taxonomy."""
    return terms.filter("parent_id > 0").groupBy("taxonomy", "parent_id").agg(F.sort_array(F.collect_list("term_id")).alias("children"))


def ancestors(spark: SparkSession, terms: DataFrame) -> DataFrame:
    """All (taxonomy, term_id, ancestor_id, depth) pairs; a cycle of parents ends where it closes.

    Paths double in each round, so a hierarchy of depth d takes log2(d) joins.
    """
    step = keep(spark, terms.filter("parent_id > 0").select("taxonomy", "term_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")).distinct())
    closure, reach = step, 1
    while True:
        further = closure.filter(F.col("depth") == reach).alias("a").join(closure.alias("b"), (F.col("a.taxonomy") == F.col("b.taxonomy")) & (F.col("a.ancestor_id") == F.col("b.term_id")))
        more = further.select("a.taxonomy", "a.term_id", "b.ancestor_id", (F.col("a.depth") + F.col("b.depth")).alias("depth")).filter("term_id <> ancestor_id")
        grown = closure.unionByName(more).groupBy("taxonomy", "term_id", "ancestor_id").agg(F.min("depth").alias("depth"))
        grown = keep(spark, grown)
        if grown.count() == closure.count():
            return grown
        closure, reach = grown, reach * 2


def new_term_meta(meta: DataFrame, created: DataFrame) -> DataFrame:
    """Metadata of terms that were made now; that of known terms is left alone."""
    return meta.join(created.filter("is_new").select("taxonomy", "slug", "term_id"), ["taxonomy", "slug"])
