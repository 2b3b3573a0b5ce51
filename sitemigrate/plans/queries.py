"""The registered queries: every operator over the standard tables, with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemigrate.functions import table_functions
from sitemigrate.functions import url_columns as U
from sitemigrate.operators import attachments, authors, blocks, comments, ids, menus, meta, posts, terms, text, urls
from sitemigrate.plans.importing import POST_TYPES, ImportOptions, import_exports
from sitemigrate.sources import exports
from sitemigrate.sources.site import SCHEMAS, SiteTables
from sitemigrate.sources.site_log import SiteLog, TableLog
from sitemigrate.storage import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts, one export for each source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("export"), F.col("doc_id").alias("post_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("post_title"), F.concat(F.lit("writer-"), F.col("lang")).alias("post_author"),
        F.col("text").alias("post_content"), F.lit("publish").alias("status"), F.when(F.col("doc_id") % 7 == 0, "page").otherwise("post").alias("post_type"), F.lit("2024-01-02 03:04:05").alias("post_date"),
        F.floor(F.col("doc_id") / 2).alias("post_parent"), F.array(F.struct(F.concat(F.lit("Language "), "lang").alias("name"), F.col("lang").alias("slug"), F.lit("category").alias("domain"))).alias("terms"),
    )


def document_exports(spark: SparkSession, sf_dir: str) -> str:
    return exports.write_exports(document_posts(spark, sf_dir), scratch_dir(spark) + "/exports", "export", "post_id")


# --- sources -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS n_chars, text FROM documents")
def export_roundtrip(spark, d):
    chunks = exports.read_chunks(spark, document_exports(spark, d))
    items, channel = exports.split_chunks(chunks)
    parsed = exports.parse_items(items, exports.headers_of(channel))
    return exports.flatten_entities(parsed)["posts"].select(F.col("post_id").alias("doc_id"), F.length("post_content").cast("long").alias("n_chars"), F.col("post_content").alias("text"))


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, text FROM documents")
def export_native(spark, d):
    """The items of the written exports read without a Python worker."""
    items, channel = exports.split_chunks(exports.read_chunks(spark, document_exports(spark, d)))
    parsed = exports.parse_items(items, exports.headers_of(channel), by="jvm")
    return exports.flatten_entities(parsed)["posts"].select(F.col("post_id").alias("doc_id"), F.length("post_content").cast("long").alias("n_chars"), F.col("post_content").alias("text"))


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN 'page' ELSE 'post' END AS post_type, 'publish' AS status, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1, 2")
def export_counts(spark, d):
    items, channel = exports.split_chunks(exports.read_chunks(spark, document_exports(spark, d)))
    parsed = exports.parse_items(items, exports.headers_of(channel))
    return exports.flatten_entities(parsed)["posts"].groupBy("post_type", "status").agg(F.count("*").alias("n"), F.sum(F.length("post_content").cast("long")).alias("n_chars"))


@query("""
SELECT source AS export, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN '1.' || (k % 5) WHEN k % 4 = 2 THEN 'one' ELSE '2.0' END AS version, 'https://' || source || '.example.org' AS base_url,
       CASE WHEN k % 4 IN (0, 2) THEN 'error' WHEN k % 4 = 3 OR k % 5 > 2 THEN 'warning' ELSE 'ok' END AS status
FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS k FROM documents)
""")
def export_header(spark, d):
    source = F.col("export")
    k = F.substring(source, 4, 10).cast("int")
    version = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.concat(F.lit("1."), (k % 5).cast("string"))).when(k % 4 == 2, "one").otherwise("2.0")
    path = exports.write_exports(document_posts(spark, d).select("export", "post_id", "post_title"), scratch_dir(spark) + "/exports", "export", "post_id", version, F.concat(F.lit("https://"), source, F.lit(".example.org")))
    headers = exports.validate_exports(exports.headers_of(exports.split_chunks(exports.read_chunks(spark, path))[1]))
    return headers.select(F.col("blogname").alias("export"), "version", "base_url", "status")


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE doc_id % 3 = 0")
def export_salvage(spark, d):
    """Items broken by a stray tag go to the quarantine, and their fields are read by tags."""
    path = document_exports(spark, d)
    items, channel = exports.split_chunks(exports.read_chunks(spark, path))
    third = F.regexp_extract("item_xml", r"<wp:post_id>(\d+)", 1).cast("long") % 3 == 0
    broken = items.withColumn("item_xml", F.when(third, F.concat("item_xml", F.lit("<b>"))).otherwise(F.col("item_xml")))
    saved = exports.salvage(exports.quarantine(exports.parse_items(broken, exports.headers_of(channel))))
    return saved.select(F.col("post_id").alias("doc_id"), F.length("post_content").cast("long").alias("n_chars"))


@query("SELECT doc_id, lang AS slug, 'Language ' || lang AS name, 'a <b> ' || doc_id AS value, 'c' || doc_id AS author FROM documents WHERE doc_id % 2 = 0")
def salvage_entities(spark, d):
    """Terms, metadata and comments of items that aren't XML."""
    of = F.col("post_id").cast("string")
    extra = {"postmeta": F.array(F.struct(F.lit("k").alias("key"), F.concat(F.lit("a <b> "), of).alias("value"))), "comments": F.array(F.struct(F.lit(7).alias("comment_id"), F.concat(F.lit("c"), of).alias("author"), *(F.lit("x").alias(c) for c in ("date", "content", "approved", "parent")), F.lit(0).alias("user_id")))}
    path = exports.write_exports(document_posts(spark, d).withColumns(extra).drop("post_content"), scratch_dir(spark) + "/exports", "export", "post_id")
    items, channel = exports.split_chunks(exports.read_chunks(spark, path))
    half = F.regexp_extract("item_xml", r"<wp:post_id>(\d+)", 1).cast("long") % 2 == 0
    broken = items.withColumn("item_xml", F.when(half, F.concat("item_xml", F.lit("<b>"))).otherwise(F.col("item_xml")))
    rows = exports.parse_items(broken, exports.headers_of(channel), salvage=True).filter("error IS NOT NULL")
    return rows.select(F.col("post_id").alias("doc_id"), F.explode("terms").alias("t"), "postmeta", "comments").select("doc_id", "t.slug", "t.name", F.col("postmeta")[0]["value"].alias("value"), F.col("comments")[0]["author"].alias("author"))


# --- posts -------------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT doc_id, doc_id // 2 AS post_id, CASE lang WHEN 'en' THEN 'post' WHEN 'de' THEN 'page' WHEN 'fr' THEN 'nav_menu_item' ELSE 'unknown' END AS t, CASE WHEN source = 'src1' THEN 'auto-draft' ELSE 'publish' END AS s FROM documents),
r AS (SELECT *, CASE WHEN t = 'unknown' THEN 'reject' WHEN s = 'auto-draft' THEN 'skip' END AS early FROM p),
n AS (SELECT *, CASE WHEN early IS NULL AND post_id <> 0 THEN row_number() OVER (PARTITION BY post_id, early IS NULL ORDER BY doc_id) END AS nth FROM r)
SELECT coalesce(early, CASE WHEN nth > 1 THEN 'skip' WHEN t = 'nav_menu_item' THEN 'menu' ELSE 'post' END) AS route,
       CASE WHEN early = 'reject' THEN 'invalid post type' WHEN early = 'skip' THEN 'auto-draft' WHEN nth > 1 THEN 'already handled' END AS reason, count(*) AS n
FROM n GROUP BY 1, 2
""")
def route_posts(spark, d):
    kind = F.when(F.col("lang") == "en", "post").when(F.col("lang") == "de", "page").when(F.col("lang") == "fr", "nav_menu_item").otherwise("unknown")
    rows = table(spark, d, "documents").select(F.lit("x").alias("export_id"), F.floor(F.col("doc_id") / 2).alias("post_id"), F.col("doc_id").alias("doc_pos"), kind.alias("post_type"), F.when(F.col("source") == "src1", "auto-draft").otherwise("publish").alias("status"))
    types = spark.createDataFrame([(t,) for t in POST_TYPES], "post_type string")
    return posts.route_posts(rows, types).groupBy("route", "reason").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT o_orderkey, 'x' AS export_id, CAST(o_custkey AS VARCHAR) AS post_title, CASE WHEN o_orderkey % 6 IN (1, 4) THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS post_date, o_orderstatus AS post_type FROM orders)
SELECT k.export_id, k.post_title, k.post_date, k.post_type, s.existing_id FROM (SELECT * FROM r WHERE o_orderkey % 2 = 1) k
LEFT JOIN (SELECT post_title, post_date, post_type, min(o_orderkey) AS existing_id FROM r WHERE o_orderkey % 2 = 0 GROUP BY 1, 2, 3) s
ON k.post_title = s.post_title AND k.post_date IS NOT DISTINCT FROM s.post_date AND k.post_type = s.post_type
""")
def existing_posts(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("x").alias("export_id"), F.col("o_custkey").cast("string").alias("post_title"), F.when(~(F.col("o_orderkey") % 6).isin(1, 4), F.date_format("o_orderdate", "yyyy-MM")).alias("post_date"), F.col("o_orderstatus").alias("post_type"))
    site = rows.filter("o_orderkey % 2 = 0").withColumnRenamed("o_orderkey", "ID")
    return posts.match_existing(rows.filter("o_orderkey % 2 = 1").drop("o_orderkey"), site)


@query("SELECT l_orderkey AS post_id, arg_min(l_partkey, l_linenumber * 1000000 + l_partkey) AS l_partkey, min(l_linenumber * 1000000 + l_partkey) AS doc_pos FROM lineitem WHERE l_orderkey <> 0 GROUP BY 1 UNION ALL SELECT l_orderkey, l_partkey, l_linenumber * 1000000 + l_partkey FROM lineitem WHERE l_orderkey = 0")
def dedupe_first_wins(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("x").alias("export_id"), F.col("l_orderkey").alias("post_id"), "l_partkey", (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("doc_pos"))
    return posts.first_by_id(rows).drop("export_id")


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate, o_orderstatus) AS first_pos FROM orders")
def natural_key_first(spark, d):
    rows = table(spark, d, "orders").select(F.lit("x").alias("export_id"), "o_orderkey", F.col("o_custkey").cast("string").alias("post_title"), F.col("o_orderdate").cast("string").alias("post_date"), F.col("o_orderstatus").alias("post_type"), F.col("o_orderkey").alias("doc_pos"))
    return posts.natural_first(rows).select("o_orderkey", "first_pos")


@query("""
WITH t AS (SELECT p_partkey, p_size::BIGINT * 50 + p_partkey % 7 AS old_id FROM part), site AS (SELECT DISTINCT s_suppkey * 3 AS id FROM supplier),
m AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY p_partkey) = 1 AND old_id > 0 AND old_id NOT IN (SELECT id FROM site) AS free FROM t),
top AS (SELECT greatest((SELECT max(id) FROM site), (SELECT max(old_id) FROM t)) AS top)
SELECT p_partkey, CASE WHEN free THEN old_id ELSE top + row_number() OVER (PARTITION BY free ORDER BY p_partkey) END AS new_id FROM m, top
""")
def allocate_ids(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("long") * 50 + F.col("p_partkey") % 7).alias("old_id"))
    site = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"))
    return ids.allocate_ids(spark, rows, site, "old_id", "id", ["p_partkey"]).select("p_partkey", "new_id")


@query("""
WITH m AS (SELECT p_partkey AS old_id, p_partkey + 1000000 AS new_id FROM part WHERE p_partkey % 5 <> 0)
SELECT p.p_partkey, coalesce(m.new_id, 0) AS new_parent FROM part p LEFT JOIN m ON m.old_id = p.p_partkey // 2 AND p.p_partkey // 2 <> 0
""")
def parent_remap(spark, d):
    part = table(spark, d, "part").select(F.lit("x").alias("export_id"), "p_partkey", F.floor(F.col("p_partkey") / 2).alias("post_parent"))
    id_map = part.filter("p_partkey % 5 <> 0").select("export_id", F.col("p_partkey").alias("old_id"), (F.col("p_partkey") + 1000000).alias("new_id"))
    return posts.remap_parents(part, id_map).select("p_partkey", "new_parent")


@query("SELECT o_orderpriority, sum((o_orderkey % 10 = 0)::BIGINT)::BIGINT AS n_sticky FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1")
def sticky_posts(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.lit("x").alias("export_id"), F.col("o_orderkey").alias("post_id"), (F.col("o_orderkey") % 10 == 0).cast("int").alias("is_sticky"))
    return posts.sticky(rows).join(rows.select("post_id", "o_orderpriority"), "post_id").groupBy("o_orderpriority").agg(F.count("*").alias("n_sticky"))


@query("""
WITH b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS post_title, strftime(o_orderdate, '%Y') AS post_date, o_orderstatus AS post_type FROM orders WHERE o_orderkey % 2 = 1),
s AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS post_title, strftime(o_orderdate, '%Y') AS post_date, o_orderstatus AS post_type FROM orders WHERE o_orderkey % 2 = 0)
SELECT post_type, EXISTS (SELECT 1 FROM s WHERE s = b) AS there, count(*) AS n FROM b GROUP BY 1, 2
""".replace("s = b", "s.post_title = b.post_title AND s.post_date = b.post_date AND s.post_type = b.post_type"))
def key_report(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("post_title"), F.date_format("o_orderdate", "yyyy").alias("post_date"), F.col("o_orderstatus").alias("post_type"))
    return posts.key_report(rows.filter("o_orderkey % 2 = 1"), rows.filter("o_orderkey % 2 = 0")).groupBy("post_type", "there").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS import_id, 'Document ' || doc_id AS post_title, 'publish' AS post_status, CASE WHEN doc_id % 7 = 0 THEN 'page' ELSE 'post' END AS post_type, doc_id // 2 AS post_parent, md5(text) AS content_hash FROM documents")
def loaded_columns(spark, d):
    """The columns that are loaded, under their names in the site."""
    loaded = posts.loaded_columns(document_posts(spark, d))
    return loaded.select("import_id", "post_title", "post_status", "post_type", "post_parent", F.md5("post_content").alias("content_hash"))


# --- authors -----------------------------------------------------------------------------------------------------------

DIRTY = "CASE o_orderkey % 3 WHEN 0 THEN '  ' || c_name WHEN 1 THEN '<b>' || c_name || '</b>' ELSE replace(c_name, '#', '  ') END"
CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '[^A-Za-z0-9 _.@-]', '', 'g'), '\\s+', ' ', 'g'))"


def _order_authors(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    dirty = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  "), "c_name")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("<b>"), "c_name", F.lit("</b>"))).otherwise(F.replace("c_name", F.lit("#"), F.lit("  ")))
    return joined.select(F.lit("x").alias("export_id"), F.col("o_orderkey").alias("doc_pos"), F.col("o_orderkey").alias("post_id"), dirty.alias("post_author"))


@query(f"SELECT {CLEAN} AS author_login, arg_min(a, o_orderkey) AS author_display_name, {CLEAN} = '' AS failed FROM (SELECT o_orderkey, {DIRTY} AS a FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 3")
def infer_authors(spark, d):
    return authors.infer_authors(_order_authors(spark, d)).drop("export_id")


@query("""
WITH a AS (SELECT c_custkey, replace(c_name, '#', '') AS login, c_nationkey % 4 AS k FROM customer)
SELECT login AS author_login, CASE k WHEN 0 THEN 'existing' WHEN 1 THEN 'named' WHEN 2 THEN 'created' ELSE 'existing' END AS how,
       CASE k WHEN 0 THEN 7::BIGINT WHEN 3 THEN 9::BIGINT END AS user_id, CASE k WHEN 1 THEN 'new-' || login WHEN 2 THEN login END AS new_login FROM a
""")
def map_authors(spark, d):
    own = table(spark, d, "customer").select(F.lit("x").alias("export_id"), F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author_login"), (F.col("c_nationkey") % 4).alias("k"))
    login = authors.sanitize_login("author_login")
    policy = own.select("export_id", "author_login", F.when(F.col("k") == 0, "admin").when(F.col("k") == 3, "editor").alias("use_login"), F.when(F.col("k") == 1, F.concat(F.lit("new-"), login)).alias("new_login"))
    users = table(spark, d, "region").select((F.col("r_regionkey") * 2 + 7).cast("long").alias("user_id"), F.element_at(F.array(F.lit("admin"), F.lit("editor"), F.lit("u2"), F.lit("u3"), F.lit("u4")), F.col("r_regionkey") + 1).alias("user_login"))
    versions = spark.createDataFrame([("x", "1.2")], "export_id string, version string")
    return authors.map_authors(own, policy, users, versions, 1).select("author_login", "how", "user_id", "new_login")


@query(f"WITH o AS (SELECT o_orderkey, o_custkey, {DIRTY} AS a FROM orders JOIN customer ON o_custkey = c_custkey) SELECT o_orderkey, CASE WHEN {CLEAN} LIKE 'Customer0%' AND o_custkey % 2 = 0 THEN o_custkey + 100 ELSE 1 END AS post_author_id FROM o")
def post_author_remap(spark, d):
    known = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.lit("x").alias("export_id"), authors.sanitize_login("c_name").alias("author_login"), (F.col("c_custkey") + 100).alias("user_id"))
    return authors.remap_post_authors(_order_authors(spark, d), known, 1).select(F.col("post_id").alias("o_orderkey"), "post_author_id")


# --- terms -------------------------------------------------------------------------------------------------------------


def _part_terms(spark, d):
    part = table(spark, d, "part")
    one = lambda tax, col, phase: part.select(F.lit("x").alias("export_id"), F.lit(phase).alias("phase"), F.col("p_partkey").alias("doc_pos"), F.lit(0).alias("ord"), F.lit(tax).alias("taxonomy"), F.lower(col).alias("slug"), F.col(col).alias("name"), F.lit(None).cast("string").alias("parent_slug"))
    return one("brand", "p_brand", 0).unionByName(one("kind", "p_type", 1))


@query("""
WITH t AS (SELECT 'brand' AS taxonomy, lower(p_brand) AS slug, p_brand AS name, p_partkey FROM part UNION ALL SELECT 'kind', lower(p_type), p_type, p_partkey FROM part),
f AS (SELECT taxonomy, slug, arg_min(name, p_partkey) AS name FROM t GROUP BY 1, 2),
s AS (SELECT 'brand' AS taxonomy, lower(p_brand) AS slug, min(p_partkey) AS site_term_id FROM part WHERE p_size < 3 AND p_partkey % 10 = 0 GROUP BY 2)
SELECT f.taxonomy, f.slug, f.name, s.site_term_id, s.site_term_id IS NULL AS is_new FROM f LEFT JOIN s USING (taxonomy, slug)
""")
def term_get_or_create(spark, d):
    site = table(spark, d, "part").filter("p_size < 3 AND p_partkey % 10 = 0").select(F.lit("brand").alias("taxonomy"), F.lower("p_brand").alias("slug"), F.col("p_partkey").alias("term_id"))
    return terms.get_or_create(_part_terms(spark, d), site, ["phase", "doc_pos"]).select("taxonomy", "slug", "name", "site_term_id", "is_new")


TERM_ROWS = """
t AS (SELECT 'customer-' || c_custkey AS slug, 'nation-' || c_nationkey AS parent_slug, c_custkey + 1000 AS term_id, c_custkey * 3 AS place FROM customer
      UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey, n_nationkey + 100, n_nationkey * 20 + 1 FROM nation
      UNION ALL SELECT 'region-' || r_regionkey, NULL, r_regionkey + 1, r_regionkey * 90 + 2 FROM region)
"""


def _region_terms(spark, d):
    one = lambda name, slug, parent, id_, place: table(spark, d, name).select(F.lit("x").alias("taxonomy"), slug.alias("slug"), parent.alias("parent_slug"), id_.cast("long").alias("term_id"), place.cast("long").alias("place"), F.lit(True).alias("is_new"))
    c, s = F.col, lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    return (
        one("customer", s("customer-", "c_custkey"), s("nation-", "c_nationkey"), c("c_custkey") + 1000, c("c_custkey") * 3)
        .unionByName(one("nation", s("nation-", "n_nationkey"), s("region-", "n_regionkey"), c("n_nationkey") + 100, c("n_nationkey") * 20 + 1))
        .unionByName(one("region", s("region-", "r_regionkey"), F.lit(None).cast("string"), c("r_regionkey") + 1, c("r_regionkey") * 90 + 2))
    )


@query(f"WITH {TERM_ROWS} SELECT t.slug, t.term_id, coalesce(CASE WHEN p.place < t.place THEN p.term_id END, 0) AS parent_id FROM t LEFT JOIN t p ON p.slug = t.parent_slug")
def term_parents(spark, d):
    rows = _region_terms(spark, d)
    return terms.resolve_parents(rows, rows.select("taxonomy", "slug", "term_id").limit(0), "place").select("slug", "term_id", "parent_id")


@query(f"""
WITH RECURSIVE {TERM_ROWS}, l AS (SELECT t.term_id, p.term_id AS parent_id FROM t JOIN t p ON p.slug = t.parent_slug),
a AS (SELECT term_id, parent_id AS ancestor_id, 1 AS depth FROM l UNION ALL SELECT a.term_id, l.parent_id, a.depth + 1 FROM a JOIN l ON l.term_id = a.ancestor_id)
SELECT term_id, ancestor_id, depth FROM a
""")
def term_ancestors(spark, d):
    rows = _region_terms(spark, d)
    linked = terms.resolve_parents(rows, rows.select("taxonomy", "slug", "term_id").limit(0), "place", resolve_any=True)
    return terms.ancestors(spark, linked).drop("taxonomy")


@query(f"WITH {TERM_ROWS}, l AS (SELECT t.term_id, p.term_id AS parent_id FROM t JOIN t p ON p.slug = t.parent_slug) SELECT parent_id, array_to_string(list_sort(list(term_id)), ',') AS children FROM l GROUP BY 1")
def term_children(spark, d):
    rows = _region_terms(spark, d)
    linked = terms.resolve_parents(rows, rows.select("taxonomy", "slug", "term_id").limit(0), "place", resolve_any=True)
    return terms.children_index(linked).select("parent_id", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS post_id, CASE WHEN l_linenumber % 2 = 0 THEN 'post_tag' ELSE 'category' END AS taxonomy, p_type AS term FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT taxonomy, term, count(*) AS n_posts FROM b GROUP BY 1, 2
""")
def post_terms_bridge(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    links = joined.select(F.col("l_orderkey").alias("post_id"), F.when(F.col("l_linenumber") % 2 == 0, "tag").otherwise("category").alias("taxonomy"), F.col("p_type").alias("term_id"))
    return terms.term_counts(terms.post_terms_bridge(links)).withColumnRenamed("term_id", "term")


@query("SELECT 'brand' AS taxonomy, lower(p_brand) AS slug, p_size::VARCHAR AS value, count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM part s WHERE s.p_size < 3 AND s.p_partkey % 10 = 0 AND s.p_brand = part.p_brand) GROUP BY 1, 2, 3")
def new_term_meta(spark, d):
    """Metadata of brands that the site lacks."""
    part = table(spark, d, "part")
    site = part.filter("p_size < 3 AND p_partkey % 10 = 0").select(F.lit("brand").alias("taxonomy"), F.lower("p_brand").alias("slug"), F.col("p_partkey").alias("term_id"))
    made = terms.get_or_create(_part_terms(spark, d), site, ["phase", "doc_pos"]).withColumn("term_id", F.lit(0))
    rows = part.select(F.lit("brand").alias("taxonomy"), F.lower("p_brand").alias("slug"), F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"))
    return terms.new_term_meta(rows, made).groupBy("taxonomy", "slug", "value").agg(F.count("*").alias("n"))


# --- comments ----------------------------------------------------------------------------------------------------------


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.lit("x").alias("export_id"), F.col("conv_id").alias("post_doc_pos"), F.col("turn").alias("ord"), F.floor(F.col("turn") / 2).alias("comment_id"), F.col("role").alias("author"), F.md5("text").alias("date"), (F.col("turn") - 1).cast("string").alias("parent"), F.col("conv_id").alias("user_id"))


@query("""
WITH c AS (SELECT conv_id, turn // 2 AS comment_id, max(turn) AS turn, arg_max(role, turn) AS author, arg_max(md5(text), turn) AS date FROM conversations GROUP BY 1, 2),
s AS (SELECT DISTINCT role AS author, md5(text) AS date FROM conversations WHERE conv_id % 3 = 0)
SELECT conv_id, comment_id, author, date FROM c WHERE NOT (conv_id % 2 = 0 AND EXISTS (SELECT 1 FROM s WHERE s.author = c.author AND s.date = c.date))
""")
def comment_dedupe(spark, d):
    turns = _turns(spark, d)
    known = turns.filter("post_doc_pos % 3 = 0").select("author", "date")
    last = comments.last_by_id(turns).withColumn("post_exists", F.col("post_doc_pos") % 2 == 0)
    return comments.drop_known(last, known).select(F.col("post_doc_pos").alias("conv_id"), "comment_id", "author", "date")


@query("""
WITH c AS (SELECT conv_id, turn, turn - 1 AS parent FROM conversations), i AS (SELECT conv_id, turn, turn + conv_id * 1000 AS new_id FROM conversations WHERE turn % 3 <> 0)
SELECT c.conv_id, c.turn, coalesce(CASE WHEN c.parent < c.turn THEN i.new_id END, c.parent)::VARCHAR AS new_parent, count(*) OVER (PARTITION BY c.conv_id) AS n_comments,
       CASE WHEN c.conv_id % 4 = 0 AND c.conv_id > 0 THEN c.conv_id + 5 END AS new_user_id
FROM c LEFT JOIN i ON i.conv_id = c.conv_id AND i.turn = c.parent
""")
def comment_threads(spark, d):
    turns = _turns(spark, d).withColumn("comment_id", F.col("ord"))
    inserted = turns.filter("ord % 3 <> 0").select("export_id", "post_doc_pos", "comment_id", (F.col("ord") + F.col("post_doc_pos") * 1000).alias("new_id"))
    users = turns.filter("post_doc_pos % 4 = 0 AND post_doc_pos >= 0").select("export_id", F.col("post_doc_pos").alias("author_id"), (F.col("post_doc_pos") + 5).alias("user_id")).distinct()
    linked = comments.remap_parents(comments.remap_users(turns, users), inserted)
    counts = comments.comment_counts(turns, "post_doc_pos")
    return linked.join(counts, "post_doc_pos").select(F.col("post_doc_pos").alias("conv_id"), F.col("comment_id").alias("turn"), "new_parent", "n_comments", "new_user_id")


@query("SELECT conv_id, turn, role AS key, CASE WHEN turn % 2 = 1 THEN md5(text) END AS value FROM conversations WHERE turn % 2 = 1")
def comment_meta(spark, d):
    turns = _turns(spark, d).withColumn("comment_id", F.col("ord"))
    rows = turns.select("export_id", "post_doc_pos", "comment_id", F.col("author").alias("key"), F.when(F.col("ord") % 2 == 1, F.col("date")).alias("value"))
    done = turns.select("export_id", "post_doc_pos", "comment_id", F.col("ord").alias("new_id"))
    return comments.loadable_meta(rows, done).select(F.col("post_doc_pos").alias("conv_id"), F.col("comment_id").alias("turn"), "key", "value")


# --- metadata ----------------------------------------------------------------------------------------------------------

KEY_SQL = "CASE event_id % 6 WHEN 0 THEN '_edit_last' WHEN 1 THEN '_thumbnail_id' WHEN 2 THEN '_edit_lock' WHEN 3 THEN '' ELSE event_type END"


def _event_meta(spark, d):
    key = F.when(F.col("event_id") % 6 == 0, "_edit_last").when(F.col("event_id") % 6 == 1, "_thumbnail_id").when(F.col("event_id") % 6 == 2, "_edit_lock").when(F.col("event_id") % 6 == 3, "").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(F.lit("x").alias("export_id"), F.col("event_id").alias("post_id"), key.alias("key"), F.col("user_id").cast("string").alias("value"))


@query(f"""
WITH m AS (SELECT event_id, {KEY_SQL} AS key, user_id FROM events)
SELECT event_id AS post_id, key, CASE WHEN key = '_edit_last' THEN user_id + 10 WHEN key = '_thumbnail_id' AND user_id % 3 = 0 THEN user_id + 5000 ELSE user_id END::VARCHAR AS value
FROM m WHERE key NOT IN ('', '_edit_lock') AND NOT (key = '_edit_last' AND user_id % 2 = 1)
""")
def meta_filter_remap(spark, d):
    users = table(spark, d, "events").select(F.lit("x").alias("export_id"), F.col("user_id").alias("old")).distinct()
    mapped = users.filter("old % 2 = 0").select("export_id", F.col("old").alias("author_id"), (F.col("old") + 10).alias("user_id"))
    ids_ = users.filter("old % 3 = 0").select("export_id", F.col("old").alias("old_id"), (F.col("old") + 5000).alias("new_id"))
    return meta.remap_references(meta.filter_keys(_event_meta(spark, d)), mapped, ids_).drop("export_id")


@query("SELECT user_id, arg_max(props, event_id) FILTER (WHERE event_type = 'click') AS click, arg_max(props, event_id) FILTER (WHERE event_type = 'error') AS error FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def meta_pivot(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("key"), F.col("props").alias("value"))
    return meta.pivot(rows, ["click", "error"], ["user_id"])


@query("SELECT event_type AS key, count(*) AS n, count(DISTINCT props) AS n_values, sum((coalesce(props, '') = '')::BIGINT)::BIGINT AS n_empty FROM events GROUP BY 1")
def meta_profile(spark, d):
    return meta.key_profile(table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value")))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{"name":"' || p_name || '","size":' || p_size || '}' WHEN 1 THEN '["' || p_brand || '",' || (CASE WHEN p_size > 9 THEN 'true' ELSE 'false' END) || ',null]' WHEN 2 THEN '{"brand":{"type":"' || p_type || '"}}' END AS value_json FROM part""")
def meta_decode(spark, d):
    s = lambda c: F.concat(F.lit("s:"), F.octet_length(c).cast("string"), F.lit(':"'), c, F.lit('";'))
    c = F.col
    pairs = F.concat(F.lit("a:2:{"), s(F.lit("name")), s(c("p_name")), s(F.lit("size")), F.lit("i:"), c("p_size").cast("string"), F.lit(";}"))
    items = F.concat(F.lit("a:3:{i:0;"), s(c("p_brand")), F.lit("i:1;b:"), (c("p_size") > 9).cast("int").cast("string"), F.lit(";i:2;N;}"))
    obj = F.concat(F.lit('O:7:"Gadgets":1:{'), s(F.lit("brand")), F.lit('O:3:"Foo":1:{'), s(F.lit("type")), s(c("p_type")), F.lit("}}"))
    rows = table(spark, d, "part").select("p_partkey", F.when(c("p_partkey") % 4 == 0, pairs).when(c("p_partkey") % 4 == 1, items).when(c("p_partkey") % 4 == 2, obj).otherwise(c("p_name")).alias("value"))
    return meta.decode_serialized(rows).drop("value")


@query("""
WITH e AS (SELECT event_type AS key, user_id::VARCHAR AS value, event_id % 2 = 0 AS old FROM events), n AS (SELECT DISTINCT key, value FROM e WHERE NOT old EXCEPT SELECT key, value FROM e WHERE old)
SELECT key, sum(appended)::BIGINT AS n_appended, sum(deduped)::BIGINT AS n_deduped FROM (SELECT key, 1 AS appended, old::INT AS deduped FROM e UNION ALL SELECT key, 0, 1 FROM n) GROUP BY 1
""")
def meta_append(spark, d):
    """Site metadata and a second import's, as it is and without repeats."""
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"))
    site, new = rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id")
    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    return count(meta.append(site, new), "n_appended").join(count(meta.append(site, new, dedupe=True), "n_deduped"), "key")


# --- menus -------------------------------------------------------------------------------------------------------------


@query("""
WITH i AS (SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'taxonomy' WHEN 1 THEN 'post_type' ELSE 'custom' END AS item_type, p_size::BIGINT AS object_id, p_partkey // 3 AS parent_item,
                  CASE WHEN p_partkey % 11 <> 0 THEN 'nation_' || (p_partkey % 40) END AS menu_slug, p_brand AS brand FROM part),
l AS (SELECT i.*, n_nationkey AS menu_id, CASE item_type WHEN 'taxonomy' THEN CASE WHEN object_id % 2 = 0 THEN object_id + 100 END WHEN 'post_type' THEN CASE WHEN object_id % 5 <> 0 THEN object_id + 200 END ELSE object_id END AS new_object_id
      FROM i LEFT JOIN nation ON lower(n_name) = menu_slug),
r AS (SELECT *, CASE WHEN menu_slug IS NULL THEN 'missing menu slug' WHEN menu_id IS NULL THEN 'invalid menu slug' WHEN new_object_id IS NULL THEN 'missing object' END AS reason FROM l)
SELECT r.item_id, r.menu_id, r.new_object_id, r.reason, coalesce(p.item_id + 9000, 0) AS new_parent, r.brand || ' wide' AS classes FROM r LEFT JOIN r p ON p.item_id = r.parent_item AND p.reason IS NULL
""")
def menu_items(spark, d):
    c, k = F.col, F.col("p_partkey")
    slug = F.when(k % 11 != 0, F.concat(F.lit("nation_"), (k % 40).cast("string")))
    classes = F.concat(F.lit("a:2:{i:0;s:"), F.length("p_brand").cast("string"), F.lit(':"'), "p_brand", F.lit('";i:1;s:4:"wide";}'))
    items = table(spark, d, "part").select(
        F.lit("x").alias("export_id"), k.alias("item_id"), F.when(k % 3 == 0, "taxonomy").when(k % 3 == 1, "post_type").otherwise("custom").alias("item_type"), c("p_size").cast("long").alias("object_id"), F.floor(k / 3).alias("parent_item"),
        F.array(F.struct(F.lit("category").alias("domain"), F.lit("other").alias("slug")), F.struct(F.when(slug.isNotNull(), "nav_menu").otherwise("category").alias("domain"), slug.alias("slug"))).alias("terms"), (k + 9000).alias("new_id"), classes.alias("classes"),
    )
    sizes = items.select("export_id", F.col("object_id").alias("old_id")).distinct()
    linked = menus.menu_of(items, table(spark, d, "nation").select(F.lower("n_name").alias("slug"), F.col("n_nationkey").alias("menu_id")))
    linked = menus.link_objects(linked, sizes.filter("old_id % 2 = 0").withColumn("new_id", F.col("old_id") + 100), sizes.filter("old_id % 5 <> 0").withColumn("new_id", F.col("old_id") + 200))
    return menus.css_classes(menus.link_parents(linked)).select("item_id", "menu_id", "new_object_id", "reason", "new_parent", "classes")


# --- attachments -------------------------------------------------------------------------------------------------------


@query("""
SELECT page_id AS post_id, CASE WHEN page_id % 3 = 0 THEN 'https://old.example.org/files/' || page_id || '.png' ELSE url END AS url,
       CASE WHEN page_id % 4 = 0 THEN '2021/0' || (1 + page_id % 9) WHEN page_id % 4 = 1 THEN NULL ELSE '2023/05' END AS folder FROM pages
""")
def attachment_manifest(spark, d):
    k = F.col("page_id")
    first = F.struct(F.lit("_wp_attached_file").alias("key"), F.when(k % 4 == 0, F.concat(F.lit("2021/0"), (k % 9 + 1).cast("string"), F.lit("/a.png"))).otherwise(F.lit("a.png")).alias("value"))
    second = F.struct(F.lit("_wp_attached_file").alias("key"), F.lit("1999/01/b.png").alias("value"))
    rows = table(spark, d, "pages").select(
        F.lit("x").alias("export_id"), k.alias("post_id"), F.lit("attachment").alias("post_type"), F.when(k % 3 == 0, F.concat(F.lit("/files/"), k.cast("string"), F.lit(".png"))).otherwise("").alias("attachment_url"),
        F.col("url").alias("guid"), F.array(first, second).alias("postmeta"), F.when(k % 4 == 1, "0000-00-00 00:00:00").otherwise("2023-05-06 07:08:09").alias("post_date"),
    )
    headers = spark.createDataFrame([("x", "https://old.example.org/")], "export_id string, base_url string")
    return attachments.manifest(rows, headers).drop("export_id")


@query("""
WITH f AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'timeout' END AS error, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status, page_id % 17 <> 0 AS has_headers, CASE WHEN page_id % 19 = 0 THEN 0 ELSE strlen(html) END AS file_size,
                  CASE WHEN page_id % 2 = 0 THEN strlen(html) + (page_id % 5 = 0)::INT END AS content_length, CASE WHEN page_id % 3 = 0 THEN 'gzip' END AS content_encoding FROM pages)
SELECT page_id, CASE WHEN error IS NOT NULL THEN 'request failed' WHEN status <> 200 THEN 'unexpected status' WHEN NOT has_headers THEN 'no response' WHEN file_size = 0 THEN 'empty file'
       WHEN content_length IS NOT NULL AND content_encoding IS NULL AND content_length <> file_size THEN 'wrong size' WHEN file_size > 6000 THEN 'too large' END AS reason FROM f
""")
def fetch_validation(spark, d):
    k, size = F.col("page_id"), F.octet_length("html").cast("long")
    rows = table(spark, d, "pages").select(
        "page_id", F.when(k % 13 == 0, "timeout").alias("error"), F.when(k % 7 == 0, 404).otherwise(200).alias("status"), (k % 17 != 0).alias("has_headers"), F.when(k % 19 == 0, 0).otherwise(size).alias("file_size"),
        F.when(k % 2 == 0, size + (k % 5 == 0).cast("int")).alias("content_length"), F.when(k % 3 == 0, "gzip").alias("content_encoding"),
    )
    return attachments.validate_fetches(rows, 6000).select("page_id", "reason")


@query("""
WITH f AS (SELECT page_id, page_id % 5 AS folder, CASE WHEN page_id % 3 = 0 THEN 'photo' || (page_id % 10) || '.jpg' WHEN page_id % 3 = 1 THEN 'file' || (page_id % 4) || '.png' ELSE 'n' || CASE WHEN page_id % 11 = 0 THEN '2-' || (page_id % 4) ELSE (page_id % 6)::VARCHAR END || '.gif' END AS file_name FROM pages),
site(folder, file_name) AS (VALUES (0, 'photo0.jpg'), (1, 'FILE1.png'), (2, 'n2-5.gif'), (2, 'photo3-1.jpg')),
names AS (SELECT DISTINCT folder, lower(file_name) AS name FROM (SELECT folder, file_name FROM f UNION ALL SELECT folder, file_name FROM site)),
n AS (SELECT f.*, row_number() OVER (PARTITION BY f.folder, f.file_name ORDER BY page_id) - CASE WHEN s.file_name IS NULL THEN 1 ELSE 0 END AS n FROM f LEFT JOIN site s ON s.folder = f.folder AND lower(s.file_name) = f.file_name),
free AS (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY k) AS r FROM n, range(1, n.n + 20) t(k) WHERE n.n > 0 AND NOT EXISTS (SELECT 1 FROM names WHERE names.folder = n.folder AND names.name = replace(n.file_name, '.', '-' || k || '.')))
SELECT page_id, file_name, true AS allowed, CASE WHEN n = 0 THEN file_name ELSE replace(file_name, '.', '-' || k || '.') END AS unique_name FROM n LEFT JOIN free USING (page_id) WHERE n = 0 OR r = n
""")
def attachment_names(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select(
        "page_id", (k % 5).cast("string").alias("folder"),
        F.when(k % 3 == 0, F.concat(F.lit("https://x.example.org/a/photo"), (k % 10).cast("string"), F.lit(".jpg?size=2"))).otherwise("https://x.example.org/").alias("url"),
        F.when(k % 3 == 1, F.concat(F.lit('attachment; filename="file'), (k % 4).cast("string"), F.lit('"'))).when(k % 3 == 2, F.concat(F.lit("inline; filename=n"), F.when(k % 11 == 0, F.concat(F.lit("2-"), (k % 4).cast("string"))).otherwise((k % 6).cast("string")), F.lit(".gif"))).alias("content_disposition"),
        F.when(k % 3 == 1, "image/png; q=1").otherwise("image/jpeg").alias("content_type"),
    )
    mime = spark.createDataFrame([("image/png", "png"), ("image/jpeg", "jpg|jpeg|jpe"), ("image/gif", "gif")], "mime_type string, extensions string")
    there = spark.createDataFrame([("0", "photo0.jpg"), ("1", "FILE1.png"), ("2", "n2-5.gif"), ("2", "photo3-1.jpg")], "folder string, file_name string")
    return attachments.unique_names(attachments.name_files(rows, mime), "page_id", there).select("page_id", "file_name", "allowed", "unique_name")


@query("""
WITH r AS (SELECT page_id, url AS from_url, 'https://new.example.com/' || page_id AS to_url FROM pages), t AS (SELECT page_id, 'see ' || url || ' and ' || url || '/more' AS text FROM pages)
SELECT t.page_id, replace(replace(text, from_url || '/more', to_url || '-more'), from_url, to_url) AS text FROM t JOIN r USING (page_id)
""")
def url_remap(spark, d):
    pages = table(spark, d, "pages")
    new = F.concat(F.lit("https://new.example.com/"), F.col("page_id").cast("string"))
    base = pages.select(F.col("page_id").alias("export_id"), F.lit(1).alias("ord"), F.col("url").alias("from_url"), new.alias("to_url"))
    earlier = base.withColumn("ord", F.lit(0)).withColumn("to_url", F.lit("https://never.example.com"))
    more = base.select("export_id", "ord", F.concat("from_url", F.lit("/more")).alias("from_url"), F.concat("to_url", F.lit("-more")).alias("to_url"))
    texts = pages.select(F.col("page_id").alias("export_id"), F.concat(F.lit("see "), "url", F.lit(" and "), "url", F.lit("/more")).alias("text"))
    return urls.apply_url_remap(texts, urls.last_remap(base.unionByName(earlier).unionByName(more)), "text").select(F.col("export_id").alias("page_id"), "text")


@query("""
SELECT page_id, 'a https://cdn.example.com/' || page_id || '.png b https://cdn.example.com/' || page_id || '-2x.png' AS text FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT page_id, 'a ' || 'https://old.example.org/f/' || page_id || '.png b https://old.example.org/f/' || page_id || '-2x.png' FROM pages WHERE page_id % 4 = 0
""")
def attachment_remap(spark, d):
    """Texts with the URLs of fetched attachments, and of their resized copies, replaced; those of failed fetches stay."""
    k = F.col("page_id").cast("string")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("export_id"), F.col("page_id").alias("post_id"), F.concat(F.lit("https://old.example.org/f/"), k, F.lit(".png")).alias("url"), F.concat(F.lit("https://cdn.example.com/"), k, F.lit(".png")).alias("new_url"))
    checked = attachments.validate_fetches(pages.select("export_id", "post_id", F.lit(None).cast("string").alias("error"), F.when(F.col("post_id") % 4 == 0, 500).otherwise(200).alias("status"), F.lit(True).alias("has_headers"), F.lit(9).alias("file_size"), F.lit(None).cast("long").alias("content_length"), F.lit(None).cast("string").alias("content_encoding")))
    done = attachments.without_failed(pages, checked).withColumn("guid", F.col("url")).withColumn("final_location", F.lit(None).cast("string"))
    remaps = attachments.remap_rows(done)
    remaps = urls.last_remap(remaps.unionByName(urls.resized_stubs(remaps).select(*remaps.columns)))
    texts = pages.select("export_id", F.concat(F.lit("a "), "url", F.lit(" b "), F.replace("url", F.lit(".png"), F.lit("-2x.png"))).alias("text"))
    return urls.apply_url_remap(texts, remaps, "text").select(F.col("export_id").alias("page_id"), "text")


# --- URLs --------------------------------------------------------------------------------------------------------------

HREFS = r"""regexp_extract_all(html, '<a(?:\s[^>]*)?\shref="([^"]+)"', 1)"""


@query(f"SELECT 'attr' AS kind, regexp_extract(u, '^([a-z]+)://', 1) AS scheme, regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1) AS host, count(*) AS n, count(DISTINCT u) AS n_distinct FROM (SELECT unnest({HREFS}) AS u FROM pages) GROUP BY 1, 2, 3")
def url_attr_inventory(spark, d):
    return urls.inventory(urls.extract_urls(table(spark, d, "pages"), "page_id", "html", kinds=("attr",)))


@query(r"""
SELECT regexp_extract(u, '^https?://([^/?#:]*)', 1) AS host, count(*) AS n FROM (SELECT unnest(regexp_extract_all('Visit ' || url || ' or ' || url || '?p=1, today', 'https?://[^\s,]+')) AS u FROM pages) GROUP BY 1 ORDER BY n DESC, host LIMIT 20
""")
def url_text_inventory(spark, d):
    said = table(spark, d, "pages").select("page_id", F.concat(F.lit("Visit "), "url", F.lit(" or "), "url", F.lit("?p=1, today")).alias("html"))
    return urls.top_hosts(urls.extract_urls(said, "page_id", "html", kinds=("text",)), 20)


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'net' WHEN page_id % 3 = 1 THEN 'internal' END AS tld, (CASE WHEN page_id % 3 < 2 THEN 1 ELSE 0 END)::BIGINT AS n FROM pages
""")
def url_known_hosts(spark, d):
    """Hosts without a scheme count if their top-level domain is listed."""
    pages = table(spark, d, "pages")
    host = F.concat(F.lit("site"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".net").when(F.col("page_id") % 3 == 1, ".internal").otherwise(".qqqq"))
    said = pages.select("page_id", F.concat(F.lit("see "), host, F.lit(" now")).alias("html"))
    listed = spark.createDataFrame([("net",), ("com",), ("org",)], "tld string")
    found = urls.extract_urls(said, "page_id", "html", listed, ("text",)).groupBy("page_id").agg(F.count("*").alias("n"), F.max(F.substring_index("decoded", ".", -1)).alias("tld"))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", "tld", F.coalesce("n", F.lit(0)).alias("n"))


def _host_mapping(spark, d):
    hosts = table(spark, d, "pages").select(U.host(F.col("url")).alias("h"), U.scheme(F.col("url")).alias("s")).distinct()
    kept = hosts.filter(F.length("h") % 2 == 0)
    return kept.select(F.length("h").alias("ord"), F.concat("s", F.lit("://"), "h", F.lit("/")).alias("from_base"), F.concat(F.lit("https://moved.example.com/"), "h").alias("to_base"))


HOST_SQL = "regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS rest"


@query("SELECT page_id::VARCHAR AS export_id, 0 AS ord, rtrim(url, '/') || '/' AS from_base, 'https://new.example.com/' AS to_base FROM pages WHERE page_id % 2 = 0")
def url_site_mappings(spark, d):
    headers = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("export_id"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("not a url").alias("base_url"))
    return urls.site_mappings(headers, headers.select("export_id", F.lit("https://new.example.com").alias("site_url")))


@query(f"SELECT page_id, CASE WHEN length(h) % 2 = 0 THEN s || '://' || h || '/' END AS from_base FROM (SELECT page_id, {HOST_SQL} FROM pages)")
def url_child_match(spark, d):
    return urls.match_mappings(table(spark, d, "pages").select("page_id", F.col("url").alias("decoded")), _host_mapping(spark, d)).select("page_id", "from_base")


@query(f"SELECT page_id, CASE WHEN length(h) % 2 = 0 THEN 'https://moved.example.com/' || h || rest END AS new_url FROM (SELECT page_id, {HOST_SQL} FROM pages)")
def url_rebase(spark, d):
    matched = urls.match_mappings(table(spark, d, "pages").select("page_id", F.col("url").alias("decoded")), _host_mapping(spark, d))
    return matched.select("page_id", U.rebase_url(F.col("decoded"), F.col("from_base"), F.col("to_base")).alias("new_url"))


@query("""
SELECT page_id, '<p>Go <a class="x" href="https://new.example.com/p' || page_id || '?a=1&amp;b=2">there</a> or https://new.example.com/q' || page_id || ' <img src="/i.png"> https://old.example.org.evil/science/</p>' AS html, 3::BIGINT AS n_rewritten FROM pages
""")
def url_rewrite_html(spark, d):
    html = F.concat(
        F.lit('<p>Go <a class="x" href="https://old.example.org/science/p'), F.col("page_id").cast("string"), F.lit('?a=1&amp;b=2">there</a> or https://old.example.org/science/q'), F.col("page_id").cast("string"),
        F.lit(' <img src="/science/i.png"> https://old.example.org.evil/science/</p>'),
    )
    mapping = spark.createDataFrame([(0, "https://old.example.org/science/", "https://new.example.com/")], "ord int, from_base string, to_base string")
    return urls.rewrite_content(table(spark, d, "pages").select("page_id", html.alias("html")), mapping, "page_id", "html", "https://old.example.org/science/")


@query("""
SELECT page_id, '<a href="/images/' || page_id || '.png">1</a> <a href="/?q=1">2</a> <a href="../other/x">3</a> <a href="/a/b/#f">4</a> <a href="#top">5</a> <a href="">6</a> <a href="/p%20q/c">7</a> <!-- wp:image {"url":"/i.png"} /-->' AS html, 5::BIGINT AS n_rewritten FROM pages
""")
def url_relative(spark, d):
    """Relative URLs of every kind, read against a folder: those below it move to paths from the new root, others stay."""
    html = F.concat(
        F.lit('<a href="images/'), F.col("page_id").cast("string"), F.lit('.png">1</a> <a href="?q=1">2</a> <a href="../other/x">3</a> <a href="./a/x/../b/#f">4</a> <a href="#top">5</a> <a href="">6</a> <a href="../science/p%20q/./c">7</a> <!-- wp:image {"url":"i.png"} /-->'),
    )
    mapping = spark.createDataFrame([(0, "https://old.example.org/science/", "https://new.example.com/")], "ord int, from_base string, to_base string")
    return urls.rewrite_content(table(spark, d, "pages").select("page_id", html.alias("html")), mapping, "page_id", "html", "https://old.example.org/science/")


@query("SELECT page_id, html, 0::BIGINT AS n_rewritten FROM pages")
def url_rewrite_identity(spark, d):
    """Content without a URL below the base stays as it is, byte for byte."""
    mapping = spark.createDataFrame([(0, "https://nowhere.invalid/", "https://new.example.com/")], "ord int, from_base string, to_base string")
    return urls.rewrite_content(table(spark, d, "pages").select("page_id", "html"), mapping, "page_id", "html", "https://nowhere.invalid/")


@query("SELECT page_id, u AS decoded, count(*) AS n FROM (SELECT page_id, unnest([url || '/a.png', url || '/b.png']) AS u FROM pages) GROUP BY 1, 2")
def url_css(spark, d):
    style = F.concat(F.lit("<div style=\"background: url('"), "url", F.lit("/a.png'); /* url(no.png) */ content: 'url(fake.png)'; src: URL( "), "url", F.lit("/b.png ) url(data:image/png;base64,AA==)\">x</div>"))
    found = urls.extract_urls(table(spark, d, "pages").select("page_id", style.alias("html")), "page_id", "html", kinds=("style",))
    return found.groupBy("page_id", "decoded").agg(F.count("*").alias("n"))


@query("SELECT page_id, u AS decoded FROM (SELECT page_id, unnest([url, '/' || page_id || '.png', 'https://z.example.org/' || page_id]) AS u FROM pages)")
def url_block_attrs(spark, d):
    k = F.col("page_id").cast("string")
    markup = F.concat(F.lit('<!-- wp:image {"url":"'), "url", F.lit('","src":"/'), k, F.lit('.png","alt":"/x","id":3,"nested":{"url":"https://no.example.org"},"custom":"https:\\/\\/z.example.org\\/'), k, F.lit('"} /--><!-- wp:other {"url":"/no"} -->'))
    found = urls.extract_urls(table(spark, d, "pages").select("page_id", markup.alias("html")), "page_id", "html", kinds=("block",))
    return found.select("page_id", "decoded")


@query("""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL)
SELECT w || '.' || CASE length(w) % 4 WHEN 0 THEN 'example.org' WHEN 1 THEN 'xn--cole-9oa.fr' WHEN 2 THEN 'xn--bcher-kva.example' ELSE 'xn--ls8h.la' END AS canonical_host, count(*) AS n FROM w GROUP BY 1
""")
def idn_hosts(spark, d):
    """International hosts made from all words of the documents, in one form."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    k = F.length("w") % 4
    end = F.when(k == 0, "Example.ORG").when(k == 1, "\u00c9cole.fr").when(k == 2, "b%C3%BCcher.example").otherwise("\U0001f4a9.la")
    hosts = words.select(F.concat(F.upper("w"), F.lit("."), end).alias("host"), "n")
    return urls.canonical_hosts(hosts, "host").groupBy("canonical_host").agg(F.sum("n").alias("n"))


@query("""
SELECT page_id, 'https://h' || page_id || '.example.org' AS decoded FROM pages WHERE page_id % 4 = 2
UNION ALL SELECT page_id, 'https://h' || page_id || '.example.org/p—q' FROM pages WHERE page_id % 4 = 3
""")
def url_text_rules(spark, d):
    """URLs in texts: none with credentials or two colons, hosts end before dashes, paths don't."""
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit("see https://user:pw@h"), k, F.lit(".example.org/x now"))
    text = F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("see https://a"), k, F.lit("::b/x now"))).otherwise(text)
    text = F.when(F.col("page_id") % 4 == 2, F.concat(F.lit("at https://h"), k, F.lit(".example.org—see"))).otherwise(text)
    text = F.when(F.col("page_id") % 4 == 3, F.concat(F.lit("at https://h"), k, F.lit(".example.org/p—q, ok"))).otherwise(text)
    return urls.extract_urls(table(spark, d, "pages").select("page_id", text.alias("html")), "page_id", "html").select("page_id", "decoded")


@query("SELECT page_id AS export_id, CASE WHEN page_id % 3 = 0 THEN 'enclosure' WHEN page_id % 3 = 1 THEN 'other' END AS key, CASE WHEN page_id % 3 = 0 THEN 'https://new.example.com/' || page_id ELSE url END || chr(10) || '17' AS value FROM pages")
def enclosure_remap(spark, d):
    """Metadata of attachments that were fetched: the URLs of enclosures move, other values stay."""
    pages = table(spark, d, "pages")
    key = F.when(F.col("page_id") % 3 == 0, "enclosure").when(F.col("page_id") % 3 == 1, "other")
    rows = pages.select(F.col("page_id").alias("export_id"), key.alias("key"), F.concat("url", F.lit("\n17")).alias("value"))
    remaps = pages.select(F.col("page_id").alias("export_id"), F.col("url").alias("from_url"), F.concat(F.lit("https://new.example.com/"), F.col("page_id").cast("string")).alias("to_url"))
    return urls.remap_enclosures(rows, remaps)


# --- blocks ------------------------------------------------------------------------------------------------------------


def _block_docs(spark, d):
    """Documents as block markup: a group with a paragraph and a void image; every seventh ends with a wrong closer."""
    k = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit('<!-- wp:group {"id":'), k, F.lit(',"layout":{"type":"'), "lang", F.lit('"}} --><!-- wp:paragraph -->'), F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit('<!-- /wp:paragraph --><!-- wp:image {"url":"/'), k, F.lit('.png"} /-->'),
        F.when(F.col("doc_id") % 7 == 0, "<!-- /wp:columns -->").otherwise("<!-- /wp:group -->"), F.lit("<!-- wp:broken {nope} -->"),
    )
    return table(spark, d, "documents").select("doc_id", body.alias("html"))


@query("SELECT block, count(*) AS n, sum(a)::BIGINT AS n_with_attrs, sum(v)::BIGINT AS n_void FROM (SELECT unnest([{'block': 'wp:group', 'a': 1, 'v': 0}, {'block': 'wp:paragraph', 'a': 0, 'v': 0}, {'block': 'wp:image', 'a': 1, 'v': 1}], recursive := true) FROM documents) GROUP BY 1")
def block_inventory(spark, d):
    return blocks.usage(blocks.delimiters(_block_docs(spark, d), "doc_id", "html"))


@query("""
WITH r AS (SELECT doc_id, unnest([{'ord': 0, 'block': 'wp:group', 'depth': 1, 'crumbs': 'wp:group'}, {'ord': 1, 'block': 'wp:paragraph', 'depth': 2, 'crumbs': 'wp:group/wp:paragraph'}, {'ord': 2, 'block': 'wp:paragraph', 'depth': 2, 'crumbs': 'wp:group/wp:paragraph'},
  {'ord': 3, 'block': 'wp:image', 'depth': 2, 'crumbs': 'wp:group/wp:image'}, {'ord': 4, 'block': CASE WHEN doc_id % 7 = 0 THEN 'wp:columns' ELSE 'wp:group' END, 'depth': 1, 'crumbs': 'wp:group'}], recursive := true) FROM documents)
SELECT doc_id, ord, block, depth, crumbs, CASE WHEN ord = 4 AND doc_id % 7 = 0 THEN 'closer doesn''t match' END AS error FROM r
""")
def block_tree(spark, d):
    nested = blocks.nesting(blocks.delimiters(_block_docs(spark, d), "doc_id", "html"), "doc_id")
    return nested.select("doc_id", "ord", "block", "depth", F.array_join("breadcrumbs", "/").alias("crumbs"), "error")


@query("SELECT doc_id, 'wp:paragraph' AS block, replace(text, '<', '&lt;') AS inner_html FROM documents")
def block_inner(spark, d):
    docs = _block_docs(spark, d)
    nested = blocks.nesting(blocks.delimiters(docs, "doc_id", "html"), "doc_id")
    return blocks.inner_html(docs, nested, "doc_id", "html").filter("block = 'wp:paragraph'").select("doc_id", "block", F.col("inner").alias("inner_html"))


@query("""
SELECT doc_id, block, depth, path, value FROM (SELECT doc_id, unnest([{'block': 'wp:group', 'depth': 1, 'path': 'id', 'value': doc_id::VARCHAR}, {'block': 'wp:group', 'depth': 1, 'path': 'layout', 'value': '{"type":"' || lang || '"}'},
  {'block': 'wp:group', 'depth': 2, 'path': 'layout.type', 'value': lang}, {'block': 'wp:image', 'depth': 1, 'path': 'url', 'value': '/' || doc_id || '.png'}], recursive := true) FROM documents)
""")
def block_attributes(spark, d):
    return blocks.attribute_paths(blocks.delimiters(_block_docs(spark, d), "doc_id", "html"), "doc_id").select("doc_id", "block", "depth", "path", "value")


@query("SELECT p_partkey, '<!-- wp:' || p_type || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' {\"q\":\"' || p_name || ' \\u003Cb\\u003E \\u0026\"}' END || CASE WHEN p_size % 2 = 0 THEN ' /' ELSE '' END || ' -->' AS markup FROM part")
def block_serialize(spark, d):
    attrs = F.when(F.col("p_size") % 5 == 0, "{}").otherwise(F.concat(F.lit('{"q":"'), "p_name", F.lit(' <b> &"}')))
    return table(spark, d, "part").select("p_partkey", blocks.serialize(F.concat(F.lit("wp:"), F.col("p_type")), attrs, F.col("p_size") % 2 == 0, F.lit(False)).alias("markup"))


# --- text hygiene ------------------------------------------------------------------------------------------------------


def _faulty(spark, d):
    """Documents as bytes; every fifth ends with a cut-off character."""
    data = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select("doc_id", "source", "text", F.when(F.col("doc_id") % 5 == 0, F.concat(data, F.unhex(F.lit("C3")))).otherwise(data).alias("data"))


@query("SELECT source, count(*) AS n_rows, sum((doc_id % 5 = 0)::BIGINT)::BIGINT AS n_invalid, sum((doc_id % 5 = 0 AND text IS NOT NULL)::BIGINT)::BIGINT AS invalid_bytes FROM documents GROUP BY 1")
def text_utf8_report(spark, d):
    return text.utf8_report(_faulty(spark, d), "data", "source")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(65533) ELSE text END AS clean, doc_id % 5 = 0 AS changed FROM documents")
def text_scrub(spark, d):
    return text.scrub_text(_faulty(spark, d).drop("text"), "data", "clean").select("doc_id", "clean", "changed")


@query("SELECT '0000FFFE' AS code_point, 2 * count(*) AS n, count(*) AS n_rows FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT '0001FFFF', count(*), count(*) FROM documents WHERE doc_id % 4 = 0")
def text_noncharacters(spark, d):
    marked = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\ufffe \ufffe").otherwise(""), F.when(F.col("doc_id") % 4 == 0, "\U0001ffff").otherwise(""))
    return text.noncharacter_report(table(spark, d, "documents").select(marked.alias("text")), "text")


@query("SELECT lang, count(text) AS n_rows, sum(length(text))::BIGINT AS code_points, sum(strlen(text))::BIGINT AS n_bytes, max(length(text))::INTEGER AS longest, quantile_disc(length(text), 0.5)::INTEGER AS median_code_points, quantile_disc(length(text), 0.75)::INTEGER AS p75_code_points, quantile_disc(strlen(text), 0.25)::INTEGER AS p25_bytes, quantile_disc(strlen(text), 0.99)::INTEGER AS p99_bytes FROM documents GROUP BY 1")
def text_length_profile(spark, d):
    profile = text.length_profile(table(spark, d, "documents"), "text", "lang")
    points, size = F.col("code_point_quantiles"), F.col("byte_quantiles")
    return profile.select(*profile.columns[:6], points[2].alias("p75_code_points"), size[0].alias("p25_bytes"), size[3].alias("p99_bytes"))


@query(f"SELECT page_id, 'attr' AS kind, u AS decoded, count(*) AS n FROM (SELECT page_id, unnest({HREFS}) AS u FROM pages) GROUP BY 1, 2, 3")
def sql_url_occurrences(spark, d):
    """URLs of pages by the table function, called in SQL beside the table."""
    table_functions.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("sql_pages")
    return spark.sql("SELECT page_id, u.kind, u.decoded, count(*) AS n FROM sql_pages, LATERAL url_occurrences(html) u WHERE u.kind = 'attr' GROUP BY ALL")


@query("SELECT doc_id, length(text) AS n_chars, doc_id // 2 AS post_parent FROM documents")
def sql_export_items(spark, d):
    """Items of exports parsed by the table function, called in SQL beside the scan."""
    table_functions.register(spark)
    items, channel = exports.split_chunks(exports.read_chunks(spark, document_exports(spark, d)))
    items.createOrReplaceTempView("sql_items")
    exports.headers_of(channel).createOrReplaceTempView("sql_headers")
    return spark.sql("SELECT i.post_id AS doc_id, length(i.post_content)::BIGINT AS n_chars, i.post_parent FROM (SELECT item_xml, root_tag FROM sql_items JOIN sql_headers USING (export_id)) x, LATERAL export_item(x.item_xml, x.root_tag) i")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '["' || p_name || '","' || p_name || '"]' WHEN 1 THEN '{"first":{"size":' || p_size || '},"again":{"size":' || p_size || '},"last":' || p_size || '}' ELSE '{"self":null,"size":' || p_size || '}' END AS value_json FROM part
""")
def meta_references(spark, d):
    """Values with back-references: to a string, to an object and a number in it, and to the value itself."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    value = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a:2:{i:0;s:"), F.octet_length(name).cast("string"), F.lit(':"'), name, F.lit('";i:1;R:2;}')))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('a:3:{s:5:"first";O:8:"stdClass":1:{s:4:"size";i:'), size, F.lit(';}s:5:"again";r:2;s:4:"last";R:3;}')))
        .otherwise(F.concat(F.lit('O:1:"A":2:{s:4:"self";r:1;s:4:"size";i:'), size, F.lit(";}")))
    )
    return meta.decode_serialized(table(spark, d, "part").select("p_partkey", value.alias("value")), "value").select("p_partkey", "value_json")


@query("""
SELECT doc_id, 'wp:b' AS block, NULL AS attr FROM documents UNION ALL SELECT doc_id, '/wp:b', NULL FROM documents UNION ALL SELECT doc_id, 'wp:c', '{"t":"' || doc_id || '"}' FROM documents
""")
def block_malformed(spark, d):
    """A block comment with broken attributes ends at its own end and is none; those after it are found."""
    k = F.col("doc_id").cast("string")
    html = F.concat(F.lit('<!-- wp:a {"x":1 --> '), F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit('<!-- wp:b -->z<!-- /wp:b --><!-- wp:c {"t":"'), k, F.lit('"} /-->'))
    found = blocks.delimiters(table(spark, d, "documents").select("doc_id", html.alias("html")), "doc_id", "html")
    return found.select("doc_id", F.concat(F.when(F.col("is_closer"), "/").otherwise(""), "block").alias("block"), F.col("attrs").alias("attr"))


@query("SELECT doc_id, text AS repaired FROM documents")
def text_repair(spark, d):
    wrong = F.when(F.col("doc_id") % 2 == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return text.repair_encoding(table(spark, d, "documents").select("doc_id", wrong.alias("text")), "text").select("doc_id", "repaired")


@query("SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 AND regexp_matches(text, '[\u0080-\u00FF]') THEN 'utf-8 read as latin-1' ELSE 'none' END AS repair FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\u0000-\u00FF]')")
def text_repair_bytes(spark, d):
    """Bytes of every second text in Latin-1, the others in UTF-8, of texts that Latin-1 can hold."""
    c = F.col("text")
    rows = table(spark, d, "documents").filter(~c.rlike(r"[^\x00-\xFF]")).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode(c, "ISO-8859-1")).otherwise(F.encode(c, "UTF-8")).alias("raw"))
    return text.repair_bytes(rows, "raw").select("doc_id", "text", "repair")


@query("SELECT block, attr, count(*) AS n FROM (SELECT unnest([{'block': 'wp:group', 'attr': 'id'}, {'block': 'wp:group', 'attr': 'layout'}, {'block': 'wp:image', 'attr': 'url'}], recursive := true) FROM documents) GROUP BY 1, 2")
def block_attribute_usage(spark, d):
    return blocks.attribute_usage(blocks.delimiters(_block_docs(spark, d), "doc_id", "html"), "doc_id")


# --- whole imports -----------------------------------------------------------------------------------------------------


def _counts(site: SiteTables) -> DataFrame:
    out = None
    for name in ("users", "terms", "posts", "post_terms", "comments"):
        n = getattr(site, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        out = n if out is None else out.unionByName(n)
    return out


COUNTS = """
SELECT 'users' AS entity, count(DISTINCT lang) AS n FROM documents UNION ALL SELECT 'terms', count(DISTINCT lang) FROM documents UNION ALL SELECT 'posts', count(*) FROM documents
UNION ALL SELECT 'post_terms', count(*) FROM documents UNION ALL SELECT 'comments', 0
"""


@query(COUNTS)
def import_idempotent(spark, d):
    """All documents imported twice; the second time adds no users, terms, posts or comments."""
    path = document_exports(spark, d)
    site = SiteTables.empty(spark)
    for version in ("a", "b"):
        result = import_exports(spark, path, site)
        at = f"{scratch_dir(spark)}/{version}"
        result.site.write(at)
        site = SiteTables.read(spark, at)
    return _counts(site)


@query("""
WITH d AS (SELECT doc_id, doc_id // 2 AS parent FROM documents)
SELECT d.doc_id AS post_id, CASE WHEN p.doc_id IS NULL OR d.parent = 0 THEN 0 ELSE d.parent END AS post_parent, length(t.text) AS n_chars FROM d JOIN documents t USING (doc_id) LEFT JOIN d p ON p.doc_id = d.parent
""")
def import_posts(spark, d):
    """All documents as one export: ids are kept, parents follow; a document whose id is 0 gets the next one."""
    path = exports.write_exports(document_posts(spark, d).withColumn("export", F.lit("all")), scratch_dir(spark) + "/exports", "export", "post_id")
    result = import_exports(spark, path, SiteTables.empty(spark))
    named = F.substring("post_title", 10, 20).cast("long")
    return result.site.posts.select(F.when(named == 0, 0).otherwise(F.col("ID")).alias("post_id"), "post_parent", F.length("post_content").cast("long").alias("n_chars"))


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0
  THEN '<a href="/p' || page_id || '">r</a> <a href="https://new.example.com/q' || page_id || '">a</a> <a href="https://ÉCOLE.example.org/z' || page_id || '">i</a> <!-- wp:image {"url":"/i.png"} /-->'
  ELSE '<a href="/science/p' || page_id || '">r</a> <a href="https://old.example.org/science/q' || page_id || '">a</a> <a href="https://new.example.com/z' || page_id || '">i</a> <!-- wp:image {"url":"/science/i.png"} /-->' END AS post_content FROM pages
""")
def import_rewrite(spark, d):
    """Two exports: each one's own links move, absolute, relative, in blocks, and to an international host; the other's stay."""
    k = F.col("page_id").cast("string")
    text = F.concat(F.lit('<a href="/science/p'), k, F.lit('">r</a> <a href="https://old.example.org/science/q'), k, F.lit('">a</a> <a href="https://\u00c9COLE.example.org/z'), k, F.lit('">i</a> <!-- wp:image {"url":"/science/i.png"} /-->'))
    rows = table(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("export"), F.col("page_id").alias("post_id"), F.concat(F.lit("Page "), k).alias("post_title"), text.alias("post_content"), F.lit("publish").alias("status"), F.lit("post").alias("post_type"))
    base = F.when(F.col("export") == "even", "https://old.example.org/science").otherwise("https://xn--cole-9oa.example.org")
    path = exports.write_exports(rows, scratch_dir(spark) + "/exports", "export", "post_id", base_url=base)
    result = import_exports(spark, path, SiteTables.empty(spark), ImportOptions(rewrite_urls=True, site_url="https://new.example.com"))
    return result.site.posts.select(F.substring("post_title", 6, 20).cast("long").alias("page_id"), "post_content")


@query("SELECT entity, outcome, n FROM (SELECT 'post' AS entity, 'created' AS outcome, count(*) AS n FROM documents UNION ALL SELECT 'term', 'created', count(DISTINCT lang) FROM documents UNION ALL SELECT 'export', 'ok', count(*) FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT 'author', 'created', count(*) FROM (SELECT DISTINCT source, lang FROM documents))")
def import_report(spark, d):
    result = import_exports(spark, document_exports(spark, d), SiteTables.empty(spark))
    report = result.report().filter("export_id IS NOT NULL AND entity IS NOT NULL AND outcome IS NOT NULL")
    return report.groupBy("entity", "outcome").agg(F.sum("n").alias("n"))


@query(COUNTS)
def stream_import(spark, d):
    """Exports of all documents, imported as a stream that ends when no files are left."""
    from sitemigrate.streaming import ingest

    root = scratch_dir(spark)
    path = document_exports(spark, d)
    run = ingest.import_stream(spark, path, f"{root}/site", f"{root}/checkpoint", ImportOptions(), available_now=True)
    run.awaitTermination()
    return _counts(SiteLog(spark, f"{root}/site").read())


@query("SELECT count(*) AS n_items, count(*) AS n_distinct FROM documents")
def stream_repeated_items(spark, d):
    """Items of a folder that holds every export twice, each item once."""
    from sitemigrate.streaming import ingest

    root = scratch_dir(spark)
    path = exports.write_exports(document_posts(spark, d), f"{root}/exports", "export", "post_id", copies=("", "-again"))
    ingest.collect_items(spark, path, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    return TableLog(spark, f"{root}/out", ingest.ITEMS).tables()["items"].agg(F.count("*").alias("n_items"), F.count_distinct("item_hash").alias("n_distinct"))


@query("SELECT doc_id, n FROM (SELECT doc_id, unnest([1, 2]) AS n FROM documents)")
def stream_torn_items(spark, d):
    """Items in CDATA sections with ends of items in their texts, two for each document that differ after these, in two
    micro-batches that hold both: each item once, whole."""
    from sitemigrate.streaming import ingest

    root = scratch_dir(spark)
    k = F.col("doc_id").cast("string")
    item = lambda n: F.concat(F.lit("<item><wp:post_id>"), k, F.lit("</wp:post_id><content:encoded><![CDATA["), F.replace("text", F.lit("]]>"), F.lit("")), F.lit(f" </item> <item> </item> {n}]]></content:encoded></item>"))
    docs = table(spark, d, "documents").select(F.lit("torn").alias("export"), F.concat(item(1), item(2)).alias("value"))
    for n in ("a", "b"):
        docs.select("value").write.text(f"{root}/in/export={n}")
        ingest.collect_items(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    items = TableLog(spark, f"{root}/out", ingest.ITEMS).tables()["items"]
    found = items.select(F.regexp_extract("item_xml", r"<wp:post_id>(\d+)", 1).cast("long").alias("doc_id"), F.regexp_extract("item_xml", r"(?s)</item> <item> </item> (\d)\]\]>", 1).cast("int").alias("n"))
    return found.select("doc_id", "n")


@query("""
WITH counts AS (SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM nation) AS items)
SELECT 'posts' AS kind, 2 * pages AS n, 2 * pages AS n_ids, pages AS n_kept FROM counts UNION ALL SELECT 'menu items', 2 * items, 2 * items, 0 FROM counts
UNION ALL SELECT 'both', 2 * pages + 2 * items, 2 * pages + 2 * items, pages FROM counts
""")
def import_menus(spark, d):
    """Pages as posts, half of them without an id, and menu items that ask for the same ids, over two imports: all ids differ.

    The second import's posts ask for ids that the first one's menu items may have; posts of the first that ask keep theirs.
    """
    site = replace(SiteTables.empty(spark), terms=spark.createDataFrame([(1, "nav_menu", "main", "Main", 0)], SCHEMAS["terms"]))
    k = F.col("page_id")
    for n in (1, 2):
        named = F.concat(F.lit(f"Page {n} "), k.cast("string"))
        rows = table(spark, d, "pages").select(F.lit("menus").alias("export"), k.alias("o"), F.when(F.lit(n == 1), k + 1).otherwise(0).alias("post_id"), named.alias("post_title"), F.lit("post").alias("post_type"), F.lit("publish").alias("status"), F.lit(None).cast("array<struct<name:string,slug:string,domain:string>>").alias("terms"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("postmeta"))
        values = {"type": F.lit("custom"), "url": F.concat(F.lit("https://x.example.org/"), "n_name"), "object": F.lit("custom"), "menu_item_parent": F.lit("0")}
        items = table(spark, d, "nation").select(
            F.lit("menus").alias("export"), (F.col("n_nationkey") + (1 << 40)).alias("o"), (F.col("n_nationkey") + 1).alias("post_id"), F.col("n_name").alias("post_title"), F.lit("nav_menu_item").alias("post_type"), F.lit("publish").alias("status"),
            F.array(F.struct(F.lit("Main").alias("name"), F.lit("main").alias("slug"), F.lit("nav_menu").alias("domain"))).alias("terms"), F.array(*(F.struct(F.lit(f"_menu_item_{key}").alias("key"), v.alias("value")) for key, v in values.items())).alias("postmeta"),
        )
        path = exports.write_exports(rows.unionByName(items.withColumn("post_id", F.col("post_id") + (1 << 40))), f"{scratch_dir(spark)}/exports", "export", "o")
        result = import_exports(spark, path, site)
        at = f"{scratch_dir(spark)}/site"
        result.site.write(at)
        site = SiteTables.read(spark, at)
    post = site.posts.select(F.lit("posts").alias("kind"), "ID", (F.col("post_title") == F.concat(F.lit("Page 1 "), (F.col("ID") - 1).cast("string"))).alias("kept"))
    both = post.unionByName(site.menu_items.select(F.lit("menu items").alias("kind"), "ID", F.lit(False).alias("kept")))
    both = both.unionByName(both.withColumn("kind", F.lit("both")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("ID").alias("n_ids"), F.sum(F.col("kept").cast("long")).alias("n_kept"))


@query("SELECT 'posts' AS entity, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'comments', count(*) FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def import_twice_in_one_batch(spark, d):
    """Conversations as posts with their turns as comments, in two files of one batch: the second file's comments are known."""
    turns = table(spark, d, "conversations").groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"))
    comment = F.struct((F.col("turn") + 1).cast("long").alias("comment_id"), F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), "role").alias("author"), F.col("turn").cast("string").alias("date"), F.lit("x").alias("content"), F.lit("1").alias("approved"), F.lit("0").alias("parent"), F.lit(0).cast("long").alias("user_id"))
    posts_ = turns.groupBy("conv_id").agg(F.collect_list(comment).alias("comments")).select("conv_id", F.col("conv_id").alias("post_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("post_title"), F.lit("post").alias("post_type"), F.lit("publish").alias("status"), "comments")
    twice = posts_.withColumn("export", F.lit("one")).unionByName(posts_.withColumn("export", F.lit("two")))
    site = import_exports(spark, exports.write_exports(twice, f"{scratch_dir(spark)}/exports", "export", "conv_id"), SiteTables.empty(spark)).site
    return site.posts.agg(F.count("*").alias("n")).select(F.lit("posts").alias("entity"), "n").unionByName(site.comments.agg(F.count("*").alias("n")).select(F.lit("comments").alias("entity"), "n"))
