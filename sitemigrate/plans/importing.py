"""The whole import: export files and a site's tables in, the site's new tables and a report out.

Ids are given before anything is linked, so that references in any direction are joins, and nothing is mended later.
Posts are routed, matched, numbered and linked without their texts (``TEXTS``), which meet the new posts once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemigrate.operators import authors as A
from sitemigrate.operators import comments as C
from sitemigrate.operators import ids, menus, meta, posts, terms, urls
from sitemigrate.sources import exports
from sitemigrate.sources.site import KEYS, SiteTables
from sitemigrate.storage import dealt, keep

Transform = Callable[[DataFrame], DataFrame]
#: Types that a site has by default.
POST_TYPES = ["post", "page", "attachment", "revision", "nav_menu_item", "custom_css", "customize_changeset", "oembed_cache", "user_request", "wp_block", "wp_template", "wp_template_part", "wp_global_styles", "wp_navigation"]


#: The columns of posts that only those that are loaded need; and what tells the rows of posts apart.
TEXTS = ["post_content", "post_excerpt"]
ROW = ["export_id", "doc_pos", "__row"]


def same(df: DataFrame) -> DataFrame:
    return df


@dataclass
class ImportOptions:
    """Choices of an import, and functions on its tables before they are used (``transform_*``)."""

    site_url: str | None = None  # with rewrite_urls, content is moved from each export's base URL to this one
    rewrite_urls: bool = False
    default_user: int = 1
    create_users: bool = True
    resolve_any_parent: bool = False
    dedupe_meta: bool = False
    dedupe_menu: bool = False
    post_types: list[str] = field(default_factory=lambda: list(POST_TYPES))
    author_policy: DataFrame | None = None
    existing_override: DataFrame | None = None
    failed_attachments: DataFrame | None = None  # (export_id, post_id, reason), as validate_fetches gives
    url_remaps: DataFrame | None = None  # (export_id, from_url, to_url) of fetched attachments
    transform_terms: Transform = same
    transform_posts: Transform = same
    transform_post_terms: Transform = same
    transform_comments: Transform = same
    transform_postmeta: Transform = same
    transform_termmeta: Transform = same
    transform_commentmeta: Transform = same
    transform_content: Transform = same  # posts that are made, after their URLs moved
    postmeta_key: Column | None = None  # an expression of key and value; null or empty leaves the row out
    termmeta_key: Column | None = None
    block_attributes: dict[str, list[str]] | None = None  # further block attributes that may hold relative URLs
    salvage: bool = True  # items that aren't XML are read by their tags


@dataclass
class ImportResult:
    site: SiteTables
    exports: DataFrame
    quarantine: DataFrame
    log: DataFrame  # entity, outcome, reason, export_id: one row for each handled thing
    added: dict[str, DataFrame]  # new rows by table
    replaced: dict[str, DataFrame]  # keys of rows that new ones replace, by table

    def report(self) -> DataFrame:
        """Counts by export, entity and outcome, with subtotals (nulls) and the grand total."""
        return self.log.rollup("export_id", "entity", "outcome").agg(F.count("*").alias("n"))


def import_exports(spark: SparkSession, paths: str | list[str], site: SiteTables, options: ImportOptions | None = None) -> ImportResult:
    """Imports export files into ``site`` and returns its new state; nothing is written where ``site`` is kept.

    Importing the same files again adds no users, terms, posts or comments; post metadata and menu items are repeated unless
    ``dedupe_meta`` and ``dedupe_menu`` say otherwise.
    """
    o = options or ImportOptions()
    chunks = keep(spark, exports.read_chunks(spark, paths))
    items, channel = exports.split_chunks(chunks)
    headers = keep(spark, exports.validate_exports(exports.headers_of(channel)))
    valid = headers.filter("status <> 'error'")
    parsed = exports.parse_items(items, valid, salvage=o.salvage)
    parsed = keep(spark, parsed.withColumn("item_xml", F.when(F.col("error").isNotNull(), F.col("item_xml"))))
    refused = exports.quarantine(parsed)
    if o.salvage:
        parsed = parsed.withColumn("error", F.lit(None).cast("string"))
    channel = keep(spark, exports.parse_channel(channel, valid))
    flat = exports.flatten_entities(parsed)
    log = [headers.select("export_id", F.lit("export").alias("entity"), F.col("status").alias("outcome"), "reason")]

    author_map, made = _users(spark, site, valid, exports.authors_of(channel), flat["posts"], o)
    log.append(author_map.select("export_id", F.lit("author").alias("entity"), F.col("how").alias("outcome"), F.lit(None).cast("string").alias("reason")))

    declared, termmeta = exports.terms_of(channel)
    if o.transform_posts is same:
        whole = flat["posts"].withColumn("__row", F.lit(0).cast("long"))
    else:  # rows of any number, with texts of their own
        whole = keep(spark, o.transform_posts(flat["posts"]).withColumn("__row", F.monotonically_increasing_id()))
    routed = keep(spark, posts.route_posts(whole.drop(*TEXTS), spark.createDataFrame([(t,) for t in o.post_types], "post_type string")))
    if o.failed_attachments is not None:
        failed = o.failed_attachments.filter("reason IS NOT NULL").select("export_id", "post_id", F.lit("fetch failed").alias("__failed"))
        routed = routed.join(failed, ["export_id", "post_id"], "left").withColumn("route", F.when(F.col("__failed").isNotNull(), "reject").otherwise(F.col("route"))).withColumn("reason", F.coalesce("reason", "__failed")).drop("__failed")
    loading = routed.filter("route = 'post'")
    log.append(routed.filter("route IN ('skip', 'reject')").select("export_id", F.lit("post").alias("entity"), F.col("route").alias("outcome"), "reason"))

    post_rows = keep(spark, _posts(spark, site, loading, o))
    log.append(post_rows.select("export_id", F.lit("post").alias("entity"), F.when(F.col("inserted"), "created").otherwise("exists").alias("outcome"), F.lit(None).cast("string").alias("reason")))
    post_map = post_rows.select("export_id", F.col("post_doc_pos"), F.col("post_id").alias("old_id"), F.col("new_id"), "inserted", "existed")

    links = o.transform_post_terms(flat["post_terms"]).join(dealt(post_map.select("export_id", "post_doc_pos", "new_id")), ["export_id", "post_doc_pos"])
    term_rows = keep(spark, _terms(spark, site, o.transform_terms(terms.in_load_order(declared, links)), o))
    log.append(term_rows.select(F.col("export_id"), F.lit("term").alias("entity"), F.when(F.col("is_new"), "created").otherwise("exists").alias("outcome"), F.lit(None).cast("string").alias("reason")))
    bridge = links.select(F.col("new_id").alias("post_id"), terms.legacy_domain("domain").alias("taxonomy"), "slug").join(term_rows.select("taxonomy", "slug", "term_id"), ["taxonomy", "slug"])
    bridge = terms.post_terms_bridge(bridge)
    new_termmeta = terms.new_term_meta(o.transform_termmeta(termmeta), term_rows).select("term_id", (F.col("key") if o.termmeta_key is None else o.termmeta_key).alias("key"), "value").filter("coalesce(key, '') <> ''")

    final = _link_posts(spark, post_rows, post_map, author_map, whole, valid, o)
    comments, commentmeta = _comments(spark, site, o.transform_comments(flat["comments"]), o.transform_commentmeta(flat["commentmeta"]), post_map, author_map)
    log.append(comments.select("export_id", F.lit("comment").alias("entity"), F.lit("created").alias("outcome"), F.lit(None).cast("string").alias("reason")))

    id_pairs = post_map.filter("old_id <> 0").select("export_id", "old_id", "new_id")
    own_meta = o.transform_postmeta(flat["postmeta"]).join(dealt(post_map.select("export_id", "post_doc_pos", F.col("new_id").alias("post_id"))), ["export_id", "post_doc_pos"])
    own_meta = meta.remap_references(meta.filter_keys(own_meta.select("export_id", "post_id", "key", "value"), o.postmeta_key), author_map, id_pairs)
    if o.url_remaps is not None:
        own_meta = urls.remap_enclosures(own_meta, o.url_remaps)
    own_meta = own_meta.select("post_id", "key", "value")
    menu_items = _with_texts(routed.filter("route = 'menu'"), whole.filter("post_type = 'nav_menu_item'"))
    menu_rows, menu_log = _menus(spark, site, menu_items, flat, term_rows, declared, post_map, o)
    log.append(menu_log)

    maps = id_pairs.select("export_id", F.lit("post").alias("kind"), F.col("old_id").cast("string").alias("old_key"), "new_id").unionByName(author_map.select("export_id", F.lit("author").alias("kind"), F.col("author_login").alias("old_key"), F.col("user_id").alias("new_id")))
    rows = {
        "users": made,
        "terms": term_rows.filter("is_new"),
        "termmeta": new_termmeta,
        "posts": final.withColumn("ID", F.col("new_id")).withColumn("post_author", F.col("post_author_id")).withColumn("post_status", F.col("status")).withColumn("post_parent", F.col("new_parent")),
        "postmeta": own_meta,
        "comments": comments.drop("comment_id", "user_id", "parent").withColumnsRenamed({"new_id": "comment_id", "new_user_id": "user_id", "new_parent": "parent"}),
        "commentmeta": commentmeta.select(F.col("new_id").alias("comment_id"), "key", "value"),
        "menu_items": menu_rows,
    }
    added = {name: site.shaped(name, new) for name, new in rows.items()}
    if o.dedupe_meta:
        added["postmeta"] = site.fresh("postmeta", own_meta)
    added["post_terms"] = site.fresh("post_terms", bridge)
    added["sticky_posts"] = site.fresh("sticky_posts", post_rows.filter("is_sticky = 1").select(F.col("new_id").alias("post_id")))
    added["id_map"] = keep(spark, site.fresh("id_map", maps.groupBy("export_id", "kind", "old_key").agg(F.max("new_id").alias("new_id"))))
    replaced = {"id_map": added["id_map"].select(*KEYS["id_map"]).join(dealt(site.id_map), KEYS["id_map"], "left_semi")}
    everything = log[0]
    for rows in log[1:]:
        everything = everything.unionByName(rows)
    return ImportResult(site.changed(added, replaced), headers, refused, everything, added, replaced)


def _users(spark, site: SiteTables, headers: DataFrame, declared: DataFrame, all_posts: DataFrame, o: ImportOptions):
    """The map of authors (user_id set for all), and the users to make."""
    known = A.last_by_login(declared).select("export_id", "author_id", "author_login", "author_display_name", "author_email")
    inferred = A.infer_authors(all_posts).filter("NOT failed").join(known.select("export_id").distinct(), "export_id", "left_anti")
    everyone = known.unionByName(inferred.select("export_id", F.lit(0).cast("long").alias("author_id"), "author_login", "author_display_name", F.lit(None).cast("string").alias("author_email")))
    policy = o.author_policy if o.author_policy is not None else spark.createDataFrame([], "export_id string, author_login string, use_login string, new_login string")
    default_policy = everyone.select("export_id", "author_login", F.col("author_login").alias("use_login"), F.lit(None).cast("string").alias("new_login"))
    chosen = policy.unionByName(default_policy.join(policy.select("export_id", "author_login"), ["export_id", "author_login"], "left_anti"))
    mapped = keep(spark, A.map_authors(everyone, chosen, site.users.select("user_id", "user_login"), headers, o.default_user, o.create_users))
    named = everyone.select("export_id", A.sanitize_login("author_login").alias("author_login"), "author_display_name", "author_email")
    wanted = mapped.filter("user_id IS NULL").join(named, ["export_id", "author_login"]).groupBy("new_login").agg(F.min_by(F.struct("author_display_name", "author_email"), F.struct("export_id", "author_login")).alias("u"))
    made = ids.allocate_ids(spark, wanted.select("new_login", F.lit(0).cast("long").alias("old"), "u.*"), site.users, "old", "user_id", ["new_login"], "user_id")
    made = keep(spark, made.select("user_id", F.col("new_login").alias("user_login"), F.col("author_display_name").alias("display_name"), F.col("author_email").alias("user_email")))
    logins = site.append("users", made).select("user_login", F.col("user_id").alias("__made"))
    full = mapped.join(logins, F.col("new_login") == F.col("user_login"), "left").withColumn("user_id", F.coalesce("user_id", "__made")).drop("user_login", "__made")
    return keep(spark, full), made


def _posts(spark, site: SiteTables, loading: DataFrame, o: ImportOptions) -> DataFrame:
    """Posts with ``new_id``, ``inserted`` (a new row is made) and ``existed`` (the site, or an item before, had it)."""
    matched = posts.match_existing(loading, site.posts, o.existing_override)
    # An item like one of any file before it meets the post that this one makes, as if the files came one after the other.
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in posts.NATURAL_KEY]
    first = matched.groupBy(*key).agg(F.min(F.struct("export_id", "doc_pos")).alias("__meet"))
    keyed = matched.select("*", *key).join(dealt(first), [f"__{c}" for c in posts.NATURAL_KEY]).select(matched["*"], "__meet")
    keyed = keyed.withColumn("inserted", F.col("existing_id").isNull() & (F.col("__meet") == F.struct("export_id", "doc_pos"))).withColumn("existed", ~F.col("inserted"))
    new = ids.allocate_ids(spark, keyed.filter("inserted"), _taken(site), "post_id", "ID", ["export_id", "doc_pos"])
    others = keyed.filter("NOT inserted").join(dealt(new.select(F.col("export_id").alias("__e"), F.col("doc_pos").alias("__p"), "new_id")), (F.col("__meet.export_id") == F.col("__e")) & (F.col("__meet.doc_pos") == F.col("__p")), "left")
    others = others.withColumn("new_id", F.coalesce("existing_id", "new_id")).drop("__e", "__p")
    return new.unionByName(others).drop("__meet").withColumn("post_doc_pos", F.col("doc_pos"))


def _taken(site: SiteTables) -> DataFrame:
    """Ids (ID) of the site's posts and menu items, which share one space."""
    return site.posts.select("ID").unionByName(site.menu_items.select("ID"))


def _with_texts(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """``rows`` of posts with their texts; rows are hashed, so that texts aren't put in order for it."""
    return whole.select(*ROW, *(c for c in TEXTS if c in whole.columns)).join(rows.hint("shuffle_hash"), ROW).drop("__row")


def _link_posts(spark, post_rows: DataFrame, post_map: DataFrame, author_map: DataFrame, whole: DataFrame, headers: DataFrame, o: ImportOptions) -> DataFrame:
    """Posts to make with their author, parent, and content with URLs moved."""
    out = A.remap_post_authors(post_rows.filter("inserted"), author_map, o.default_user)
    out = posts.remap_parents(out, post_map.filter("old_id <> 0").select("export_id", "old_id", "new_id"))
    out = _with_texts(out, whole)
    if o.rewrite_urls and o.site_url:
        targets = headers.select("export_id", F.lit(o.site_url).alias("site_url"))
        mapping = urls.site_mappings(headers, targets)  # each export's links move from its own base only
        folder = F.concat(F.rtrim("base_url", F.lit("/")), F.lit("/"))
        out = keep(spark, out.join(headers.select("export_id", folder.alias("__base_url")), "export_id", "left"))
        for column in ("post_content", "post_excerpt"):
            out = urls.rewrite_content(out, mapping, "new_id", column, F.col("__base_url"), by="export_id", block_attributes=o.block_attributes).drop("n_rewritten")
        out = out.drop("__base_url")
    if o.url_remaps is not None:
        out = urls.apply_url_remap(out, o.url_remaps, "post_content")
    return o.transform_content(out)


def _terms(spark, site: SiteTables, ordered: DataFrame, o: ImportOptions) -> DataFrame:
    """All terms of the import with ``term_id``, ``is_new`` and ``parent_id``."""
    rows = terms.get_or_create(ordered.filter("coalesce(slug, '') <> '' AND coalesce(taxonomy, '') <> ''"), site.terms, ["phase", "export_id", "doc_pos", "ord"])
    order = ["phase", "export_id", "doc_pos", "ord"]
    fresh = ids.allocate_ids(spark, rows.filter("is_new").withColumn("__old", F.lit(0).cast("long")), site.terms, "__old", "term_id", [*order, "taxonomy", "slug"], "term_id").drop("__old")
    known = rows.filter("NOT is_new").withColumn("term_id", F.col("site_term_id"))
    ranked = ids.dense_rank_rows(spark, fresh.unionByName(known), [*order, "taxonomy", "slug"], "place")
    return terms.resolve_parents(ranked, site.terms, "place", o.resolve_any_parent)


def _comments(spark, site: SiteTables, raw: DataFrame, raw_meta: DataFrame, post_map: DataFrame, author_map: DataFrame):
    """Comments that are inserted, with ``new_id``, ``new_user_id`` and ``new_parent``, and their metadata."""
    of_posts = C.last_by_id(raw).join(dealt(post_map.select("export_id", "post_doc_pos", F.col("new_id").alias("post_id"), F.col("existed").alias("post_exists"))), ["export_id", "post_doc_pos"])
    fresh = C.drop_known(of_posts, site.comments.select("author", "date"), ["export_id", "post_doc_pos", "comment_id"])
    numbered = ids.allocate_ids(spark, fresh.withColumn("__old", F.lit(0).cast("long")), site.comments, "__old", "comment_id", ["export_id", "post_doc_pos", "comment_id"]).drop("__old")
    inserted = keep(spark, numbered)
    linked = C.remap_parents(C.remap_users(inserted, author_map), inserted.select("export_id", "post_doc_pos", "comment_id", "new_id"))
    return linked, C.loadable_meta(raw_meta, inserted)


def _menus(spark, site: SiteTables, items: DataFrame, flat: dict, term_rows: DataFrame, declared: DataFrame, post_map: DataFrame, o: ImportOptions):
    """Menu items to insert and their log."""
    place = ["export_id", "post_doc_pos"]
    own = items.withColumn("post_doc_pos", F.col("doc_pos"))
    of = flat["post_terms"].groupBy(*place).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "domain", "slug"))), lambda t: F.struct(t["domain"].alias("domain"), t["slug"].alias("slug"))).alias("terms"))
    fields = meta.pivot(flat["postmeta"], menus.KEYS, place)
    joined = own.join(dealt(of), place, "left").join(dealt(fields), place, "left")
    named = joined.select(
        "export_id", "post_doc_pos", F.col("post_id").alias("item_id"), "post_title", "terms", F.col("_menu_item_type").alias("item_type"), F.col("_menu_item_object_id").try_cast("bigint").alias("object_id"),
        F.coalesce(F.col("_menu_item_menu_item_parent").try_cast("bigint"), F.lit(0)).alias("parent_item"), F.col("_menu_item_classes").alias("classes"), F.col("_menu_item_url").alias("url"),
        F.col("_menu_item_target").alias("target"), F.col("_menu_item_xfn").alias("xfn"), F.col("_menu_item_object").alias("object"), "status", F.col("post_content").alias("description"), F.col("post_excerpt").alias("attr_title"), "menu_order",
    )
    known = site.terms.select("taxonomy", "slug", "term_id").unionByName(term_rows.select("taxonomy", "slug", "term_id")).filter("taxonomy = 'nav_menu'")
    with_menu = menus.menu_of(named, known.groupBy("slug").agg(F.min("term_id").alias("menu_id")))
    term_pairs = declared.filter("term_id <> 0").join(term_rows.select("taxonomy", "slug", F.col("term_id").alias("new_id")), ["taxonomy", "slug"]).groupBy("export_id", F.col("term_id").alias("old_id")).agg(F.min("new_id").alias("new_id"))
    linked = keep(spark, menus.link_objects(with_menu, term_pairs, post_map.filter("old_id <> 0").select("export_id", "old_id", "new_id")))
    good = linked.filter("reason IS NULL")
    if o.dedupe_menu:
        good = good.join(site.menu_items.select("menu_id", "post_title", "item_type", F.col("object_id").alias("new_object_id")), ["menu_id", "post_title", "item_type", "new_object_id"], "left_anti")
    taken = _taken(site).unionByName(post_map.select(F.col("new_id").alias("ID")))  # posts without an old id as well
    numbered = ids.allocate_ids(spark, good.withColumn("__old", F.lit(0).cast("long")), taken, "__old", "ID", ["export_id", "post_doc_pos"]).drop("__old")
    parents = menus.css_classes(menus.link_parents(keep(spark, numbered)))
    rows = parents.select(F.col("new_id").alias("ID"), "menu_id", "post_title", "item_type", F.col("new_object_id").alias("object_id"), F.col("new_parent").alias("menu_item_parent"), "classes", "url", "target", "xfn", "description", "attr_title", "menu_order", "object", "status")
    log = linked.select("export_id", F.lit("menu item").alias("entity"), F.when(F.col("reason").isNull(), "created").otherwise("reject").alias("outcome"), "reason")
    return rows, log
