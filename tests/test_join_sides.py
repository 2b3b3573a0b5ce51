"""Tables with a row for each post aren't sent to all tasks, though their files are small."""

from dataclasses import replace

from pyspark.sql import functions as F

from sitemigrate.operators import comments, ids, menus, meta, posts
from sitemigrate.plans.importing import import_exports
from sitemigrate.sources.site import SiteTables
from sitemigrate.storage import keep
from test_exports import export

PLACE = "struct<block:bigint,row:bigint>"
ITEM = "<item><title>P{0}</title><wp:post_id>{0}</wp:post_id><wp:post_parent>{1}</wp:post_parent><wp:post_type>post</wp:post_type><wp:status>publish</wp:status></item>"


def sent(df):
    """The lines of a plan that send a table to all tasks, but for tables that are small by nature."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "taxonomy#" not in x and "login#" not in x]


def test_operators_deal_both_sides(spark):
    table = lambda rows, schema: keep(spark, spark.createDataFrame(rows, schema))
    of = table([("e", 1, 0, "a", "d", "post")], "export_id string, post_id bigint, post_parent bigint, post_title string, post_date string, post_type string")
    id_map = table([("e", 1, 7)], "export_id string, old_id bigint, new_id bigint")
    site = table([(9, "a", "d", "post")], "ID bigint, post_title string, post_date string, post_type string")
    said = table([("e", (0, 1), 1, 0, "0", "x", "d", True)], f"export_id string, post_doc_pos {PLACE}, comment_id bigint, user_id bigint, parent string, author string, date string, post_exists boolean")
    item = table([("e", 1, 0, 5, "post_type", 1, None)], "export_id string, item_id bigint, parent_item bigint, new_id bigint, item_type string, object_id bigint, reason string")
    plans = [
        posts.remap_parents(of, id_map), posts.match_existing(of, site), comments.drop_known(said, said.select("author", "date"), ["comment_id"]),
        comments.remap_parents(said, said.select("export_id", "post_doc_pos", "comment_id", F.lit(2).alias("new_id"))), menus.link_parents(item),
        meta.remap_references(table([("e", 7, "_thumbnail_id", "1")], "export_id string, post_id bigint, key string, value string"), table([], "export_id string, author_id bigint, user_id bigint"), id_map).filter("key = '_thumbnail_id'"),
        replace(SiteTables.empty(spark), sticky_posts=of.select("post_id")).fresh("sticky_posts", of.select("post_id")),
    ]
    assert [sent(p) for p in plans] == [[] for _ in plans]
    marked = ids.allocate_ids(spark, of, site, "post_id", "ID", ["export_id"])
    assert {r["new_id"] for r in marked.collect()} == {1}


def test_an_import_sends_no_table_of_posts(spark, tmp_path):
    path = export(tmp_path, "a.xml", "".join(ITEM.format(n, n // 2) for n in range(1, 30)))
    first = import_exports(spark, path, SiteTables.empty(spark))
    first.site.write(f"{tmp_path}/site")
    again = import_exports(spark, path, SiteTables.read(spark, f"{tmp_path}/site"))
    for name in ("id_map", "post_terms", "sticky_posts", "commentmeta"):
        assert not sent(getattr(again.site, name)), name
    assert not sent(again.added["posts"])
    assert again.site.posts.count() == 29 and again.added["posts"].count() == 0
