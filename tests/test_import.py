import pytest
from pyspark.sql import functions as F

from sitemigrate.plans.importing import ImportOptions, import_exports
from sitemigrate.sources.site import SiteTables
from sitemigrate.sources.site_log import SiteLog
from test_exports import export

BODY = """
<wp:author><wp:author_id>2</wp:author_id><wp:author_login>ann</wp:author_login><wp:author_display_name>Ann</wp:author_display_name></wp:author>
<wp:category><wp:term_id>7</wp:term_id><wp:category_nicename>top</wp:category_nicename><wp:cat_name>Top</wp:cat_name></wp:category>
<wp:category><wp:term_id>8</wp:term_id><wp:category_nicename>sub</wp:category_nicename><wp:category_parent>top</wp:category_parent><wp:cat_name>Sub</wp:cat_name></wp:category>
<wp:term><wp:term_id>9</wp:term_id><wp:term_taxonomy>nav_menu</wp:term_taxonomy><wp:term_slug>main</wp:term_slug><wp:term_name>Main</wp:term_name></wp:term>
<item><title>Child</title><dc:creator>ann</dc:creator><wp:post_id>10</wp:post_id><wp:post_parent>11</wp:post_parent><wp:post_type>page</wp:post_type><wp:status>publish</wp:status><wp:post_date>d1</wp:post_date><wp:is_sticky>1</wp:is_sticky>
<content:encoded><![CDATA[<a href="https://old.example.org/x">x</a> \\ back]]></content:encoded><category domain="category" nicename="sub">Sub</category><category domain="tag" nicename="t1">T1</category>
<wp:postmeta><wp:meta_key>_edit_last</wp:meta_key><wp:meta_value>2</wp:meta_value></wp:postmeta><wp:postmeta><wp:meta_key>_thumbnail_id</wp:meta_key><wp:meta_value>11</wp:meta_value></wp:postmeta>
<wp:comment><wp:comment_id>1</wp:comment_id><wp:comment_author>bob</wp:comment_author><wp:comment_date>c1</wp:comment_date><wp:comment_user_id>2</wp:comment_user_id></wp:comment>
<wp:comment><wp:comment_id>2</wp:comment_id><wp:comment_author>eve</wp:comment_author><wp:comment_date>c2</wp:comment_date><wp:comment_parent>1</wp:comment_parent><wp:commentmeta><wp:meta_key>rate</wp:meta_key><wp:meta_value>5</wp:meta_value></wp:commentmeta></wp:comment></item>
<item><title>Parent</title><dc:creator>ann</dc:creator><wp:post_id>11</wp:post_id><wp:post_type>page</wp:post_type><wp:status>publish</wp:status><wp:post_date>d2</wp:post_date></item>
<item><title>Odd</title><wp:post_id>12</wp:post_id><wp:post_type>bogus</wp:post_type></item>
<item><title>Go</title><wp:post_id>13</wp:post_id><wp:post_type>nav_menu_item</wp:post_type><category domain="nav_menu" nicename="main">Main</category>
<wp:postmeta><wp:meta_key>_menu_item_type</wp:meta_key><wp:meta_value>post_type</wp:meta_value></wp:postmeta><wp:postmeta><wp:meta_key>_menu_item_object_id</wp:meta_key><wp:meta_value>10</wp:meta_value></wp:postmeta>
<wp:postmeta><wp:meta_key>_menu_item_classes</wp:meta_key><wp:meta_value>a:2:{i:0;s:1:"a";i:1;s:1:"b";}</wp:meta_value></wp:postmeta></item>
"""


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("import")
    path = export(folder, "a.xml", BODY)
    options = ImportOptions(site_url="https://new.example.com", rewrite_urls=True)
    first = import_exports(spark, path, SiteTables.empty(spark), options)
    first.site.write(f"file://{folder}/one")
    site = SiteTables.read(spark, f"file://{folder}/one")
    second = import_exports(spark, path, site, ImportOptions(dedupe_menu=True, dedupe_meta=True))
    second.site.write(f"file://{folder}/two")
    return site, SiteTables.read(spark, f"file://{folder}/two"), first.report().collect()


def test_everything_is_linked(imported):
    site, _, report = imported
    posts = {r["post_title"]: r for r in site.posts.collect()}
    assert set(posts) == {"Child", "Parent"}
    child = posts["Child"]
    assert (child["ID"], child["post_parent"], posts["Parent"]["ID"]) == (10, 11, 11)
    assert child["post_content"] == '<a href="https://new.example.com/x">x</a> \\ back'
    users = {r["user_login"]: r["user_id"] for r in site.users.collect()}
    assert set(users) == {"ann"} and child["post_author"] == users["ann"]
    terms = {(r["taxonomy"], r["slug"]): r for r in site.terms.collect()}
    assert set(terms) == {("category", "top"), ("category", "sub"), ("post_tag", "t1"), ("nav_menu", "main")}
    assert terms[("category", "sub")]["parent_id"] == terms[("category", "top")]["term_id"]
    assert {(r["post_id"], r["taxonomy"]) for r in site.post_terms.collect()} == {(10, "category"), (10, "post_tag")}
    comments = {r["author"]: r for r in site.comments.collect()}
    assert comments["eve"]["parent"] == str(comments["bob"]["comment_id"]) and comments["bob"]["user_id"] == users["ann"]
    assert [(r["comment_id"], r["key"]) for r in site.commentmeta.collect()] == [(comments["eve"]["comment_id"], "rate")]
    assert {(r["key"], r["value"]) for r in site.postmeta.collect()} == {("_edit_last", str(users["ann"])), ("_thumbnail_id", "11")}
    item = site.menu_items.first()
    assert (item["object_id"], item["classes"], item["menu_id"]) == (10, "a b", terms[("nav_menu", "main")]["term_id"])
    assert [r["post_id"] for r in site.sticky_posts.collect()] == [10]
    counts = {(r["entity"], r["outcome"]): r["n"] for r in report if r["export_id"] and r["entity"] and r["outcome"]}
    assert counts[("post", "created")] == 2 and counts[("post", "reject")] == 1 and counts[("menu item", "created")] == 1


def test_importing_again_changes_nothing(imported):
    one, two, _ = imported
    for name in ("users", "terms", "posts", "post_terms", "comments", "commentmeta", "menu_items", "postmeta", "sticky_posts"):
        assert sorted(map(repr, getattr(one, name).collect())) == sorted(map(repr, getattr(two, name).collect())), name


def test_stream_imports_each_file_once(spark, tmp_path):
    from sitemigrate.streaming import ingest

    (tmp_path / "in").mkdir()
    export(tmp_path / "in", "a.xml", BODY)
    run = lambda: ingest.import_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/site", f"file://{tmp_path}/cp", available_now=True).awaitTermination()
    run()
    export(tmp_path / "in", "b.xml", BODY.replace("Parent", "Other"))
    run()
    site = SiteLog(spark, f"file://{tmp_path}/site").read()
    assert sorted(r["post_title"] for r in site.posts.collect()) == ["Child", "Other", "Parent"]
    assert site.users.count() == 1 and site.comments.count() == 2


def test_entry_lists_queries_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50
