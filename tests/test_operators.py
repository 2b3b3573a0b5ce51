import pytest
from pyspark.sql import functions as F

from sitemigrate.functions import markup
from sitemigrate.functions import url_columns as U
from sitemigrate.functions.php_values import to_json
from sitemigrate.operators import attachments, authors, blocks, comments, ids, meta, posts, terms, text, urls


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_ids_are_kept_where_free(spark):
    new = spark.createDataFrame([(1, 5), (2, 5), (3, 0), (4, 7), (5, None)], "k int, old long")
    site = spark.createDataFrame([(7,), (9,)], "id long")
    assert rows(ids.allocate_ids(spark, new, site, "old", "id", ["k"]), "k", "new_id") == [(1, 5), (2, 10), (3, 11), (4, 12), (5, 13)]


def test_ids_of_an_empty_table(spark):
    new = spark.createDataFrame([], "k int, old long")
    assert ids.allocate_ids(spark, new, spark.createDataFrame([], "id long"), "old", "id", ["k"]).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_dense_ranks_do_not_depend_on_partitions(spark, n):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97))).repartition(n)
    got = ids.dense_rank_rows(spark, df, ["v", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)


def test_routing_order(spark):
    df = spark.createDataFrame(
        [("x", 1, 3, "bogus", "publish"), ("x", 2, 3, "post", "auto-draft"), ("x", 3, 3, "post", "publish"), ("x", 4, 3, "post", "publish"), ("x", 5, 0, "post", "publish"), ("x", 6, 0, "nav_menu_item", "publish"), ("x", 7, 8, "page", "draft")],
        "export_id string, doc_pos int, post_id long, post_type string, status string",
    )
    types = spark.createDataFrame([("post",), ("page",), ("nav_menu_item",)], "post_type string")
    seen = spark.createDataFrame([("x", 8)], "export_id string, post_id long")
    assert rows(posts.route_posts(df, types, seen), "doc_pos", "route", "reason") == [
        (1, "reject", "invalid post type"), (2, "skip", "auto-draft"), (3, "post", None), (4, "skip", "already handled"), (5, "post", None), (6, "menu", None), (7, "skip", "already handled"),
    ]


def test_parents_in_both_directions(spark):
    df = spark.createDataFrame([("x", 1, 2), ("x", 2, 0), ("x", 3, 9)], "export_id string, post_id long, post_parent long")
    known = spark.createDataFrame([("x", 1, 11), ("x", 2, 12), ("x", 0, 99)], "export_id string, old_id long, new_id long")
    assert rows(posts.remap_parents(df, known), "post_id", "new_parent") == [(1, 12), (2, 0), (3, 0)]


def test_attachment_fields(spark):
    df = spark.createDataFrame(
        [([("_wp_attached_file", "2020/07/a.png"), ("_wp_attached_file", "2021/01/b.png")], "2019-01-02 00:00:00", "/f.png", "g"), ([], "0000-00-00 00:00:00", None, "http://g"), ([("_wp_attached_file", "a.png")], "2019-02-03 04:05:06", "", "http://g")],
        "m array<struct<key:string,value:string>>, d string, a string, g string",
    )
    got = df.select(posts.upload_folder("m", "d").alias("f"), posts.attachment_source("a", "g", F.lit("https://b/")).alias("u"))
    assert [(r["f"], r["u"]) for r in got.collect()] == [("2020/07", "https://b/f.png"), (None, "http://g"), ("2019/02", "http://g")]


def test_term_parents_only_see_earlier_rows(spark):
    df = spark.createDataFrame([("t", "a", "b", 1, 1, True), ("t", "b", None, 2, 2, True), ("t", "c", "b", 3, 3, True), ("t", "d", "old", 4, 4, True), ("t", "e", "b", 5, 5, False)], "taxonomy string, slug string, parent_slug string, term_id long, place int, is_new boolean")
    site = spark.createDataFrame([("t", "old", 77)], "taxonomy string, slug string, term_id long")
    assert rows(terms.resolve_parents(df, site, "place"), "slug", "parent_id") == [("a", 0), ("b", 0), ("c", 2), ("d", 77), ("e", None)]
    assert ("a", 2) in rows(terms.resolve_parents(df, site, "place", resolve_any=True), "slug", "parent_id")


def test_ancestors_survive_cycles(spark):
    df = spark.createDataFrame([("t", 1, 2), ("t", 2, 3), ("t", 3, 1), ("t", 4, 3), ("t", 5, 0)], "taxonomy string, term_id long, parent_id long")
    got = {(r["term_id"], r["ancestor_id"]) for r in terms.ancestors(spark, df).collect()}
    assert {(1, 2), (1, 3), (4, 3), (4, 1), (4, 2)} <= got and all(a != b for a, b in got)


def test_comment_parents_and_duplicates(spark):
    df = spark.createDataFrame([("x", 1, 5, "9", "a", "d1"), ("x", 1, 9, "5", "b", "d2"), ("x", 1, 10, "77", "c", "d3"), ("x", 1, 11, None, "c", "d3")], "export_id string, post_doc_pos int, comment_id long, parent string, author string, date string")
    done = spark.createDataFrame([("x", 1, 5, 50), ("x", 1, 9, 90)], "export_id string, post_doc_pos int, comment_id long, new_id long")
    assert rows(comments.remap_parents(df, done), "comment_id", "new_parent") == [(10, "77"), (11, None), (5, "9"), (9, "50")]
    known = spark.createDataFrame([("a", "d1"), ("c", "d3")], "author string, date string")
    marked = df.withColumn("post_exists", F.col("comment_id") != 10)
    assert rows(comments.drop_known(marked, known), "comment_id") == [(10,), (9,)]


def test_logins(spark):
    df = spark.createDataFrame([("<b>Ann</b>  Lee&amp;é%20!",), (" x ",)], "l string")
    assert [r[0] for r in df.select(authors.sanitize_login("l")).collect()] == ["Ann Lee", "x"]


@pytest.mark.parametrize(
    "value, json",
    [
        ('a:2:{i:0;s:1:"a";i:1;i:5;}', '["a",5]'), ('a:1:{s:1:"k";d:1.5;}', '{"k":1.5}'), ('O:3:"Foo":1:{s:3:"bar";N;}', '{"bar":null}'), ('s:2:"é";', '"é"'), ("b:1;", "true"), ("plain", None), ('s:5:"ab";', None),
        ('a:1:{i:0;O:8:"Bad\\Name":1:{s:1:"x";s:11:"a";s:1:"b;{";}}', '[{"x":"a\\";s:1:\\"b;{"}]'), ("a:0:{}", "[]"), ("i:1;x", None), (None, None),
    ],
)
def test_serialised_values(value, json):
    assert to_json(value) == json


def test_meta_keys_and_references(spark):
    df = spark.createDataFrame([("x", 1, "_edit_lock", "1"), ("x", 1, "", "1"), ("x", 1, None, "1"), ("x", 1, "_edit_last", "3"), ("x", 1, "_edit_last", "4"), ("x", 1, "_thumbnail_id", "8"), ("x", 1, "_thumbnail_id", "9"), ("x", 1, "k", None)], "export_id string, post_id long, key string, value string")
    users = spark.createDataFrame([("x", 3, 30)], "export_id string, author_id long, user_id long")
    known = spark.createDataFrame([("x", 8, 80)], "export_id string, old_id long, new_id long")
    assert rows(meta.remap_references(meta.filter_keys(df), users, known), "key", "value") == [("_edit_last", "30"), ("_thumbnail_id", "80"), ("_thumbnail_id", "9"), ("k", None)]


CHILD = [
    ("https://a.org/science/x", "https://a.org/science/", True), ("https://a.org/science", "https://a.org/science/", True), ("https://a.org/sciences", "https://a.org/science/", False), ("http://a.org/science/x", "https://a.org/science/", False),
    ("https://a.org:8080/science/x", "https://a.org/science", True), ("https://b.org/science", "https://a.org/science", False), ("https://a.org/%73cience/x", "https://a.org/science", True), ("https://A.org/", "https://a.org", True), ("mailto:x", "https://a.org", False),
]


def test_child_urls(spark):
    df = spark.createDataFrame(CHILD, "u string, b string, want boolean")
    assert [r[0] for r in df.select(U.is_child_url(F.col("u"), F.col("b"))).collect()] == [c[2] for c in CHILD]


def test_rebased_urls(spark):
    cases = [
        ("https://a.org/science/p%20q?x=1#f", "https://a.org/science/", "https://n.org:81/new/", "https://n.org:81/new/p%20q?x=1#f"), ("https://a.org/%73%63ience/%61", "https://a.org/science", "https://n.org/", "https://n.org/%61"),
        ("https://a.org/science", "https://a.org/science/", "https://n.org/new/", "https://n.org/new"), ("https://a.org", "https://a.org/", "https://n.org/", "https://n.org"), ("https://a.org/x/", "https://a.org/", "https://n.org/y", "https://n.org/y/x/"), ("https://z.org", "https://a.org", "https://n.org", None),
    ]
    df = spark.createDataFrame(cases, "u string, b string, t string, want string")
    assert [r[0] for r in df.select(U.rebase_url(F.col("u"), F.col("b"), F.col("t"))).collect()] == [c[3] for c in cases]


def test_occurrences_have_exact_places():
    html = """<p title="https://no.org">é <a href="https://a.org/?x=1&amp;y=2">see https://b.org/path). now</a> <img src='/i.png'><!-- wp:image {"url":"/u.png","alt":"/x","more":"https:\\/\\/c.org"} /--> c.org/x no.qq user@d.org <script>"https://e.org"</script>"""
    found = list(markup.occurrences(html))
    assert [(k, u) for k, _, _, _, u, _ in found] == [("attr", "https://a.org/?x=1&y=2"), ("text", "https://b.org/path"), ("attr", "/i.png"), ("block", "/u.png"), ("block", "https://c.org"), ("text", "c.org/x"), ("text", "no.qq")]
    assert all(html[a:b] == raw for _, a, b, raw, _, _ in found)
    assert [t for *_, t in found if t] == ["org", "qq"]


def test_css_urls():
    css = "a: url('x.png'); /* url(no) */ content: 'url(no)'; b: URL( y\\29 .png ) ; c: url(data:image/png;base64,AA); d: url(\"z.png\")"
    assert [u for _, _, u in markup.css_urls(css)] == ["x.png", "y).png", "z.png"]


def test_rewriting_keeps_everything_else(spark):
    html = "<a href='https://old.org/s/a?b=1&amp;c=2'>&#104;ttps://old.org/s/q</a> <div style=\"x: url(https://old.org/s/i.png)\"></div> https://old.org.evil/s/ <img src='/s/k.png'> old.org/s/z <!-- wp:x {\"u\":\"https://old.org/s/<\"} -->"
    df = spark.createDataFrame([(1, html, 5), (2, None, 6), (3, "no links \\ é\n", 7)], "id int, html string, n_rewritten int")
    mapping = spark.createDataFrame([(0, "https://old.org/s/", "https://new.com/")], "ord int, from_base string, to_base string")
    tlds = spark.createDataFrame([("org",)], "tld string")
    got = {r["id"]: r["html"] for r in urls.rewrite_content(df.drop("n_rewritten"), mapping, "id", "html", "https://old.org/s/", tlds).collect()}
    assert got[2] is None and got[3] == "no links \\ é\n"
    assert got[1] == "<a href='https://new.com/a?b=1&amp;c=2'>https://new.com/q</a> <div style=\"x: url(&quot;https://new.com/i.png&quot;)\"></div> https://old.org.evil/s/ <img src='/k.png'> new.com/z <!-- wp:x {\"u\":\"https://new.com/\\u003C\"} -->"


def test_first_mapping_wins_or_the_longest(spark):
    df = spark.createDataFrame([(1, "https://a.org/x/y")], "id int, decoded string")
    mapping = spark.createDataFrame([(0, "https://a.org/", "https://one"), (1, "https://a.org/x", "https://two")], "ord int, from_base string, to_base string")
    assert urls.match_mappings(df, mapping).first()["to_base"] == "https://one"
    assert urls.match_mappings(df, mapping, longest=True).first()["to_base"] == "https://two"


def test_hosts_have_one_form(spark):
    df = spark.createDataFrame([("🚀-Science.com",), ("xn---science-7f85g.com",), ("%F0%9F%9A%80-science.com",), (None,)], "h string")
    assert rows(urls.canonical_hosts(df, "h"), "canonical_host") == [("xn---science-7f85g.com",)] * 3 + [(None,)]


def test_remaps_are_applied_longest_first(spark):
    docs = spark.createDataFrame([("x", "a ab abc"), ("y", "a")], "export_id string, t string")
    maps = spark.createDataFrame([("x", 1, "a", "z"), ("x", 2, "ab", "a1"), ("x", 3, "a", "y")], "export_id string, ord int, from_url string, to_url string")
    assert rows(urls.apply_url_remap(docs, urls.last_remap(maps), "t"), "t") == [("a",), ("y y1 y1c",)]


def test_blocks(spark):
    body = '<!-- wp:group {"a":{"b":[1,"x"]}} -->in<!-- wp:image /-->ner<!-- /wp:group --><!--wp:my-ns/thing {"a":1} /--><!-- /wp:group {"no":1} --><!-- wp:columns --><!-- /wp:group -->after<!-- wp:late -->'
    df = spark.createDataFrame([(1, body), (2, None), (3, "none")], "id int, html string")
    found = blocks.delimiters(df, "id", "html")
    assert all(body[r["start"] : r["stop"]].startswith("<!--") and body[r["start"] : r["stop"]].endswith("-->") for r in found.collect())
    nested = blocks.nesting(found, "id")
    assert [(r["block"], r["depth"], r["error"] is not None) for r in nested.orderBy("ord").collect()] == [("wp:group", 1, False), ("wp:image", 2, False), ("wp:group", 1, False), ("wp:columns", 1, False), ("wp:group", 1, True)]
    assert [r["inner"] for r in blocks.inner_html(df, nested, "id", "html").collect()] == ["in<!-- wp:image /-->ner"]
    paths = blocks.attribute_paths(found.filter("NOT is_closer"), "id")
    assert [(r["path"], r["value"]) for r in paths.orderBy("ord", "depth", "path").collect()] == [("a", '{"b":[1,"x"]}'), ("a.b", '[1,"x"]'), ("a.b.0", "1"), ("a.b.1", "x")]


def test_text_repairs(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok\xc3\xa9")), (2, bytearray(b"a\xc3b\xf0\x9f\x9ac\xff")), (3, None)], "id int, b binary")
    got = {r["id"]: (r["text"], r["changed"]) for r in text.scrub_text(df, "b").collect()}
    assert got == {1: ("oké", False), 2: ("a�b�c�", True), 3: (None, None)}
    wrong = spark.createDataFrame([("Ã©tÃ©",), ("été",), ("plain",), (None,)], "t string")
    assert [r["repaired"] for r in text.repair_encoding(wrong, "t").collect()] == ["été", "été", "plain", None]


def test_file_names(spark):
    df = spark.createDataFrame(
        [(1, "f", "https://a.org/x/photo.JPG?s=1", None, "image/jpeg"), (2, "f", "https://a.org/x/photo.JPG", None, None), (3, "f", "https://a.org/", 'attachment; filename="n"', "image/png"), (4, "f", "https://a.org/e.exe", "inline", "x/y")],
        "post_id int, folder string, url string, content_disposition string, content_type string",
    )
    mime = spark.createDataFrame([("image/jpeg", "jpg|jpeg"), ("image/png", "png")], "mime_type string, extensions string")
    got = attachments.unique_names(attachments.name_files(df, mime))
    assert rows(got, "post_id", "unique_name", "allowed") == [(1, "photo.JPG", True), (2, "photo-1.JPG", True), (3, "n.png", True), (4, "e.exe", False)]
