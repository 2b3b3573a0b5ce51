import re

import pytest
from pyspark.sql import functions as F

from sitemigrate.sources import exports
from sitemigrate.streaming import ingest

EXPORT = "export.example.org/export"
HEAD = f'<?xml version="1.0"?>\n{exports.root_tag()}\n<channel><title>T</title>'


def export(tmp_path, name, body, version="1.2", head=HEAD):
    tag = "" if version is None else f"<wp:wxr_version>{version}</wp:wxr_version>"
    path = tmp_path / name
    path.write_bytes(f"{head}{tag}<wp:base_site_url>https://old.example.org</wp:base_site_url>{body}</channel></rss>".encode())
    return str(path)


def parsed(spark, paths):
    items, channel = exports.split_chunks(exports.read_chunks(spark, paths))
    headers = exports.headers_of(channel)
    return exports.parse_items(items, headers), exports.parse_channel(channel, headers), exports.validate_exports(headers)


def item(**fields):
    tags = {"content": "content:encoded", "title": "title", "creator": "dc:creator"}
    return "<item>" + "".join(f"<{tags.get(k, 'wp:' + k)}>{v}</{tags.get(k, 'wp:' + k)}>" for k, v in fields.items()) + "</item>"


def test_text_is_kept_byte_for_byte(spark, tmp_path):
    text = "  a\n\n\\b \\\\ é 🚀 &amp; <![CDATA[<x>]]>]]&gt; <![CDATA[one ]]]]><![CDATA[> two]]>\n "
    rows, _, _ = parsed(spark, export(tmp_path, "a.xml", item(post_id=1, content=text)))
    assert rows.first()["post_content"] == "  a\n\n\\b \\\\ é 🚀 & <x>]]> one ]]> two\n "


def test_end_tag_inside_cdata_does_not_split_an_item(spark, tmp_path):
    body = item(post_id=1, content="<![CDATA[say </item> and </item> twice]]>") + item(post_id=2, content="next")
    rows, _, _ = parsed(spark, export(tmp_path, "a.xml", body))
    assert [(r["post_id"], r["post_content"]) for r in rows.orderBy("doc_pos").collect()] == [(1, "say </item> and </item> twice"), (2, "next")]


def test_many_splits_find_every_item_in_order(spark, tmp_path):
    body = "".join(item(post_id=i, content="x" * (i % 50)) for i in range(1, 2001))
    path = export(tmp_path, "big.xml", body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows, _, _ = parsed(spark, path)
        assert rows.rdd.getNumPartitions() > 4
        assert [r["post_id"] for r in rows.orderBy("doc_pos").select("post_id").collect()] == list(range(1, 2001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_namespaces_decide_and_the_last_element_wins(spark, tmp_path):
    body = (
        '<item><wp:post_id>1</wp:post_id><wp:post_id>999</wp:post_id><title>t</title><other:title xmlns:other="urn:x">no</other:title></item>'
        f'<item><post_id xmlns="http://{EXPORT}/1.0/">5</post_id><x:post_type xmlns:x="https://{EXPORT}/1.1/">page</x:post_type></item>'
        '<item xmlns:wp="urn:other"><wp:post_id>7</wp:post_id></item>'
    )
    rows, _, _ = parsed(spark, export(tmp_path, "a.xml", body))
    assert [(r["post_id"], r["post_type"], r["post_title"]) for r in rows.orderBy("doc_pos").collect()] == [(999, None, "t"), (5, "page", None), (0, None, None)]


def test_terms_comments_and_meta(spark, tmp_path):
    body = (
        "<item><wp:post_id>x12</wp:post_id><category domain='tag' nicename='a-b'>A &amp; B</category><category>plain</category>"
        "<wp:postmeta><wp:meta_key>k</wp:meta_key><wp:meta_value><![CDATA[a:0:{}]]></wp:meta_value></wp:postmeta>"
        "<wp:comment><wp:comment_id>3</wp:comment_id><wp:comment_author>me</wp:comment_author><wp:commentmeta><wp:meta_key>r</wp:meta_key><wp:meta_value>5</wp:meta_value></wp:commentmeta></wp:comment></item>"
    )
    flat = exports.flatten_entities(parsed(spark, export(tmp_path, "a.xml", body))[0])
    assert flat["posts"].first()["post_id"] == 0 and flat["posts"].first()["failed_casts"] == {"post_id": "x12"}
    assert [(r["domain"], r["slug"], r["name"]) for r in flat["post_terms"].collect()] == [("tag", "a-b", "A & B")]
    assert [(r["key"], r["value"]) for r in flat["postmeta"].collect()] == [("k", "a:0:{}")]
    assert [(r["comment_id"], r["author"]) for r in flat["comments"].collect()] == [(3, "me")]
    assert [(r["comment_id"], r["key"], r["value"]) for r in flat["commentmeta"].collect()] == [(3, "r", "5")]


def test_channel_before_and_after_items(spark, tmp_path):
    author = "<wp:author><wp:author_id>2</wp:author_id><wp:author_login>ann</wp:author_login></wp:author>"
    terms = "<wp:category><wp:term_id>4</wp:term_id><wp:category_nicename>c</wp:category_nicename><wp:category_parent>p</wp:category_parent><wp:cat_name>C</wp:cat_name></wp:category>"
    tail = "<wp:term><wp:term_id>9</wp:term_id><wp:term_taxonomy>genre</wp:term_taxonomy><wp:term_slug>g</wp:term_slug><wp:termmeta><wp:meta_key>m</wp:meta_key><wp:meta_value>1</wp:meta_value></wp:termmeta></wp:term>"
    _, channel, headers = parsed(spark, export(tmp_path, "a.xml", author + terms + item(post_id=1) + tail))
    assert [(r["author_id"], r["author_login"]) for r in exports.authors_of(channel).collect()] == [(2, "ann")]
    rows, meta = exports.terms_of(channel)
    assert sorted((r["phase"], r["taxonomy"], r["slug"], r["parent_slug"]) for r in rows.collect()) == [(0, "category", "c", "p"), (2, "genre", "g", None)]
    assert [(r["taxonomy"], r["key"], r["value"]) for r in meta.collect()] == [("genre", "m", "1")]
    assert headers.first()["base_blog_url"] == "https://old.example.org"


@pytest.mark.parametrize("version, status", [("1.2", "ok"), ("1.10", "warning"), ("2.0", "warning"), ("x", "error"), (None, "error")])
def test_versions(spark, tmp_path, version, status):
    assert parsed(spark, export(tmp_path, "a.xml", item(post_id=1), version))[2].first()["status"] == status


def test_missing_files_are_reported(spark, tmp_path):
    rows = exports.read_exports(spark, [export(tmp_path, "a.xml", item(post_id=1)), f"file://{tmp_path}/none.xml"]).collect()
    assert sorted(r["status"] for r in rows) == ["error", "ok"]


def test_broken_items_are_kept_aside_and_read_by_tags(spark, tmp_path):
    body = item(post_id=1, content="fine") + "<item><title>bad</title><wp:post_id>2</wp:post_id><content:encoded><![CDATA[a<br>b ]]]]><![CDATA[>]]></content:encoded><p></item>"
    rows, _, _ = parsed(spark, export(tmp_path, "a.xml", body))
    aside = exports.quarantine(rows)
    assert aside.count() == 1
    saved = exports.salvage(aside).first()
    assert (saved["post_id"], saved["post_title"], saved["post_content"]) == (2, "bad", "a<br />b ]]>")


def test_document_types_are_refused(spark, tmp_path):
    rows, _, _ = parsed(spark, export(tmp_path, "a.xml", "<item><!DOCTYPE x><wp:post_id>1</wp:post_id></item>"))
    assert "refused" in rows.first()["error"]


def test_written_exports_read_back(spark, tmp_path):
    posts = spark.createDataFrame([(f"e{i % 3}", i, f"<t & {i}>", f"line\r\n{i} ]]> é") for i in range(30)], "export string, post_id long, post_title string, post_content string")
    path = exports.write_exports(posts, f"file://{tmp_path}/out", "export", "post_id")
    rows, _, headers = parsed(spark, path)
    assert headers.count() == 3
    assert sorted((r["post_id"], r["post_title"], r["post_content"]) for r in rows.collect()) == sorted((r["post_id"], r["post_title"], r["post_content"]) for r in posts.collect())
    in_order = rows.groupBy("export_id").agg(F.sort_array(F.collect_list(F.struct("doc_pos", "post_id"))).alias("x")).collect()
    assert all([y["post_id"] for y in r["x"]] == sorted(y["post_id"] for y in r["x"]) for r in in_order)


def test_one_export_from_many_tasks(spark, tmp_path):
    """Parts of one export, in order, read back as one; and joined into one file, as well."""
    posts = spark.range(20_000).select(F.lit("big").alias("export"), F.col("id").alias("post_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("post_title")).repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        exports.write_exports(posts, f"file://{tmp_path}/out", "export", "post_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    parts = sorted((tmp_path / "out" / "export=big").glob("part-*"))
    assert len(parts) > 20
    (tmp_path / "one.xml").write_bytes(b"".join(p.read_bytes() for p in parts))
    for path in (f"file://{tmp_path}/out", f"file://{tmp_path}/one.xml"):
        rows, _, headers = parsed(spark, path)
        assert [(r["version"], r["blogname"]) for r in headers.collect()] == [("1.2", "big")] and rows.filter("error IS NOT NULL").count() == 0
        assert [r["post_id"] for r in rows.orderBy("doc_pos").select("post_id").collect()] == list(range(20_000))
    one, last = f"file:{parts[0]}", f"file:{parts[-1]}"
    assert ingest.whole_exports(spark, [one, "file:/x/a.xml"]) == ["file:/x/a.xml"]
    assert ingest.whole_exports(spark, [last, "file:/x/a.xml"]) == ["file:/x/a.xml", f"file:{parts[0].parent}"]


def test_no_text_is_dealt_by_its_export(spark, tmp_path):
    """One export may hold nearly all items: joins by export alone must not bring them together in one task."""
    rows = spark.range(40).select(F.lit("all").alias("export"), F.col("id").alias("post_id"), F.lit("text").alias("post_content"))
    path = exports.write_exports(rows, f"{tmp_path}/x", "export", "post_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items, channel = exports.split_chunks(exports.read_chunks(spark, path))
        for by in ("python", "jvm", "mixed"):
            parsed = exports.parse_items(items, exports.headers_of(channel), by=by)
            plan = parsed._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"(?:SortMergeJoin|ShuffledHashJoin) \[export_id#\d+\],", plan)
            assert parsed.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_broken_items_are_read_by_the_worker_that_refused_them(spark, tmp_path):
    path = export(tmp_path, "x.xml", item(title="a") + item(title="b").replace("</item>", "<b></item>"))
    items, channel = exports.split_chunks(exports.read_chunks(spark, path))
    headers = exports.headers_of(channel)
    both = exports.parse_items(items, headers, salvage=True)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    apart = exports.parse_items(items, headers)
    names = ["post_title", "post_id", "terms", "postmeta", "comments"]
    assert both.filter("error IS NULL").select(names).collect() == apart.filter("error IS NULL").select(names).collect()
    assert both.filter("error IS NOT NULL").select(names).collect() == exports.read_leniently(exports.quarantine(apart)).select(names).collect() != []
