"""Imports with broken items, nulls, several exports, and the caller's own choices."""

import types

import pytest
from pyspark.sql import functions as F

from sitemigrate import storage
from sitemigrate.functions import markup
from sitemigrate.operators import attachments, ids, urls
from sitemigrate.plans.importing import ImportOptions, import_exports
from sitemigrate.sources import exports
from sitemigrate.sources.site import SiteTables
from test_exports import export

BODY = """
<item><title>Good</title><wp:post_id>1</wp:post_id><wp:post_type>post</wp:post_type><wp:status>publish</wp:status>
<content:encoded><![CDATA[<a href="/science/p">r</a> <!-- wp:acme {"src":"/science/i.png","other":"/science/j.png"} /-->]]></content:encoded>
<wp:postmeta><wp:meta_key>enclosure</wp:meta_key><wp:meta_value>https://old.example.org/science/f.mp3</wp:meta_value></wp:postmeta>
<wp:comment><wp:comment_id>4</wp:comment_id><wp:comment_content>no author</wp:comment_content></wp:comment></item>
<item><title>Bad &amp; broken<b></title><wp:post_id>2</wp:post_id><wp:post_type>post</wp:post_type><wp:status>publish</wp:status><wp:post_date>d</wp:post_date>
<content:encoded><![CDATA[A<BR>b]]></content:encoded><category domain="category" nicename="c1">C &lt;1&gt;</category>
<wp:postmeta><wp:meta_key>k</wp:meta_key><wp:meta_value><![CDATA[v]]></wp:meta_value></wp:postmeta>
<wp:comment><wp:comment_id>5</wp:comment_id><wp:comment_author>bob</wp:comment_author><wp:comment_date>c</wp:comment_date>
<wp:commentmeta><wp:meta_key>rate</wp:meta_key><wp:meta_value>5</wp:meta_value></wp:commentmeta></wp:comment></item>
"""


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("more")
    path = export(folder, "a.xml", BODY)
    (folder / "a.xml").write_text((folder / "a.xml").read_text().replace("https://old.example.org</wp:base", "https://old.example.org/science</wp:base"))
    id_ = exports.read_chunks(spark, path).first()["export_id"]
    options = ImportOptions(
        rewrite_urls=True, site_url="https://new.example.com", block_attributes={"wp:acme": ["src"]}, postmeta_key=F.when(F.col("key") == "k", "renamed").otherwise(F.col("key")),
        transform_content=lambda df: df.withColumn("post_title", F.upper("post_title")), transform_commentmeta=lambda df: df.withColumn("value", F.concat("value", F.lit("!"))),
        url_remaps=spark.createDataFrame([(id_, "https://old.example.org/science/f.mp3", "https://new.example.com/f.mp3")], "export_id string, from_url string, to_url string"),
    )
    first = import_exports(spark, path, SiteTables.empty(spark), options)
    first.site.write(f"file://{folder}/one")
    site = SiteTables.read(spark, f"file://{folder}/one")
    plain = ImportOptions(transform_posts=lambda df: df.withColumn("post_title", F.upper("post_title")), dedupe_meta=True)
    second = import_exports(spark, path, site, plain)
    return site, second.site, first.quarantine.collect()


def test_broken_items_are_imported_by_their_tags(imported):
    site, _, refused = imported
    posts = {r["ID"]: r for r in site.posts.collect()}
    assert len(refused) == 1 and posts[2]["post_content"] == "A<br />b" and posts[2]["post_title"] == "BAD & BROKEN<B>"
    assert [(r["slug"], r["name"]) for r in site.terms.collect()] == [("c1", "C <1>")]
    assert {(r["key"], r["value"]) for r in site.postmeta.collect()} == {("enclosure", "https://new.example.com/f.mp3"), ("renamed", "v")}
    assert {r["author"] for r in site.comments.collect()} == {None, "bob"} and [r["value"] for r in site.commentmeta.collect()] == ["5!"]


def test_relative_urls_and_named_block_attributes_move(imported):
    content = {r["ID"]: r["post_content"] for r in imported[0].posts.collect()}[1]
    assert content == '<a href="/p">r</a> <!-- wp:acme {"src":"/i.png","other":"/science/j.png"} /-->'


def test_nulls_in_keys_do_not_repeat_posts_or_comments(imported):
    one, two, _ = imported
    assert one.posts.count() == two.posts.count() == 2
    assert one.comments.count() == two.comments.count() == 2


def test_open_sections_are_carried_over_blocks(spark, tmp_path):
    """Items with ends of items in their texts, in a file that is read in many pieces."""
    texts = [f"start {'x' * (i % 900)} </item> mid {'y' * (i % 700)} </item> end {i}" if i % 3 else f"plain {i}" for i in range(400)]
    body = "".join(f"<item><wp:post_id>{i}</wp:post_id><content:encoded><![CDATA[{t}]]></content:encoded></item>" for i, t in enumerate(texts))
    path = export(tmp_path, "a.xml", body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        items, channel = exports.split_chunks(exports.read_chunks(spark, path))
        rows = exports.parse_items(items, exports.headers_of(channel)).orderBy("doc_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["post_id"], r["post_content"]) for r in rows] == list(enumerate(texts))


def test_names_are_unique_beside_the_sites_own(spark):
    names = ["a.png", "A.png", "a-1.png", "a.png", "b.gif", "c", "c", "a-1.png"]
    files = spark.createDataFrame([(i, "f", n) for i, n in enumerate(names)] + [(90, None, "a.png"), (91, None, "a.png")], "post_id long, folder string, file_name string")
    there = spark.createDataFrame([("f", "B.gif"), ("f", "a-3.png"), ("g", "c")], "folder string, file_name string")
    got = {r["post_id"]: r["unique_name"] for r in attachments.unique_names(files, "post_id", there).collect()}
    assert [got[i] for i in range(8)] == ["a.png", "A-2.png", "a-1.png", "a-4.png", "b-1.gif", "c", "c-1", "a-1-1.png"] and (got[90], got[91]) == ("a.png", "a-1.png")
    assert len({got[i].lower() for i in range(8)}) == 8


def test_a_hot_file_name_is_numbered_by_many_tasks(spark):
    n = 60_000
    taken = sorted({i * i % 50_021 + 1 for i in range(4_000)})
    files = spark.range(n).select((F.col("id") * 3).alias("post_id"), F.lit("f").alias("folder"), F.lit("a.png").alias("file_name"))
    others = spark.createDataFrame([(1, "f", "b.png"), (4, "f", "b.png"), (7, None, "a.png")], "post_id long, folder string, file_name string")
    there = spark.createDataFrame([("f", f"A-{u}.png") for u in taken], "folder string, file_name string")
    got = {r["post_id"]: r["unique_name"] for r in attachments.unique_names(files.unionByName(others), "post_id", there).collect()}
    busy, free, expect = set(taken), 0, ["a.png"]
    for _ in range(n - 1):
        free += 1
        while free in busy:
            free += 1
        expect.append(f"a-{free}.png")
    assert [got[i * 3] for i in range(n)] == expect and (got[1], got[4], got[7]) == ("b.png", "b-1.png", "a.png")


def test_running_sums_of_one_key_over_many_partitions(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, F.lit("hot")).alias("k"), ((F.col("id") * 7919) % 20_000).alias("o"), (F.col("id") % 3).alias("v"), F.lit(5).alias("x"))
    rows = ids.running_sum(spark, df, ["k"], ["o"], F.col("v"), "s").collect()
    assert len(rows) == 20_000 and list(rows[0].asDict()) == ["k", "o", "v", "x", "s"]
    total = {}
    for r in sorted(rows, key=lambda r: r["o"]):
        total[r["k"]] = total.get(r["k"], 0) + r["v"]
        assert r["s"] == total[r["k"]]
    assert ids.running_sum(spark, df.limit(0), ["k"], ["o"], F.col("v"), "s").collect() == []


def test_sketches_of_distinct_urls_merge(spark):
    url = F.concat(F.lit("https://h.example/"), (F.col("id") % 30_000).cast("string"))
    found = spark.range(90_000).select((F.col("id") % 7).alias("export_id"), F.when(F.col("id") % 2 == 0, "attr").otherwise("text").alias("kind"), F.when(F.col("id") < 80_000, url).alias("decoded"))
    kept = urls.distinct_sketches(found, ["export_id", "kind"])
    assert kept.count() == 14
    whole = urls.merge_sketches(kept, []).first()
    assert whole["n"] == 80_000 and abs(whole["n_distinct"] - 30_000) < 0.05 * 30_000
    exact = {r["kind"]: r["d"] for r in found.groupBy("kind").agg(F.count_distinct("decoded").alias("d")).collect()}
    assert all(abs(r["n_distinct"] - exact[r["kind"]]) < 0.05 * exact[r["kind"]] for r in urls.merge_sketches(kept, ["kind"]).collect())
    none = urls.merge_sketches(urls.distinct_sketches(found.limit(0), ["kind"]), []).first()
    assert (none["n"], none["n_distinct"]) == (0, 0)


def test_urls_in_texts():
    found = lambda text: [u for _, _, u, _ in markup.text_urls(text)]
    assert found("https://user:pw@old.org/x") == found("https://user@old.org/x") == found("https://a::b/x") == []
    assert found("at https://old.org—see “https://new.org/a”.") == ["https://old.org", "https://new.org/a"]
    assert found("https://🚀-science.com/x, https://old.org:80/y") == ["https://🚀-science.com/x", "https://old.org:80/y"]


def test_international_hosts_meet_in_one_form(spark):
    docs = spark.createDataFrame([(1, '<a href="https://🚀-science.com/a">x</a> https://XN---science-7f85g.com/b')], "id long, html string")
    mapping = spark.createDataFrame([(0, "https://xn---science-7f85g.com/", "https://new.example.com/")], "ord int, from_base string, to_base string")
    assert urls.rewrite_content(docs, mapping, "id", "html").first()["html"] == '<a href="https://new.example.com/a">x</a> https://new.example.com/b'


def test_no_local_folder_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="share"):
        storage.scratch_dir(types.SimpleNamespace(sparkContext=context, conf=conf))


def test_texts_are_shuffled_once(spark, tmp_path):
    """Routes, matches, ids and links are worked out without the texts, which are dealt once, to the posts that are made."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), "")
    rows = spark.range(1, 101).select(F.lit("all").alias("export"), F.col("id").alias("post_id"), F.concat(F.lit("t"), "id").alias("post_title"), F.lit("post").alias("post_type"), F.lit("publish").alias("status"), text.alias("post_content"))
    path = exports.write_exports(rows, f"{tmp_path}/x", "export", "post_id")
    before = shuffled()
    result = import_exports(spark, path, SiteTables.empty(spark))
    assert result.site.posts.agg(F.sum(F.length("post_content"))).first()[0] == 100 * 400 * 64
    assert shuffled() - before < 2 * 100 * 400 * 64


def test_texts_are_looked_through_once_for_urls(spark):
    """Pages are parsed once; what stays are URLs on hosts of the mapping, or on hosts that aren't plain."""
    rows = [(1, '<a href="https://a.org/x">y</a> https://b.org/z'), (2, '<a href="https://A.org/q">y</a>'), (3, None), (4, '<a href="https://%61.org/w">y</a> <a href="r">s</a>')]
    docs = spark.createDataFrame(rows, "id long, html string")
    mapping = spark.createDataFrame([(0, "https://a.org/", "https://n.com/")], "ord int, from_base string, to_base string")
    out = urls.rewrite_content(docs, mapping, "id", "html", "https://b.org/")
    assert not [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x and "decoded" in x]
    assert {r["id"]: (r["html"], r["n_rewritten"]) for r in out.collect()} == {
        1: ('<a href="https://n.com/x">y</a> https://b.org/z', 1), 2: ('<a href="https://n.com/q">y</a>', 1), 3: (None, 0), 4: ('<a href="https://n.com/w">y</a> <a href="r">s</a>', 1),
    }
