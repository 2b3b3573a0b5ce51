"""Items read by Spark's XML function against the parser of all forms."""

import random

import pytest
from pyspark.sql import functions as F

from sitemigrate import schema
from sitemigrate.functions import item_xml
from sitemigrate.sources import exports, standard_items

HEAD = exports.root_tag()
USUAL = [
    "<item>", "<item>\n", "<item><title></title><link/><guid isPermaLink='false'>g &amp; h</guid></item>", "<item><wp:post_id>1</wp:post_id><wp:post_id>+999</wp:post_id><wp:menu_order></wp:menu_order>",
    "<item><content:encoded>  a\n\r\n\\b &amp; <![CDATA[<x> </item> &amp; <wp:post_id>z</wp:post>]]>&#13;<![CDATA[one ]]]]><![CDATA[> two]]>\n </content:encoded><excerpt:encoded><![CDATA[ ]]></excerpt:encoded>",
    "<item>\n\t<category domain='tag' nicename='a-b'>A &amp; B</category>\n<category nicename=\"e\"></category><category>plain</category><category domain='x' nicename=''><![CDATA[ b ]]></category>",
    "<item>\n<wp:postmeta>\n\t<wp:meta_key>k</wp:meta_key>\n<wp:meta_value><![CDATA[ a:0:{}]]></wp:meta_value></wp:postmeta>\n<wp:postmeta><wp:meta_key>k</wp:meta_key></wp:postmeta>",
    "<item><wp:comment><wp:comment_id>3</wp:comment_id><wp:comment_author_IP>::1</wp:comment_author_IP><wp:comment_user_id><![CDATA[7]]></wp:comment_user_id>"
    "<wp:commentmeta><wp:meta_key>r</wp:meta_key><wp:meta_value>5</wp:meta_value></wp:commentmeta></wp:comment><wp:comment><wp:comment_content>é 🚀</wp:comment_content></wp:comment>",
    "<item><description>of no column</description><dc:creator>me</dc:creator><title>\u0085  </title><wp:post_id>-4</wp:post_id>", "<item><title>" + "&amp;" * 100_000 + "</title>", "<item><title>" + "y" * 2_000_000 + "</title>",
    "<item><title>a</title><title>b</title><wp:comment><wp:post_id>4</wp:post_id><wp:postmeta><wp:meta_key>x</wp:meta_key></wp:postmeta></wp:comment>",
]
OTHERS = [
    "<item><wp:post_id>x12</wp:post_id>", "<item><wp:post_id> 7 </wp:post_id>", "<item><wp:post_id>٣</wp:post_id>", "<item><wp:post_id>5e</wp:post_id><title>t</title>", "<item><title> \n</title>", "<item xmlns:wp='urn:other'><wp:post_id>7</wp:post_id>",
    "<item><title>a<b>c</b>d</title>", "<item><title>a<!-- c -->b</title>", "<item><?x y?><title>a</title>", "<item><title>&nbsp;</title>", "<item><title>&#233;&#x1F680;</title>", "<item><other:title>t</other:title>", "<item><wp:comment/><wp:postmeta></wp:postmeta>",
    "<item><wp:comment>\n</wp:comment>", "<item><category nicename='a>b'> </category>", "<item><category nicename='a' x:y='z'>n</category>", "<item><!DOCTYPE x><title>t</title>", "<item><title>a]]>b</title>", "<item><title>\x01</title>", "<item><title>￾</title>",
    "<item><a><wp:post_id>3</wp:post_id></a>", "<item><item><title>t</title></item>", "", "no item", "<item><title>t", "<item></item>more<item>",
]
BROKEN = ["<item><title>t</link>", "<item><wp:postmeta><wp:meta_key>a</wp:meta_key>", "<item><category nicename='a' nicename='b'>c</category>", "<item><title>t</title></title>"]
USUAL, OTHERS, BROKEN = ([x.removesuffix("</item>") for x in cases] for cases in (USUAL, OTHERS, BROKEN))
COLUMNS = [*schema.POST_STRINGS, *schema.POST_NUMBERS, "terms", "postmeta", "comments", "failed_casts", "error"]


def expected(xml, root):
    try:
        row = item_xml.parse_item(root or exports.root_tag(), xml)
    except (item_xml.ET.ParseError, ValueError):
        return None
    return {c: dict(row[c]) if c == "failed_casts" else row.get(c) for c in COLUMNS}


def plain(x):
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return [plain(y) for y in x] if isinstance(x, list) else x


def filled(row):
    """Comments of the parser with all their keys."""
    names = ["comment_id", *item_xml.COMMENT_TEXT.values(), "user_id", "commentmeta"]
    return row and row | {"comments": [{n: c.get(n) for n in names} for c in row["comments"]]}


def tables(spark, cases):
    roots = sorted({r or "" for _, r in cases})
    items = spark.createDataFrame([(f"f{roots.index(r or '')}", (0, i), x) for i, (x, r) in enumerate(cases)], "export_id string, doc_pos struct<block:bigint,row:bigint>, item_xml string")
    return items, spark.createDataFrame([(f"f{i}", r or None) for i, r in enumerate(roots)], "export_id string, root_tag string")


def check(spark, cases):
    rows = exports.parse_items(*tables(spark, cases), by="mixed").orderBy("doc_pos").collect()
    assert len(rows) == len(cases)
    for r, (xml, root) in zip(rows, cases):
        got = None if r["error"] is not None else {c: plain(r[c]) for c in COLUMNS}
        assert got == filled(expected(xml, root)), (xml[:300], root)


def test_all_forms_give_the_rows_of_the_parser(spark):
    check(spark, [(x, HEAD) for x in USUAL + OTHERS + BROKEN])


def test_which_items_are_read_in_the_jvm(spark):
    df = spark.createDataFrame([(x, i < len(USUAL)) for i, x in enumerate(USUAL + OTHERS)], "x string, usual boolean")
    got = standard_items.usual_item(F.col("x")) & standard_items.read(F.col("x"))[standard_items.BROKEN].isNull()
    assert [r["x"][:200] for r in df.filter(~got.eqNullSafe(F.col("usual"))).collect()] == []


@pytest.mark.parametrize("root", [
    None, HEAD.replace("xmlns:wp", "xmlns:own"), HEAD.replace(">", " xmlns='urn:x'>"), HEAD.replace("export/1.2", "export/1.0").replace("http://export", "https://other"), HEAD.replace("dc/elements", "dc/other"), HEAD.replace(">", " version='2'>"),
    HEAD.replace(">", " xmlns:foaf='http://xmlns.com/foaf'>"),
])
def test_root_tags_decide(spark, root):
    check(spark, [(x, root) for x in USUAL[:9]])


def test_random_items(spark):
    rng = random.Random(5)
    pieces = ["<title>", "</title>", "<wp:post_id>", "</wp:post_id>", "<wp:postmeta>", "</wp:postmeta>", "<wp:meta_key>", "</wp:meta_key>", "<wp:comment>", "</wp:comment>", "<category nicename='a'>", "</category>", "<link/>", "12", "x", " ", "\n", "&amp;", "<![CDATA[", "]]>", "&", "]", ">"]
    whole = ["<title>{}</title>", "<wp:post_id>{}</wp:post_id>", "<wp:postmeta>{}</wp:postmeta>", "<wp:meta_key>{}</wp:meta_key>", "<wp:comment>{}</wp:comment>", "<category nicename='a'>{}</category>", "<![CDATA[{}]]>", "<wp:comment_id>{}</wp:comment_id>"]

    def grow(depth):
        inner = "".join(grow(depth - 1) for _ in range(rng.randrange(3))) if depth else rng.choice(["", "1", " ", "a b", "&lt;", "\n"])
        return rng.choice(whole).format(inner) if rng.random() < 0.8 else inner

    cases = ["<item>" + "".join(grow(rng.randrange(4)) for _ in range(rng.randrange(5))) for _ in range(1500)]
    cases += ["<item>" + "".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(1500)]
    check(spark, [(x, HEAD) for x in cases])


def test_no_python_worker_for_usual_files(spark):
    items, headers = tables(spark, [(x, HEAD) for x in USUAL + OTHERS[:3]])
    rows = exports.parse_items(items, headers, by="jvm")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    got = rows.orderBy("doc_pos").collect()
    assert [r["error"] is None for r in got] == [True] * len(USUAL) + [False] * 3
    assert [{c: plain(r[c]) for c in COLUMNS} for r in got[: len(USUAL)]] == [filled(expected(x, HEAD)) for x in USUAL]
