import random

from pyspark.sql import functions as F

from sitemigrate.functions import table_functions
from sitemigrate.functions import url_columns as U
from sitemigrate.operators import comments, text
from sitemigrate.sources import exports


def test_table_functions_beside_a_table(spark):
    table_functions.register(spark)
    rows = [(1, '<a href="https://a.org/x">y</a> https://b.org/z'), (2, None), (3, "")]
    spark.createDataFrame(rows, "id long, html string").createOrReplaceTempView("some_pages")
    found = spark.sql("SELECT id, u.ord, u.kind, u.decoded FROM some_pages, LATERAL url_occurrences(html) u ORDER BY id, ord").collect()
    assert [tuple(r) for r in found] == [(1, 0, "attr", "https://a.org/x"), (1, 1, "text", "https://b.org/z")]
    item = '<item><title>t</title><wp:post_id>5</wp:post_id><category domain="category" nicename="c">C</category>'
    spark.createDataFrame([(item, exports.root_tag()), ("<item><b>", exports.root_tag()), (None, None)], "x string, r string").createOrReplaceTempView("some_items")
    parsed = spark.sql("SELECT i.post_id, i.post_title, i.terms, i.error FROM some_items, LATERAL export_item(x, r) i").collect()
    assert [(r["post_id"], r["post_title"], r["error"] is None) for r in parsed] == [(5, "t", True), (None, None, False), (None, None, False)]
    assert parsed[0]["terms"][0].asDict() == {"name": "C", "slug": "c", "domain": "category"}


def test_relative_urls_are_resolved(spark):
    base = "https://h.org:8/a/b/"
    cases = {
        "x": "https://h.org:8/a/b/x", "./x/": "https://h.org:8/a/b/x/", "../x?q#f": "https://h.org:8/a/x?q#f", "../../../x": "https://h.org:8/x", "/r/./s/..": "https://h.org:8/r/", "?q": "https://h.org:8/a/b/?q",
        "..": "https://h.org:8/a/", ".": "https://h.org:8/a/b/", "/.hidden/..x": "https://h.org:8/.hidden/..x", "": None, "#top": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["v"] for r in df.select("u", U.resolve(F.col("u"), F.lit(base)).alias("v")).collect()} == cases
    assert df.limit(1).select(U.resolve(F.lit("x"), F.lit("https://h.org")).alias("v")).first()["v"] == "https://h.org/x"


def test_invalid_bytes_are_counted(spark):
    rng = random.Random(4)
    rows = [bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["né 🎉".encode() * 5000 + b"\xff\xfe", None]

    def wrong(data):
        n, at = 0, 0
        while at < len(data):
            good = next((k for k in (1, 2, 3, 4) if _is_char(data[at : at + k])), 0)
            n, at = n + (not good), at + (good or 1)
        return n

    def _is_char(part):
        try:
            return len(part.decode()) == 1
        except UnicodeDecodeError:
            return False

    df = spark.createDataFrame([(i, d) for i, d in enumerate(rows)], "id long, d binary")
    got = {r["id"]: r["invalid_bytes"] for r in text.utf8_report(df, "d", "id").collect()}
    assert got == {i: wrong(d or b"") for i, d in enumerate(rows)}


def test_quantiles_of_both_lengths(spark):
    df = spark.range(1, 1001).select(F.lit("a").alias("by"), F.repeat(F.lit("é"), F.col("id").cast("int")).alias("t"))
    r = text.length_profile(df, "t", "by").first()
    assert r["code_point_quantiles"] == [250, 500, 750, 990] and r["byte_quantiles"] == [500, 1000, 1500, 1980] and r["median_code_points"] == 500


def test_comments_met_again_in_one_batch(spark):
    rows = [(1, False, "a", "d1"), (2, False, "a", "d1"), (3, True, "a", "d1"), (4, True, "b", "d1"), (5, True, "b", "d1"), (6, True, None, None), (7, True, "", None), (8, True, "s", "d")]
    df = spark.createDataFrame(rows, "o long, post_exists boolean, author string, date string")
    site = spark.createDataFrame([("s", "d")], "author string, date string")
    assert sorted(r["o"] for r in comments.drop_known(df, site, ["o"]).collect()) == [1, 2, 4, 6]
    assert sorted(r["o"] for r in comments.drop_known(df, site).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_quantiles_of_lengths_are_exact_in_groups_of_any_size(spark):
    rows = spark.range(30_000).select(F.expr("repeat('é', 1 + cast((id * 7919) % 30000 as int))").alias("t"), F.when(F.col("id") % 2 == 0, "a").alias("by"))
    found = {r["by"]: r for r in text.length_profile(rows.unionByName(spark.createDataFrame([(None, "none")], "t string, by string")), "t", "by", (0.001, 0.25, 0.55, 0.99)).collect()}
    for by, rest in (("a", 0), (None, 1)):
        lengths = sorted(1 + (i * 7919) % 30_000 for i in range(rest, 30_000, 2))
        want = [lengths[r - 1] for r in (15, 3750, 8250, 14_850)]
        assert found[by]["code_point_quantiles"] == want
        assert found[by]["byte_quantiles"] == [2 * n for n in want]
        assert found[by]["median_code_points"] == lengths[7499]
    assert found["none"]["n_rows"] == 0 and found["none"]["median_code_points"] is None and found["none"]["code_point_quantiles"] is None
