import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sitemigrate.sources import exports
from sitemigrate.sources.site_log import TableLog
from sitemigrate.streaming import ingest


def shuffled(spark):
    """Bytes that the session has written to shuffles."""
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def collected(spark, tmp_path, keep_for="7 days"):
    ingest.collect_items(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", keep_for, available_now=True).awaitTermination()
    return TableLog(spark, f"file://{tmp_path}/out", ingest.ITEMS).tables()["items"]


@pytest.mark.parametrize("bitmaps", [ingest.BITMAPS, 0])
def test_items_that_repeat_against_brute_force(spark, tmp_path, monkeypatch, bitmaps):
    """Repeats in one file, in other files and in an earlier batch, some of them old, some over an end of an item."""
    monkeypatch.setattr(ingest, "BITMAPS", bitmaps)
    draw, expected, seen, confs = random.Random(5), [], {}, ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {c: spark.conf.get(c) for c in confs}
    (tmp_path / "in").mkdir()
    for c in confs:
        spark.conf.set(c, "3k")
    try:
        for batch, hour in enumerate((0, 3)):
            firsts = {}
            for n in range(6):
                path, modified = tmp_path / "in" / f"{batch}-{n}.xml", 1_700_000_000 + 3600 * hour + 600 * draw.randrange(6)
                ends = ["", "]]>", "<![CDATA[ </item> <item> 1 ]]>", "<![CDATA[ </item> <item> 2 ]]>"] if n % 2 else [""]
                items = [f"<item><title>{draw.randrange(150)}{'x' * draw.randrange(3)}{draw.choice(ends)}</title>" for _ in range(300)]
                path.write_text(f"<rss><channel>{''.join(x + '</item>' for x in items)}</channel></rss>")
                os.utime(path, (modified, modified))
                for x in items:
                    firsts[x] = min(firsts.get(x, (modified, f"file://{path}")), (modified, f"file://{path}"))
            fresh = {x: v for x, v in firsts.items() if x not in seen or seen[x] + 2 * 3600 < v[0]}
            expected += [(x, v[1].rpartition("/")[2], v[0]) for x, v in fresh.items()]
            seen |= {x: v[0] for x, v in fresh.items()}
            rows = collected(spark, tmp_path, "2 hours").select("item_xml", "export_id", F.unix_timestamp("modified").alias("t"), "item_hash", F.sha2("item_xml", 256).alias("h")).collect()
            assert sorted((r["item_xml"], r["export_id"].rpartition("/")[2], r["t"]) for r in rows) == sorted(expected)
            assert all(r["item_hash"] == r["h"] for r in rows)
        assert len(expected) > len(seen) > 450
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert spark.conf.get(ingest.CUTS, None) is None


def test_texts_of_items_are_not_shuffled(spark, tmp_path):
    text = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 512) for i in range(40)))
    posts = spark.range(400).select((F.col("id") % 3).alias("export"), F.col("id").alias("post_id"), text.alias("post_content"))
    texts, start = 400 * 40 * 128, shuffled(spark)
    exports.write_exports(posts, f"file://{tmp_path}/in", "export", "post_id", copies=("", "-again"))
    written = shuffled(spark) - start
    assert written < 1.3 * texts, "a text is shuffled once, not for each copy"
    rows = collected(spark, tmp_path)
    assert shuffled(spark) - start - written < texts / 10
    assert (rows.count(), rows.select("item_hash").distinct().count()) == (400, 400)


def test_copies_are_the_export_under_other_names(spark, tmp_path):
    posts = spark.range(500).select((F.col("id") % 3).cast("string").alias("export"), F.col("id").alias("post_id"), F.lit("a").alias("post_title"))
    name = F.col("export")
    exports.write_exports(posts, f"{tmp_path}/one", "export", "post_id", F.when(name != "1", "1.1"), F.concat(F.lit("https://h"), name))
    exports.write_exports(posts, f"{tmp_path}/two", "export", "post_id", F.when(name != "1", "1.1"), F.concat(F.lit("https://h"), name), copies=("", "-b"))
    joined = lambda folder: b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))
    assert sorted(p.name for p in (tmp_path / "two").glob("export=*")) == sorted(f"export={n}{c}" for n in "012" for c in ("", "-b"))
    for n in "012":
        one = joined(tmp_path / "one" / f"export={n}")
        assert joined(tmp_path / "two" / f"export={n}") == one and one.count(b"</item>") in (166, 167)
        assert joined(tmp_path / "two" / f"export={n}-b") == one.replace(f"<title>{n}</title>".encode(), f"<title>{n}-b</title>".encode(), 1)


@pytest.mark.parametrize("block, in_place", [("700", True), ("5k", True), ("5k", False)])
def test_torn_items_over_blocks_against_brute_force(spark, tmp_path, block, in_place):
    """Sections within a block, over its end, over many blocks and parts, and open at the end; marks in turn in one piece."""
    draw, expected, confs = random.Random(11), [], ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    words = ["</item>", "</item>", "<item>", "x" * 40, "é ", "<![CDATA[", "]]>", "]]>", "]]]]><![CDATA[>"]
    for n in range(8):
        text = "".join(draw.choices(words, [4, 4, 4, 4, 2, 0 if n == 0 else 0.4, 1, 1, 0.1], k=1500))
        if n % 2:
            cuts = sorted(draw.randrange(len(text)) for _ in range(3))
            cuts = [0, *(text.find("</item>", c) + 7 for c in cuts if text.find("</item>", c) >= 0), len(text)]
            (tmp_path / f"export={n}").mkdir()
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                (tmp_path / f"export={n}" / f"part-{i:05}.txt").write_text(text[lo:hi])
        else:
            (tmp_path / f"{n}.xml").write_text(text)
        run, is_open = [], False
        pieces = text.split("</item>")
        for piece in pieces if pieces[-1] else pieces[:-1]:
            run.append(piece)
            marks = piece.rfind("<![CDATA["), piece.rfind("]]>")
            is_open = marks[0] > marks[1] if max(marks) >= 0 else is_open
            if not is_open:
                expected.append((str(n), "</item>".join(run)))
                run = []
        expected += [(str(n), "</item>".join(run))] * bool(run)
    before = {c: spark.conf.get(c) for c in confs}
    for c in confs:
        spark.conf.set(c, block)
    try:
        chunks = exports.scan_chunks(spark, f"file://{tmp_path}")
        blocks = exports.blocks_of(chunks)
        inner, over = exports.joined_in_place(chunks, blocks)
        whole = exports.whole_chunks(chunks, blocks.filter("any_open").select("export_id").distinct())
        found = whole.unionByName(inner).unionByName(over) if in_place else exports.read_chunks(spark, f"file://{tmp_path}")
        rows = found.orderBy("export_id", "doc_pos").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    name = lambda e: e.rpartition("/")[2].removeprefix("export=").removesuffix(".xml")
    got = [(name(r["export_id"]), r["chunk"]) for r in rows if r["chunk"]]
    expected = [e for e in expected if e[1]]
    assert [[t for e, t in got if e == str(n)] for n in range(8)] == [[t for e, t in expected if e == str(n)] for n in range(8)]
    assert max(t.count("</item>") for _, t in got) > 8


def test_texts_of_torn_items_are_not_shuffled(spark, tmp_path):
    text = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 512) for i in range(40)))
    items = spark.range(400).select(F.concat(F.lit("<item><title>"), "id", F.lit("</title><content:encoded><![CDATA["), text, F.lit(" </item> <item>]]></content:encoded></item>")).alias("value"))
    items.write.text(f"file://{tmp_path}/in/export=a")
    start = shuffled(spark)
    rows = collected(spark, tmp_path)
    assert shuffled(spark) - start < 400 * 40 * 128 / 10
    assert rows.count() == 400 and rows.filter(F.col("item_xml").endswith(" </item> <item>]]></content:encoded>")).count() == 400


def scanned(spark):
    """Bytes that the session has read from files."""
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


def test_torn_files_are_scanned_three_times(spark, tmp_path):
    text = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 512) for i in range(40)))
    items = spark.range(2000).select(F.concat(F.lit("<item><title>"), "id", F.lit("</title><content:encoded><![CDATA["), text, F.lit(" </item> <item>]]></content:encoded></item>")).alias("value"))
    items.write.text(f"file://{tmp_path}/in/export=a")
    size, start = sum(f.stat().st_size for f in (tmp_path / "in").rglob("part-*")), scanned(spark)
    run = ingest.collect_items(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", available_now=True)
    run.awaitTermination()
    assert 2.9 * size < scanned(spark) - start < 3.3 * size
    assert TableLog(spark, f"file://{tmp_path}/out", ingest.ITEMS).tables()["items"].count() == 2000


def test_marks_and_items_of_pieces(spark):
    texts = ["", "a", "<![CDATA[", "]]>", "<![CDATA[]]>", "]]><![CDATA[", "é<![CDATA[ x ]]> y <![CDATA[é]]", "<![CDATA[]]]]><![CDATA[>", "<![CDATA[<![CDATA[]]>", "<item>a", "\n <item>a\n", "x<item>", " <item a='1'>b", "<items>", " " * 80 + "<item>z\n", "<item\n>q<item>", "<rss><item>\r"]
    df = spark.createDataFrame([("e", (0, i), t) for i, t in enumerate(texts)], "export_id string, doc_pos struct<block:bigint,row:bigint>, chunk string")
    marks = {r["doc_pos"]["row"]: r["ends_open"] for r in exports._marks(df).collect()}
    ends = {i: (t.rfind("<![CDATA["), t.rfind("]]>")) for i, t in enumerate(texts)}
    assert marks == {i: None if max(e) < 0 else e[0] > e[1] for i, e in ends.items()}
    items, channel = exports.split_chunks(df)
    found = {i: m for i, t in enumerate(texts) if (m := re.search(r"(?s)<item[\s>].*", t))}
    assert {r["doc_pos"]["row"]: r["item_xml"] for r in items.collect()} == {i: m[0] for i, m in found.items()}
    heads = {i: t[: found[i].start()] if i in found else t for i, t in enumerate(texts)}
    assert {r["doc_pos"]["row"]: r["channel_xml"] for r in channel.collect()} == {i: t for i, t in heads.items() if t.strip(" \n\r\t")}
