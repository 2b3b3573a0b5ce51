"""Scans of export files: items of files of any size, headers, channel elements, quarantine; and a writer.

A file is cut at ``</item>`` by the text source, so that one large file fills many tasks. What stands before the first
item (and after the last) belongs to the channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sitemigrate import schema
from sitemigrate.functions import item_xml
from sitemigrate.sources import standard_items
from sitemigrate.storage import exists

#: Host of the namespaces that are written; where a consumer asks for another one, pass it to ``write_exports``.
NAMESPACE_HOST = "export.example.org"


def root_tag(host: str = NAMESPACE_HOST) -> str:
    return f'<rss version="2.0" xmlns:excerpt="http://{host}/export/1.2/excerpt/" xmlns:content="{item_xml.CONTENT}" xmlns:dc="{item_xml.DC}" xmlns:wp="http://{host}/export/1.2/">'


# --- scanning ----------------------------------------------------------------------------------------------------------


#: An export in parts: files of one folder ``export=<name>``, in the order of their part numbers.
PART = r"^(.*/export=[^/]*)/part-(\d+)[^/]*$"


def export_of(file_path: Column) -> Column:
    """The export a file belongs to: the folder of an export in parts, else the file itself."""
    return F.when(file_path.rlike(PART), F.regexp_extract(file_path, PART, 1)).otherwise(file_path)


def chunks_of(raw: DataFrame) -> DataFrame:
    """(export_id, doc_pos, chunk) of a text scan with ``value``; ``doc_pos`` sorts in document order within an export.

    A block is a place in a file, after all places in the parts before it.
    """
    path = F.col("_metadata.file_path")
    part = F.coalesce(F.regexp_extract(path, PART, 2).try_cast("bigint"), F.lit(0))
    block = F.shiftleft(part, 44) + F.col("_metadata.file_block_start")
    return raw.select(export_of(path).alias("export_id"), F.struct(block.alias("block"), F.monotonically_increasing_id().alias("row")).alias("doc_pos"), F.col("value").alias("chunk"))


def scan_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pieces of export files between ends of items, as they are cut (see ``chunks_of``)."""
    return chunks_of(spark.read.option("lineSep", "</item>").option("recursiveFileLookup", "true").text(paths))


def read_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pieces of export files between ends of items; a piece that ends inside a CDATA section goes on in the next one.

    Whether a section is open is carried over marks of the pieces, without their texts: along the blocks of a file that Spark
    reads in one task, and from block to block by one row for each. Only exports with torn items are put in order, and only
    their texts are shuffled, by piece; no text is dealt by its export. The names of such exports go to all tasks, as the
    driver lists the names of all files anyway.
    """
    chunks = scan_chunks(spark, paths)
    torn = torn_exports(chunks)
    return whole_chunks(chunks, torn).unionByName(joined_chunks(chunks, torn))


def _marks(chunks: DataFrame) -> DataFrame:
    """Pieces without their texts: whether a CDATA section is open at a piece's end, null if it has no mark of one."""
    opened, closed = F.contains("chunk", F.lit("<![CDATA[")), F.contains("chunk", F.lit("]]>"))
    after = F.substring_index("chunk", "<![CDATA[", -1)  # the marks share no letters at their ends, so none overlaps another
    return chunks.select("export_id", "doc_pos", F.when(opened | closed, opened & ~F.contains(after, F.lit("]]>"))).alias("ends_open"))


def torn_exports(chunks: DataFrame) -> DataFrame:
    """(export_id) of exports with a piece that ends inside a CDATA section."""
    return _marks(chunks).filter("ends_open").select("export_id").distinct()


def whole_chunks(chunks: DataFrame, torn: DataFrame) -> DataFrame:
    """Pieces of exports that aren't ``torn``, where they were read."""
    return chunks.join(F.broadcast(torn), "export_id", "left_anti").select("export_id", "doc_pos", "chunk")


def joined_chunks(chunks: DataFrame, torn: DataFrame) -> DataFrame:
    """Pieces of ``torn`` exports, those that a CDATA section goes over joined, at the place of their first."""
    torn = F.broadcast(torn)
    rows = _marks(chunks).join(torn, "export_id", "left_semi").withColumn("block", F.col("doc_pos.block"))
    within = Window.partitionBy("export_id", "block").orderBy("doc_pos").rowsBetween(Window.unboundedPreceding, -1)

    def before(df: DataFrame, of: str, out: str) -> DataFrame:
        """``df`` with the last ``of`` that isn't null of all pieces before, in the same block or in earlier ones."""
        ends = df.groupBy("export_id", "block").agg(F.max_by(of, F.when(F.col(of).isNotNull(), F.col("doc_pos"))).alias("end"))
        earlier = Window.partitionBy("export_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("export_id", "block", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
        return df.join(carried, ["export_id", "block"]).withColumn(out, F.coalesce(F.last(of, ignorenulls=True).over(within), "carried")).drop("carried")

    rows = before(rows, "ends_open", "open").withColumn("open", F.coalesce("open", F.lit(False)))
    rows = before(rows.withColumn("start", F.when(~F.col("open"), F.col("doc_pos"))), "start", "item").withColumn("item", F.coalesce("start", "item"))
    places = rows.select("export_id", "doc_pos", "item", (F.col("open") | F.coalesce("ends_open", F.lit(False))).alias("is_part"))
    placed = chunks.join(torn, "export_id", "left_semi").join(places.hint("shuffle_hash"), ["export_id", "doc_pos"])
    joined = placed.groupBy("export_id", F.when(F.col("is_part"), F.col("item")).otherwise(F.col("doc_pos")).alias("at")).agg(F.sort_array(F.collect_list(F.struct("doc_pos", "chunk"))).alias("parts"))
    return joined.select("export_id", F.col("at").alias("doc_pos"), F.array_join(F.col("parts.chunk"), "</item>").alias("chunk"))


def _place() -> Column:
    """A block of an export as one task reads it, in the order of ``doc_pos``."""
    return F.struct(F.col("doc_pos.block").alias("block"), F.shiftright("doc_pos.row", 33).alias("task"))


def blocks_of(chunks: DataFrame) -> DataFrame:
    """(export_id, place, any_open, any_closed, ends_open): whether pieces of a block end inside a CDATA section or outside of
    one, as far as they have marks of one, and the last of them."""
    marks = _marks(chunks).select("export_id", _place().alias("place"), F.col("doc_pos.row").alias("row"), F.col("ends_open").alias("open"))
    last = F.max(F.when(F.col("open").isNotNull(), 2 * F.col("row") + F.col("open").cast("int")))
    none = F.lit(False)
    return marks.groupBy("export_id", "place").agg(F.coalesce(F.bool_or("open"), none).alias("any_open"), F.coalesce(F.bool_or(~F.col("open")), none).alias("any_closed"), (last % 2 == 1).alias("ends_open"))


def pieces_in_place(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(export_id, doc_pos, chunk, origin): pieces of the exports with torn items among ``blocks`` (see ``blocks_of``), joined
    within their block by Arrow batches where they are read; ``origin`` is the place where a piece that goes on in other
    blocks begins, else null. The rows of blocks go to all tasks, as the driver lists all files and cuts them anyway.
    """
    torn = F.broadcast(blocks.filter("any_open").select("export_id").distinct())
    before = Window.partitionBy("export_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    states = blocks.join(torn, "export_id", "left_semi").withColumn("open", F.coalesce(F.last("ends_open", ignorenulls=True).over(before), F.lit(False)))
    begins = F.coalesce("ends_open", "open") & (F.col("any_closed") | ~F.col("open"))
    states = states.withColumn("origin", F.last(F.when(begins, F.col("place")), ignorenulls=True).over(before)).select("export_id", "place", "open", "origin")
    rows = chunks.withColumn("place", _place()).join(F.broadcast(states), ["export_id", "place"]).select("export_id", "place.block", "place.task", "doc_pos.row", "chunk", "open", F.col("origin.block").alias("o_block"), F.col("origin.task").alias("o_task"))
    out = "export_id string, block bigint, row bigint, chunk string, o_block bigint, o_task bigint"
    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)
        for row in _join_pieces(batches):
            made.append(row)
            size += len(row[3])
            if size > 1 << 22 or len(made) == 1000:
                yield batch_of()
                made, size = [], 0
        if made:
            yield batch_of()

    origin = F.when(F.col("o_task").isNotNull(), F.struct(F.col("o_block").alias("block"), F.col("o_task").alias("task")))
    return rows.mapInArrow(run, out).select("export_id", F.struct("block", "row").alias("doc_pos"), "chunk", origin.alias("origin"))


def joined_over(pieces: DataFrame) -> DataFrame:
    """Those ``pieces_in_place`` that go on in other blocks, joined; they are the only ones that are shuffled."""
    parts = pieces.filter("origin IS NOT NULL").groupBy("export_id", "origin").agg(F.sort_array(F.collect_list(F.struct("doc_pos", "chunk"))).alias("parts"))
    return parts.select("export_id", F.col("parts")[0]["doc_pos"].alias("doc_pos"), F.array_join(F.col("parts.chunk"), "</item>").alias("chunk"))


def joined_in_place(chunks: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``joined_chunks`` of the exports with torn items: pieces that begin and end in one block, and those that go on in others."""
    pieces = pieces_in_place(chunks, blocks)
    return pieces.filter("origin IS NULL").drop("origin"), joined_over(pieces)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces of blocks, joined as long as a section is open; what goes on in other blocks has the place where it began."""
    blocks: dict[tuple, list] = {}  # open, origin, row and texts of what is being joined
    for batch in batches:
        for export, block, task, row, chunk, is_open, *origin in zip(*(c.to_pylist() for c in batch.columns)):
            b = blocks.get((export, block, task))
            if b is None:
                b = blocks[export, block, task] = [is_open, tuple(origin) if is_open and origin[1] is not None else None, row, []]
            if not b[3]:
                b[2] = row
            b[3].append(chunk)
            opened, closed = chunk.rfind("<![CDATA["), chunk.rfind("]]>")
            if max(opened, closed) >= 0:
                b[0] = opened > closed
            if not b[0]:
                yield export, block, b[2], "</item>".join(b[3]), *(b[1] or (None, None))
                b[1], b[3] = None, []
    for (export, block, task), (_, origin, row, parts) in blocks.items():
        if parts:
            yield export, block, row, "</item>".join(parts), *(origin or (block, task))


ITEM_AT = r"(?s)^(.*?)(<item[\s>].*)$"


def split_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (export_id, doc_pos, item_xml without its end tag) and channel texts (export_id, doc_pos, channel_xml)."""
    item = item_of("chunk")
    items = chunks.select("export_id", "doc_pos", item.alias("item_xml")).filter("item_xml IS NOT NULL")
    channel = chunks.select("export_id", "doc_pos", F.when(_begins("chunk"), "").when(_has_item("chunk"), F.regexp_extract("chunk", ITEM_AT, 1)).otherwise(F.col("chunk")).alias("channel_xml"))
    return items, channel.filter(F.trim(F.col("channel_xml"), F.lit(" \n\r\t")) != "")


def _begins(chunk: str) -> Column:
    """Whether a piece begins with an item, after blanks at most, as nearly all do: these need no regular expression."""
    return F.startswith(F.ltrim(F.substring(chunk, 1, 64), F.lit(" \n\r\t")), F.lit("<item>"))


def _has_item(chunk: str) -> Column:
    return F.col(chunk).rlike(r"<item[\s>]")


def item_of(chunk: str) -> Column:
    """The item of a piece, without its end tag; null if it has none."""
    return F.when(_begins(chunk), F.ltrim(chunk, F.lit(" \n\r\t"))).when(_has_item(chunk), F.regexp_extract(chunk, ITEM_AT, 2))


def read_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every item of the files: (export_id, doc_pos, item_xml)."""
    return split_chunks(read_chunks(spark, paths))[0]


def _element(name: str) -> Column:
    """The text of the first channel element of this name, plain or in a CDATA section."""
    found = F.regexp_extract("channel_xml", rf"(?s)<{name}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    return F.when(F.col("channel_xml").rlike(rf"<{name}[\s>]"), found)


def headers_of(channel: DataFrame) -> DataFrame:
    """One row per file: version, base_url, base_blog_url (the base_url by default), blogname and the root tag."""
    firsts = {"version": _element("wp:wxr_version"), "base_url": _element("wp:base_site_url"), "base_blog_url": _element("wp:base_blog_url"), "blogname": _element("title")}
    firsts["root_tag"] = F.nullif(F.regexp_extract("channel_xml", r"(?s)<rss[^>]*>", 0), F.lit(""))
    firsts["has_doctype"] = F.when(F.col("channel_xml").contains("<!DOCTYPE"), F.lit("yes"))
    rows = channel.select("export_id", "doc_pos", *(c.alias(n) for n, c in firsts.items()))
    firsts_by_file = rows.groupBy("export_id").agg(*(F.min_by(n, F.when(F.col(n).isNotNull(), F.col("doc_pos"))).alias(n) for n in firsts))
    return firsts_by_file.withColumn("base_url", F.trim("base_url")).withColumn("base_blog_url", F.coalesce(F.nullif(F.trim("base_blog_url"), F.lit("")), "base_url"))


def validate_exports(headers: DataFrame) -> DataFrame:
    """Adds ``status`` (ok, warning, error) and ``reason`` by the version."""
    version = F.trim("version")
    bad = version.isNull() | ~version.rlike(r"^\d+\.\d+$")
    newer = F.split(version, r"\.")[0].try_cast("int") * 1000 + F.split(version, r"\.")[1].try_cast("int") > 1002
    return headers.withColumn("status", F.when(bad, "error").when(newer, "warning").otherwise("ok")).withColumn("reason", F.when(bad, "missing or invalid version").when(newer, "newer version"))


def read_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Validated headers of all files, and an error row for each path that names no file."""
    there = [p for p in paths if exists(spark, p)]
    missing = spark.createDataFrame([(p, "error", "file not found") for p in paths if p not in there], "export_id string, status string, reason string")
    if not there:
        return missing
    headers = validate_exports(headers_of(split_chunks(read_chunks(spark, there))[1]))
    return headers.unionByName(missing, allowMissingColumns=True)


# --- parsing -----------------------------------------------------------------------------------------------------------


def _parse(df: DataFrame, text: str, kind: str, parse) -> DataFrame:
    """Adds the columns of ``kind`` to (export_id, doc_pos, ``text``, root_tag), one parse for each row."""
    out = f"export_id string, doc_pos struct<block:bigint,row:bigint>, {text} string, {kind}"
    arrow = to_arrow_schema(StructType.fromDDL(out))
    columns = [f.name for f in StructType.fromDDL(kind)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows = []
                for xml, root in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    try:
                        rows.append(parse(root or root_tag(), xml))
                    except (item_xml.ET.ParseError, ValueError) as e:
                        rows.append({"error": str(e)})
                made = [pa.array([r.get(c) for r in rows], arrow.field(c).type) for c in columns]
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(arrow.field(i).type) for i in range(3)), *made], schema=arrow)

    return df.select("export_id", "doc_pos", text, "root_tag").mapInArrow(run, out)


def _rows_of(texts: list[str | None], roots: list[str | None]) -> Iterator[dict | None]:
    for xml, root in zip(texts, roots):
        try:
            yield None if xml is None else item_xml.parse_item(root or root_tag(), xml)
        except (item_xml.ET.ParseError, ValueError) as e:
            yield {"error": str(e)}


def _parse_or_read(root: str, xml: str) -> dict:
    """An item's row; of one that isn't XML, what its tags give, with ``error``."""
    try:
        return item_xml.parse_item(root, xml)
    except (item_xml.ET.ParseError, ValueError) as e:
        return item_xml.parse_leniently(xml) | {"error": str(e)}


def parse_items(items: DataFrame, headers: DataFrame, by: str = "python", salvage: bool = False) -> DataFrame:
    """Typed, nested rows of items (see ``schema.ITEM``); ``error`` is set, and all else null, for items that aren't XML.

    Names are resolved by the root tag of the item's own file. The headers, a short row for each export, go to all tasks, so
    that no item is dealt by its export. ``by`` is one of

    * ``python``: all items are parsed in Arrow batches;
    * ``mixed``: items in the usual form (``standard_items``) are read in the JVM, in the same pass others go to Python;
    * ``jvm``: there is no Python worker at all, and items in another form count as not XML.

    The rows are the same, but for those others in ``jvm``. With ``salvage`` (``python`` only), items that aren't XML have
    beside their ``error`` what ``read_leniently`` gives, from the same worker.
    """
    if salvage and by != "python":
        raise ValueError("salvage goes with by='python'")
    if by == "python" and salvage:
        return _parse(items.join(F.broadcast(headers.select("export_id", "root_tag")), "export_id"), "item_xml", schema.ITEM, _parse_or_read)
    if by == "python":
        return _parse(items.join(F.broadcast(headers.select("export_id", "root_tag")), "export_id"), "item_xml", schema.ITEM, item_xml.parse_item)
    if by not in ("mixed", "jvm"):
        raise ValueError(f"by is python, mixed or jvm, not {by!r}")
    roots = headers.select("export_id", "root_tag", standard_items.usual_root(F.col("root_tag")).alias("__usual_root"))
    xml = F.col("item_xml")
    rows = items.join(F.broadcast(roots), "export_id").withColumn("__usual", F.col("__usual_root") & standard_items.usual_item(xml))
    rows = rows.withColumn("__x", F.when(F.col("__usual"), standard_items.read(xml)))
    names = [f.name for f in StructType.fromDDL(schema.ITEM)]
    native = standard_items.item_columns(F.col("__x"))
    read = F.coalesce(F.col("__usual"), F.lit(False)) & F.col("__x").isNotNull() & F.col(f"__x.{standard_items.BROKEN}").isNull()
    rows = rows.withColumn("__read", read)
    if by == "jvm":
        columns = [(F.when(F.col("__read"), native[c]) if c != "error" else F.when(~F.col("__read"), "not in the usual form")).alias(c) for c in names]
        return rows.select("export_id", "doc_pos", "item_xml", *columns)
    arrow = pa.struct(list(to_arrow_schema(StructType.fromDDL(schema.ITEM))))

    @F.arrow_udf(returnType=StructType.fromDDL(schema.ITEM))
    def parsed(texts: pa.Array, of: pa.Array) -> pa.Array:
        return pa.array(_rows_of(texts.to_pylist(), of.to_pylist()), arrow)

    rows = rows.withColumn("__p", parsed(F.when(~F.col("__read"), xml), F.when(~F.col("__read"), F.col("root_tag"))))
    return rows.select("export_id", "doc_pos", "item_xml", *(F.when(F.col("__read"), native[c]).otherwise(F.col(f"__p.{c}")).alias(c) for c in names))


def parse_channel(channel: DataFrame, headers: DataFrame) -> DataFrame:
    """Authors and terms of the channel texts, with their order (doc_pos, and ord within a text)."""
    inner = F.regexp_replace(F.regexp_replace("channel_xml", r"(?s)^.*?<channel[^>]*>", ""), r"(?s)</channel>\s*</rss>\s*$", "")
    return _parse(channel.withColumn("channel_xml", inner).join(F.broadcast(headers.select("export_id", "root_tag")), "export_id"), "channel_xml", schema.CHANNEL, item_xml.parse_channel)


def authors_of(channel: DataFrame) -> DataFrame:
    return channel.select("export_id", "doc_pos", F.posexplode("authors").alias("ord", "a")).select("export_id", "doc_pos", "ord", "a.*")


def terms_of(channel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (categories, tags, others; ``phase`` keeps the load order) and their metadata."""
    rows = channel.select("export_id", "doc_pos", F.explode("terms").alias("t")).select("export_id", "doc_pos", "t.*")
    meta = rows.select("export_id", "taxonomy", "slug", "doc_pos", F.posexplode("termmeta").alias("meta_ord", "m")).select("export_id", "taxonomy", "slug", "doc_pos", "meta_ord", "m.key", "m.value")
    return rows.drop("termmeta"), meta


def flatten_entities(parsed: DataFrame) -> dict[str, DataFrame]:
    """posts, post_terms, postmeta, comments and commentmeta, each with its parents' keys and its place."""
    good = parsed.filter("error IS NULL")
    key = ["export_id", F.col("doc_pos").alias("post_doc_pos")]
    posts = good.drop("terms", "postmeta", "comments", "item_xml", "error")
    terms = good.select(*key, F.posexplode("terms").alias("ord", "t")).select("export_id", "post_doc_pos", "ord", "t.domain", "t.slug", "t.name")
    meta = good.select(*key, F.posexplode("postmeta").alias("ord", "m")).select("export_id", "post_doc_pos", "ord", "m.key", "m.value")
    nested = good.select(*key, F.posexplode("comments").alias("ord", "c")).select("export_id", "post_doc_pos", "ord", "c.*")
    commentmeta = nested.select("export_id", "post_doc_pos", "comment_id", F.posexplode("commentmeta").alias("ord", "m")).select("export_id", "post_doc_pos", "comment_id", "ord", "m.key", "m.value")
    return {"posts": posts, "post_terms": terms, "postmeta": meta, "comments": nested.drop("commentmeta"), "commentmeta": commentmeta}


# --- quarantine --------------------------------------------------------------------------------------------------------


def quarantine(parsed: DataFrame) -> DataFrame:
    """Items that the parser refused: (export_id, doc_pos, item_xml, error)."""
    return parsed.filter("error IS NOT NULL").select("export_id", "doc_pos", "item_xml", "error")


def read_leniently(quarantined: DataFrame) -> DataFrame:
    """Refused items as rows of ``parse_items``, read by their tags alone: all fields, terms, metadata and comments."""
    return _parse(quarantined.withColumn("root_tag", F.lit(None).cast("string")), "item_xml", schema.ITEM, lambda _, xml: item_xml.parse_leniently(xml))


def salvage(quarantined: DataFrame) -> DataFrame:
    """The scalar fields of refused items, read by their tags alone."""
    return read_leniently(quarantined).drop("item_xml", "terms", "postmeta", "comments", "failed_casts", "error")


# --- writing -----------------------------------------------------------------------------------------------------------


def escape(c: Column) -> Column:
    """Text as XML character data; characters that XML 1.0 can't hold are left out."""
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


#: Element of each scalar column, in the order of writing.
ELEMENTS = {
    "post_title": "title", "link": "link", "pub_date": "pubDate", "post_author": "dc:creator", "guid": "guid", "post_content": "content:encoded", "post_excerpt": "excerpt:encoded",
    **{c: f"wp:{c}" for c in ("post_id", "post_date", "post_date_gmt", "comment_status", "ping_status", "post_name", "status", "post_parent", "menu_order", "post_type", "post_password", "is_sticky", "attachment_url")},
}


def item_text(columns: list[str]) -> Column:
    """The XML of one item from those columns that a table has; null columns make no element."""

    def element(tag: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(f"<{tag}>"), escape(c.cast("string")), F.lit(f"</{tag}>"))).otherwise(F.lit(""))

    def attribute(c: Column) -> Column:
        return F.replace(escape(F.coalesce(c, F.lit(""))), F.lit('"'), F.lit("&quot;"))

    parts = [element(tag, F.col(c)) for c, tag in ELEMENTS.items() if c in columns]
    if "terms" in columns:
        one = lambda t: F.concat(F.lit('<category domain="'), attribute(t["domain"]), F.lit('" nicename="'), attribute(t["slug"]), F.lit('">'), escape(F.coalesce(t["name"], F.lit(""))), F.lit("</category>"))
        parts.append(F.coalesce(F.array_join(F.transform("terms", one), ""), F.lit("")))
    if "postmeta" in columns:
        one = lambda m: F.concat(F.lit("<wp:postmeta>"), element("wp:meta_key", m["key"]), element("wp:meta_value", m["value"]), F.lit("</wp:postmeta>"))
        parts.append(F.coalesce(F.array_join(F.transform("postmeta", one), ""), F.lit("")))
    if "comments" in columns:
        names = {"comment_id": "comment_id", "comment_author": "author", "comment_date": "date", "comment_content": "content", "comment_approved": "approved", "comment_parent": "parent", "comment_user_id": "user_id"}
        one = lambda x: F.concat(F.lit("<wp:comment>"), *(element(f"wp:{tag}", x[c]) for tag, c in names.items()), F.lit("</wp:comment>"))
        parts.append(F.coalesce(F.array_join(F.transform("comments", one), ""), F.lit("")))
    return F.concat(F.lit("<item>"), *parts, F.lit("</item>"))


def write_exports(posts: DataFrame, path: str, export_col: str, order_col: str, version: Column | None = None, base_url: Column | None = None, namespace_host: str = NAMESPACE_HOST, copies: tuple[str, ...] = ("",)) -> str:
    """One export for each value of ``export_col`` below ``path``: a folder ``export=<value>/`` of part files.

    Rows are dealt to tasks by ranges of export and order, so a large export is written by many tasks, each into a part of
    its own; part numbers follow the order of ``order_col``, the first part begins with the head and the last one ends with
    the tail. Joined in that order the parts are one file, and the scan reads a folder as one export (see ``PART``).
    Pass null as version to leave it out. ``version`` and ``base_url`` may only depend on ``export_col``.

    An export is written once for each of ``copies``, under its name with that ending. Rows are dealt once for all copies,
    and become XML after that.
    """
    version = F.lit("1.2") if version is None else version
    base_url = F.lit("https://old.example.org") if base_url is None else base_url
    export, fields = F.col(export_col).cast("string").alias("export"), [c for c in posts.columns if c in ELEMENTS or c in ("terms", "postmeta", "comments")]
    items = posts.select(export, F.lit(1).alias("part"), F.lpad(F.col(order_col).cast("string"), 20, "0").alias("key"), *fields)
    of = posts.select(export, version.cast("string").alias("__version"), base_url.cast("string").alias("__base_url")).distinct()
    ends = of.select("export", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"), F.lit("").alias("key"), "__version", "__base_url")
    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = items.unionByName(ends, allowMissingColumns=True).repartitionByRange(n, "export", "part", "key")
    rows = rows.withColumn("export", F.explode(F.array(*(F.concat("export", F.lit(c)) for c in copies)))).sortWithinPartitions("export", "part", "key")
    head = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8" ?>\n{root_tag(namespace_host)}\n<channel>\n<title>'), escape(F.col("export")), F.lit("</title>"),
        F.when(F.col("__version").isNotNull(), F.concat(F.lit("<wp:wxr_version>"), escape(F.col("__version")), F.lit("</wp:wxr_version>"))).otherwise(F.lit("")),
        F.lit("<wp:base_site_url>"), escape(F.col("__base_url")), F.lit("</wp:base_site_url>"),
    )
    value = F.when(F.col("part") == 1, item_text(fields)).when(F.col("part") == 0, head).otherwise(F.lit("</channel>\n</rss>"))
    rows.select("export", value.alias("value")).write.partitionBy("export").text(path)
    return path
