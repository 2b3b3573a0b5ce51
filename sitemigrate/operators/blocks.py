"""Block comments in content: delimiters, nesting, inner markup, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemigrate.storage import keep

COMMENT = r"(?s)<!--.*?-->"
DELIMITER = r"(?s)^<!--\s*(/?)(wp:[A-Za-z0-9_-]+)\s*((?:\{|\[).*(?:\}|\]))?\s*(/?)\s*-->$"


def delimiters(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every block delimiter: (id, ord, start, stop, is_closer, block, attrs, void), places in code points, stop exclusive.

    A comment ends at its first ``-->``. One whose attributes aren't a JSON object or array is no delimiter, nor is a closer
    with attributes. ``ord`` counts a text's comments.
    """
    pieces = F.arrays_zip(F.split(F.col(text_col), COMMENT, -1).alias("gap"), F.regexp_extract_all(F.col(text_col), F.lit(COMMENT), F.lit(0)).alias("all"))
    rows = docs.filter(F.col(text_col).contains("<!--")).select(F.col(id_col), F.posexplode(pieces).alias("ord", "x"))
    before = Window.partitionBy(id_col).orderBy("ord")
    lengths = rows.withColumn("start", F.sum(F.length("x.gap")).over(before) + F.coalesce(F.sum(F.length("x.all")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = lambda n: F.regexp_extract("x.all", DELIMITER, n)
    found = lengths.filter(F.col("x.all").rlike(DELIMITER)).select(
        F.col(id_col), "ord", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("x.all")).cast("int").alias("stop"), (part(1) == "/").alias("is_closer"),
        part(2).alias("block"), F.nullif(part(3), F.lit("")).alias("attrs"), (part(4) == "/").alias("void"),
    )
    return found.filter(F.col("attrs").isNull() | (~F.col("is_closer") & F.try_parse_json("attrs").isNotNull()))


def nesting(found: DataFrame, id_col: str) -> DataFrame:
    """Delimiters with ``depth`` (of the block they open or close, from 1) and ``breadcrumbs``, up to a document's first error.

    A closer that doesn't close the innermost open block is an error: its row has ``error``, and later ones are left out.

    Depths are running sums. A closer belongs to the row before it of its own depth, which must be an opener of its block;
    the first one that doesn't fit cuts its document. Breadcrumbs come from parents, the last openers one level up, by
    doubling the distance that is known: joins grow with the logarithm of the depth, and nothing with a text's square.
    """
    spark = found.sparkSession
    order = Window.partitionBy(id_col).orderBy("ord")
    change = F.when(F.col("is_closer"), -1).when(F.col("void"), 0).otherwise(1)
    open_before = F.coalesce(F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = found.withColumn("depth", open_before + F.when(F.col("is_closer"), 0).otherwise(1))
    level = Window.partitionBy(id_col, "depth").orderBy("ord")
    opener = F.when(~F.col("is_closer") & ~F.col("void"), F.struct("ord", "block"))
    last = F.last(F.when(~F.col("void"), F.struct(opener.alias("opener"))), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, -1))["opener"]
    paired = placed.withColumn("__of", F.when(F.col("is_closer"), last))
    wrong = F.col("is_closer") & ((F.col("depth") < 1) | F.col("__of").isNull() | (F.col("__of.block") != F.col("block")))
    marked = paired.withColumn("error", F.when(wrong, F.lit("closer doesn't match"))).withColumn("__first", F.min(F.when(F.col("error").isNotNull(), F.col("ord"))).over(Window.partitionBy(id_col)))
    rows = keep(spark, marked.filter("__first IS NULL OR ord <= __first").drop("__first"))

    # The last opener one level up is the parent: openers and those that ask for one meet by level.
    openers = rows.filter("NOT is_closer AND NOT void")
    asking = rows.filter("NOT is_closer")
    meeting = openers.select(id_col, "depth", "ord", F.col("ord").alias("up")).unionByName(asking.select(id_col, (F.col("depth") - 1).alias("depth"), "ord", F.lit(None).cast("int").alias("up")))
    parent = meeting.withColumn("parent", F.last("up", ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, -1))).filter("up IS NULL").select(id_col, "ord", "parent")
    paths = asking.select(id_col, "ord", "void", F.array("block").alias("crumbs")).join(parent, [id_col, "ord"])
    while True:
        paths = keep(spark, paths)
        if not paths.filter("parent IS NOT NULL").take(1):
            break
        above = paths.filter("NOT void").select(id_col, F.col("ord").alias("parent"), F.col("parent").alias("__next"), F.col("crumbs").alias("__above"))
        paths = paths.join(above, [id_col, "parent"], "left").select(id_col, "ord", "void", F.concat(F.coalesce("__above", F.array().cast("array<string>")), "crumbs").alias("crumbs"), F.col("__next").alias("parent"))
    at = F.when(F.col("is_closer"), F.col("__of.ord")).otherwise(F.col("ord"))
    known = paths.select(F.col(id_col).alias("__id"), F.col("ord").alias("__ord"), "crumbs")
    joined = rows.join(known, (F.col(id_col) == F.col("__id")) & (at == F.col("__ord")), "left")
    crumbs = F.coalesce("crumbs", F.array().cast("array<string>"))
    return joined.select(id_col, "ord", "start", "stop", "is_closer", "block", "attrs", "void", F.greatest("depth", F.lit(0)).alias("depth"), crumbs.alias("breadcrumbs"), "error")


def inner_html(docs: DataFrame, nested: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, block, depth, inner): what stands between an opener and its closer, the next row of its depth."""
    order = Window.partitionBy(id_col, "depth").orderBy("ord")
    closer = F.lead(F.when(F.col("is_closer"), F.col("start"))).over(order)
    pairs = nested.filter("NOT void AND error IS NULL").withColumn("close", closer).filter("NOT is_closer AND close IS NOT NULL")
    texts = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    return pairs.join(texts, id_col).select(id_col, "ord", "block", "depth", F.expr("substring(__text, stop + 1, close - stop)").alias("inner"))


def attribute_paths(found: DataFrame, id_col: str, levels: int | None = None) -> DataFrame:
    """(id, ord, block, depth, path, value): one row for each attribute, parents before children.

    All levels by default: the depth of the deepest value is first taken from the data. ``levels`` stops
    earlier.
    """
    here = found.filter("attrs IS NOT NULL").select(F.col(id_col), "ord", "block", F.lit("").alias("path"), F.try_parse_json("attrs").alias("v"))
    if levels is None:
        levels = _json_depth(found)
    out = None
    for depth in range(1, max(levels, 1) + 1):
        inner = here.sparkSession.tvf.variant_explode(F.col("v").outer())
        step = F.coalesce("key", F.col("pos").cast("string"))
        path = F.concat("path", F.when(F.col("path") == "", "").otherwise("."), step)
        exploded = here.lateralJoin(inner).select(F.col(id_col), "ord", "block", path.alias("path"), F.col("value").alias("v"))
        rows = exploded.select(F.col(id_col), "ord", "block", F.lit(depth).alias("depth"), "path", F.expr("cast(v as string)").alias("value"))
        out = rows if out is None else out.unionByName(rows)
        here = exploded.filter(F.expr("schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'"))
    return out


def _json_depth(found: DataFrame) -> int:
    """The deepest nesting of brackets in ``attrs``, outside of strings."""
    bare = F.regexp_replace(F.regexp_replace("attrs", r"(?s)\\.", ""), r'"[^"]*+"', "")  # escapes only stand in strings
    step = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def add(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return found.filter("attrs IS NOT NULL").select(F.max(F.aggregate(step, start, add)["most"])).first()[0] or 0


def usage(found: DataFrame) -> DataFrame:
    """Openers by block, and how many of them have attributes."""
    return found.filter("NOT is_closer").groupBy("block").agg(F.count("*").alias("n"), F.count("attrs").alias("n_with_attrs"), F.sum(F.col("void").cast("long")).alias("n_void"))


def attribute_usage(found: DataFrame, id_col: str) -> DataFrame:
    """Openers by block and attribute of the first level."""
    return attribute_paths(found, id_col, levels=1).groupBy("block", F.col("path").alias("attr")).agg(F.count("*").alias("n"))


def serialize(block: Column, attrs: Column, void: Column, is_closer: Column) -> Column:
    """A delimiter from its parts: angle brackets and ampersands of the attributes as ``\\u`` escapes, empty ones left out."""
    safe = attrs
    for raw, escaped in (("<", "\\u003C"), (">", "\\u003E"), ("&", "\\u0026")):
        safe = F.replace(safe, F.lit(raw), F.lit(escaped))
    body = F.when(attrs.isNull() | attrs.isin("{}", "[]"), F.lit("")).otherwise(F.concat(F.lit(" "), safe))
    return F.concat(F.lit("<!-- "), F.when(is_closer, "/").otherwise(""), block, body, F.when(void, " /").otherwise(""), F.lit(" -->"))
