"""URLs in content: occurrences, matching against site mappings, rewriting, remapping, inventories.

The occurrence table (id, ord, kind, start, end, raw, decoded) is the centre. Places are code points, as ``substring``
counts them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemigrate.functions import markup
from sitemigrate.functions import url_columns as U
from sitemigrate.operators.remaps import apply_url_remap
from sitemigrate.storage import keep


def extract_urls(docs: DataFrame, id_col: str, html_col: str, tlds: DataFrame | None = None, kinds: tuple[str, ...] = ("attr", "style", "text", "block"), block_attributes: dict[str, list[str]] | None = None) -> DataFrame:
    """All URL occurrences of ``html_col``: (id, ord, kind, start, end, raw, decoded).

    Hosts in texts without a scheme count if their top-level domain is in ``tlds`` (column ``tld``) or is ``internal``; without
    ``tlds`` such hosts don't count. Null texts have none. ``block_attributes`` names further attributes of blocks that may
    hold relative URLs.
    """
    known = {b: [*markup.BLOCK_ATTRIBUTES.get(b, []), *(block_attributes or {}).get(b, [])] for b in {**markup.BLOCK_ATTRIBUTES, **(block_attributes or {})}}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                found = [x for x in markup.occurrences(text.as_py() or "", known) if x[0] in kinds]
                rows += [(ord_, *x) for ord_, x in enumerate(found)]
                at += [i] * len(found)
            kinds_ = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds_))], ["id", "ord", "kind", "start", "end", "raw", "decoded", "tld"])

    found = docs.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, ord int, kind string, start int, end int, raw string, decoded string, tld string")
    return known_hosts(found, tlds).drop("tld").withColumnRenamed("id", id_col)


def known_hosts(found: DataFrame, tlds: DataFrame | None) -> DataFrame:
    """Rows whose ``tld`` is null (nothing to check), ``internal``, or in ``tlds``."""
    sure = found.filter("tld IS NULL OR tld = 'internal'")
    if tlds is None:
        return sure
    listed = tlds.select(F.lower("tld").alias("tld")).distinct()
    return sure.unionByName(found.filter("tld <> 'internal'").join(listed, "tld", "left_semi").select(*sure.columns))


def match_mappings(occurrences: DataFrame, mapping: DataFrame, url_col: str = "decoded", longest: bool = False, by: str | None = None) -> DataFrame:
    """``occurrences`` with ``from_base`` and ``to_base`` of the first mapping (by ``ord``, or the longest base) that is a parent.

    Joined on scheme and host, hosts in one form (see ``canonical_hosts``), and on ``by``, a column of both tables, where
    mappings hold for some rows only. Equal places in the order are told apart by base. Occurrences without a match keep
    nulls.
    """
    url, own = F.col(url_col), [by] if by else []
    bases = mapping.select(*own, F.col("ord").alias("__ord"), "from_base", "to_base", U.scheme(F.col("from_base")).alias("__s"), U.host(F.col("from_base")).alias("__host_of"))
    bases = canonical_hosts(bases, "__host_of", "__h").drop("__host_of")
    pairs = occurrences.select(*own, url.alias("__url")).distinct().withColumn("__s", U.scheme(F.col("__url"))).withColumn("__host_of", U.host(F.col("__url"))).filter("__host_of <> ''")
    pairs = canonical_hosts(pairs, "__host_of", "__h").drop("__host_of").join(bases, [*own, "__s", "__h"])
    pairs = pairs.filter(U.is_child_url(F.col("__url"), F.col("from_base"), F.lit(True)))
    rank = F.struct(-F.length("from_base"), F.col("__ord"), "from_base", "to_base") if longest else F.struct("__ord", "from_base", "to_base")
    best = pairs.groupBy(*own, "__url").agg(F.min_by(F.struct("from_base", "to_base"), rank).alias("m")).select(*own, "__url", "m.from_base", "m.to_base")
    if by:
        best = best.withColumnRenamed(by, "__by")
        return occurrences.join(best, (url == F.col("__url")) & (F.col(by) == F.col("__by")), "left").drop("__url", "__by")
    return occurrences.join(best, url == F.col("__url"), "left").drop("__url")


def on_hosts(occurrences: DataFrame, url_col: str, mapping: DataFrame) -> DataFrame:
    """``occurrences`` without those on plain hosts that no base of ``mapping`` has; the bases' hosts go to all tasks."""
    own = canonical_hosts(mapping.select(U.host(F.col("from_base")).alias("__host_of")).distinct(), "__host_of", "__h").select("__h").distinct()
    host = U.host(F.col(url_col))
    joined = occurrences.join(F.broadcast(own), F.lower(host) == F.col("__h"), "left")
    return joined.filter(F.col("__h").isNotNull() | ~plain_host(host)).drop("__h")


def encode_for(kind: Column, url: Column) -> Column:
    """A URL as it is written in place of an occurrence of a kind: escaped for HTML, CSS or JSON."""

    def swap(c: Column, *pairs: tuple[str, str]) -> Column:
        for old, new in pairs:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    text = swap(url, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    attr = swap(text, ('"', "&quot;"), ("'", "&#x27;"))
    style = F.concat(F.lit("url(&quot;"), swap(swap(url, ("\\", "\\\\"), ('"', '\\"')), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), F.lit("&quot;)"))
    block = F.concat(F.lit('"'), swap(url, ("\\", "\\\\"), ('"', '\\"'), ("<", "\\u003C"), (">", "\\u003E"), ("&", "\\u0026")), F.lit('"'))
    return F.when(kind == "attr", attr).when(kind == "style", style).when(kind == "block", block).otherwise(text)


def rewrite_content(docs: DataFrame, mapping: DataFrame, id_col: str, html_col: str, base_url: str | Column | None = None, tlds: DataFrame | None = None, longest: bool = False, by: str | None = None, block_attributes: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with the URLs of ``html_col`` moved by ``mapping`` (ord, from_base, to_base); all else stays byte for byte.

    Relative URLs are read against ``base_url`` (a URL, or a column of ``docs``; a folder has a slash at its end) and stay
    relative: what moves is written as the path from the site's root. Empty ones and fragments alone stay as they are. With ``by``, a row takes
    the mappings of its own value of that column. ``id_col`` must be unique. Adds ``n_rewritten``.
    """
    found = extract_urls(docs, id_col, html_col, tlds, block_attributes=block_attributes)
    first = base_url if isinstance(base_url, Column) else F.lit(base_url or None).cast("string")
    if by or isinstance(base_url, Column):
        found = found.join(docs.select(F.col(id_col), *([F.col(by).alias("__of")] if by else []), first.alias("__base")), id_col)
    else:
        found = found.withColumn("__base", first)
    if by:
        mapping = mapping.withColumnRenamed(by, "__of")
    url, first = F.col("decoded"), F.col("__base")
    relative = ~url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//") & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & (F.col("kind") != "text")
    absolute = F.when(relative, U.resolve(url, first)).otherwise(U.with_scheme(url, F.coalesce(U.scheme(first), F.lit("https"))))
    placed = found.withColumn("relative", relative).withColumn("absolute", absolute).filter("absolute IS NOT NULL")
    placed = keep(docs.sparkSession, on_hosts(placed, "absolute", mapping))  # texts are looked through once
    moved = match_mappings(placed, mapping, "absolute", longest, "__of" if by else None).filter("to_base IS NOT NULL")
    new = U.rebase_url(F.col("absolute"), F.col("from_base"), F.col("to_base"), F.col("relative"), F.lit(True))
    bare = (F.col("kind") == "text") & ~url.rlike(r"^[A-Za-z]+://")
    new = F.when(bare & url.startswith("//"), F.regexp_replace(new, r"^[a-z]+:", "")).when(bare, F.regexp_replace(new, r"^[a-z]+://", "")).otherwise(new)
    edits = moved.withColumn("new", encode_for(F.col("kind"), new)).filter("new <> raw").groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("__edits"))
    joined = docs.join(edits, id_col, "left")
    text = F.when(F.col("__edits").isNull(), F.col(html_col)).otherwise(splice(F.col(html_col), F.col("__edits")))
    return joined.withColumn("n_rewritten", F.coalesce(F.size("__edits"), F.lit(0)).cast("long")).withColumn(html_col, text).select(*docs.columns, "n_rewritten")


def splice(text: Column, edits: Column) -> Column:
    """``text`` with each of the sorted edits (start, end, new) in place; what lies between is copied once."""
    ends = F.concat(F.array(F.lit(0)), F.transform(edits, lambda e: e["end"]))
    pieces = F.zip_with(edits, F.slice(ends, F.lit(1), F.size(edits)), lambda e, at: F.concat(F.substring(text, at + 1, e["start"] - at), e["new"]))
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))


def site_mappings(headers: DataFrame, targets: DataFrame) -> DataFrame:
    """The mapping of each export from its base URL to its site's, both with one trailing slash; none if the base isn't a URL."""
    slash = lambda c: F.concat(F.rtrim(c, F.lit("/")), F.lit("/"))
    joined = headers.join(targets, "export_id").filter(F.col("base_url").rlike(r"^https?://[^/?#]+"))
    return joined.select("export_id", F.lit(0).alias("ord"), slash("base_url").alias("from_base"), slash("site_url").alias("to_base"))


# --- hosts -------------------------------------------------------------------------------------------------------------


def _canonical(host: str | None) -> str | None:
    from urllib.parse import unquote

    if host is None:
        return None
    labels = unicodedata.normalize("NFKC", unquote(host)).casefold().replace("。", ".").split(".")
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)


def plain_host(host: Column) -> Column:
    return F.coalesce(host.rlike(r"^[A-Za-z0-9._\-]*$"), F.lit(True))


def canonical_hosts(df: DataFrame, host_col: str, out: str = "canonical_host") -> DataFrame:
    """``df`` with hosts case-folded, percent-decoded and in punycode.

    Plain hosts are lower-cased; of all others, each distinct one is worked out once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_canonical(x) for x in batch.column(0).to_pylist()], pa.string())], ["__host", "__form"])

    host = F.col(host_col)
    plain = plain_host(host)
    odd = df.filter(~plain).select(host.alias("__host")).distinct().mapInArrow(run, "__host string, __form string")
    return df.join(odd, host == F.col("__host"), "left").withColumn(out, F.when(plain, F.lower(host)).otherwise(F.col("__form"))).drop("__host", "__form")


# --- remaps and inventories ----------------------------------------------------------------------------------------------


def last_remap(remaps: DataFrame) -> DataFrame:
    """Of remaps from one URL, the last written."""
    return remaps.groupBy("export_id", "from_url").agg(F.max_by("to_url", "ord").alias("to_url"))


def resized_stubs(remaps: DataFrame) -> DataFrame:
    """Remaps of the URLs without their extension, for resized copies of an image."""
    stub = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    return remaps.select(*(F.col(c) for c in remaps.columns if c not in ("from_url", "to_url")), stub(F.col("from_url")).alias("from_url"), stub(F.col("to_url")).alias("to_url"))


def remap_enclosures(meta: DataFrame, remaps: DataFrame) -> DataFrame:
    """Post metadata (export_id, key, value) with the remaps of its export applied to the values of ``enclosure``."""
    enclosed = apply_url_remap(meta.filter("key = 'enclosure'"), remaps, "value").select(*meta.columns)
    return meta.filter("NOT coalesce(key = 'enclosure', false)").unionByName(enclosed)


def inventory(occurrences: DataFrame, own_hosts: DataFrame | None = None) -> DataFrame:
    """Counts by kind, scheme and host, with ``internal`` for hosts in ``own_hosts`` (column ``host``)."""
    named = occurrences.withColumn("scheme", U.scheme(F.col("decoded"))).withColumn("host", U.host(F.col("decoded")))
    counts = named.groupBy("kind", "scheme", "host").agg(F.count("*").alias("n"), F.count_distinct("decoded").alias("n_distinct"))
    if own_hosts is None:
        return counts
    own = own_hosts.select(F.lower("host").alias("host")).distinct().withColumn("internal", F.lit(True))
    return counts.join(own, "host", "left").withColumn("internal", F.coalesce("internal", F.lit(False)))


def distinct_sketches(occurrences: DataFrame, by: list[str], precision: int = 12) -> DataFrame:
    """(``by``, n, sketch): occurrences and a HyperLogLog sketch of the distinct URLs of each group, of bounded size.

    Sketches can be kept for each export and merged later. An estimate's relative standard error is about
    1.04 / sqrt(2 ** ``precision``), 1.6 % for 12; null URLs don't count.
    """
    return occurrences.groupBy(*by).agg(F.count("decoded").alias("n"), F.hll_sketch_agg("decoded", precision).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, n, n_distinct, sketch) of sketches of one precision merged into coarser groups; all into one row without ``by``."""
    merged = sketches.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, "n", F.hll_sketch_estimate("sketch").alias("n_distinct"), "sketch")


def top_hosts(occurrences: DataFrame, k: int) -> DataFrame:
    """The ``k`` hosts with the most URLs, ties by name."""
    return occurrences.withColumn("host", U.host(F.col("decoded"))).filter("host <> ''").groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(k)
