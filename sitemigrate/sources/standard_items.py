"""Items in the form that nearly all exports have, read by Spark's own XML function, without a Python worker.

Spark's function knows no namespaces, gives elements of white space alone as null and reads numbers by rules of its own.
So an item goes this way only if none of that can matter: its file's root tag declares the usual prefixes, its tags use
those alone, texts hold no elements, and numbers are plain. Everything else is for ``item_xml.parse_item``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemigrate import schema
from sitemigrate.functions import item_xml

CONTAINERS = "wp:(?:postmeta|commentmeta|comment)"
NUMBERS = "wp:(?:post_id|post_parent|menu_order|is_sticky|comment_id|comment_user_id)"

#: An item is cut down before it is looked at: CDATA sections (but numbers) become a letter, then texts (but numbers), so that
#: only tags are left, however long the texts are.
CDATA_TEXT = r"(?s)<!\[CDATA\[(?![+-]?[0-9]{1,18}\]\]>).*?\]\]>"
CDATA_NUMBER = r"<!\[CDATA\[([^\]]*)\]\]>"
TEXT = r">(?![+-]?[0-9]{1,18}</)\s*+[^<\]\s][^<\]]*+"
#: References other than these are unusual, wherever they stand outside of CDATA sections.
REFERENCE = r"&(?!(?:amp|lt|gt|quot|apos|#9|#10|#13);)"
#: An item in whose skeleton one of these is found isn't in the usual form.
UNUSUAL = {
    "declarations, instructions, namespaces, ends of sections": r"<!|<\?|xmlns|\]\]>",
    "tags with angle brackets or odd quotes in attributes": r"""<(?![^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+>)""",
    "names with other prefixes, or very long ones": r"</?+(?!(?:(?:wp|content|excerpt|dc):)?[A-Za-z_][A-Za-z0-9_]{0,200}[\s/>])",
    "attributes with prefixes": r"<[^<>]*\s[^<>\s=:\"']*:[^<>\s=\"']*\s*=",
    "elements of white space alone": r"<[^/<>][^<>]*>\s+</",
    "elements within texts": rf"<(?!/|item[\s>]|{CONTAINERS}[\s>])[^<>]*[^<>/]>[^<]*<(?!/)",
    "empty groups": rf"<{CONTAINERS}(?:\s[^<>]*)?(?:/>|></)",
    "numbers that aren't plain": rf"<{NUMBERS}(?:\s[^<>]*[^<>/])?>(?!(?:[+-]?[0-9]{{1,18}})?</)",
    "anything but one item": r"</item|<item[\s/>].*<item[\s/>]|^(?!<item[\s>])",
}

_META = "array<struct<`wp:meta_key`:string,`wp:meta_value`:string>>"
_COMMENT = ",".join([*(f"`wp:{tag}`:string" for tag in item_xml.COMMENT_TEXT), "`wp:comment_id`:string", "`wp:comment_user_id`:string", f"`wp:commentmeta`:{_META}"])
#: Element of each text or number of an item.
ELEMENTS = {
    **{column: tag for tag, column in item_xml.PLAIN.items()}, **{column: f"wp:{tag}" for tag, column in item_xml.WP_TEXT.items()}, **{c: f"wp:{c}" for c in schema.POST_NUMBERS},
    "post_author": "dc:creator", "post_content": "content:encoded", "post_excerpt": "excerpt:encoded",
}
BROKEN = "__broken"
XML = ", ".join([
    *(f"`{tag}` string" for tag in ELEMENTS.values()), "category array<struct<_VALUE:string,_domain:string,_nicename:string>>",
    f"`wp:postmeta` {_META}", f"`wp:comment` array<struct<{_COMMENT}>>", f"{BROKEN} string",
])
OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}


def usual_root(root_tag: Column) -> Column:
    """Whether a root tag gives the usual prefixes their namespaces, and no other element a namespace; null is the writer's own."""
    attribute = r"""\s+(?:version|xmlns:[a-z0-9]+)\s*=\s*(?:"[^"<>&]+"|'[^'<>&]+')"""
    own = r"https?://[^/?#\"']+/export/1\.[012]/"
    wanted = {"wp": own, "excerpt": own + "excerpt/", "content": item_xml.CONTENT.replace(".", r"\."), "dc": item_xml.DC.replace(".", r"\.")}
    ok = root_tag.rlike(rf"^<rss(?:{attribute})+\s*>$")
    for prefix, uri in wanted.items():
        ok = ok & root_tag.rlike(rf"""xmlns:{prefix}\s*=\s*["']{uri}["']""")
    read = F.from_xml(F.concat(root_tag, F.lit("</rss>")), f"version string, {BROKEN} string", OPTIONS)  # an attribute given twice
    return root_tag.isNull() | (ok & read[BROKEN].isNull())


def usual_item(item: Column) -> Column:
    """Whether an item (without its end tag) is in the usual form; it may still be broken XML."""
    outside = F.regexp_replace(item, CDATA_TEXT, "c")
    tags = F.regexp_replace(F.regexp_replace(outside, TEXT, ">t"), CDATA_NUMBER, "$1")
    odd = F.contains(item, F.lit("\ufffe")) | F.contains(item, F.lit("\uffff")) | outside.rlike(REFERENCE)
    return ~(odd | tags.rlike("(?s)" + "|".join(f"(?:{p})" for p in UNUSUAL.values())))


def read(item: Column) -> Column:
    """Elements of an item in the usual form; ``BROKEN`` is set, and all else null, if it isn't XML."""
    return F.from_xml(F.concat(item, F.lit("</item>")), XML, OPTIONS)


def item_columns(x: Column) -> dict[str, Column]:
    """The columns of ``schema.ITEM`` of what ``read`` gives."""
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    some = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    meta = lambda c: some(F.transform(c, lambda m: F.struct(m["wp:meta_key"].alias("key"), m["wp:meta_value"].alias("value"))), schema.META)
    out = {column: number(x[tag]) if column in schema.POST_NUMBERS else x[tag] for column, tag in ELEMENTS.items()}
    terms = F.transform(F.filter(x["category"], lambda t: t["_nicename"].isNotNull()), lambda t: F.struct(F.coalesce(t["_VALUE"], F.lit("")).alias("name"), t["_nicename"].alias("slug"), t["_domain"].alias("domain")))

    def comment(c: Column) -> Column:
        texts = [c[f"wp:{tag}"].alias(name) for tag, name in item_xml.COMMENT_TEXT.items()]
        return F.struct(number(c["wp:comment_id"]).alias("comment_id"), *texts, number(c["wp:comment_user_id"]).alias("user_id"), meta(c["wp:commentmeta"]).alias("commentmeta"))

    comments = F.transform(x["wp:comment"], comment)
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return out | {"terms": some(terms, schema.TERM_REFS), "postmeta": meta(x["wp:postmeta"]), "comments": some(comments, schema.COMMENTS), "failed_casts": none, "error": F.lit(None).cast("string")}
