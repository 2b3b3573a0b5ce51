"""Parsing of one export item, or of the channel elements around items, by namespace and local name."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

from sitemigrate import schema

#: The namespaces of the format. Its own differ by host; path and version tell them.
EXPORT = re.compile(r"https?://[^/?#]+/export/1\.[012]/(excerpt/)?")
CONTENT = "http://purl.org/rss/1.0/modules/content/"
DC = "http://purl.org/dc/elements/1.1/"

PLAIN = {"title": "post_title", "guid": "guid", "link": "link", "pubDate": "pub_date"}
WP_TEXT = {c: c for c in ("post_date", "post_date_gmt", "post_modified", "post_modified_gmt", "comment_status", "ping_status", "post_name", "status", "post_type", "post_password", "attachment_url")}
COMMENT_TEXT = {
    "comment_author": "author", "comment_author_email": "author_email", "comment_author_url": "author_url", "comment_author_IP": "author_ip", "comment_date": "date",
    "comment_date_gmt": "date_gmt", "comment_content": "content", "comment_approved": "approved", "comment_type": "type", "comment_parent": "parent",
}
TERM_TAGS = {
    "category": (0, {"term_id": "term_id", "category_nicename": "slug", "category_parent": "parent_slug", "cat_name": "name", "category_description": "description"}),
    "tag": (1, {"term_id": "term_id", "tag_slug": "slug", "tag_name": "name", "tag_description": "description"}),
    "term": (2, {"term_id": "term_id", "term_taxonomy": "taxonomy", "term_slug": "slug", "term_parent": "parent_slug", "term_name": "name", "term_description": "description"}),
}
LEADING_NUMBER = re.compile(r"\s*([+-]?\d{1,18})")


def _name(element: ET.Element) -> tuple[str, str]:
    """Family ("wp", "excerpt", "content", "dc", "" or "?") and local name."""
    uri, _, local = element.tag.rpartition("}")
    uri = uri[1:]
    own = EXPORT.fullmatch(uri)
    family = "excerpt" if own and own[1] else "wp" if own else "content" if uri == CONTENT else "dc" if uri == DC else "?" if uri else ""
    return family, local


def _text(element: ET.Element) -> str:
    return "".join(element.itertext())


def _number(text: str, column: str, failed: dict[str, str]) -> int:
    """The number a text starts with, else 0; the text is kept where it isn't wholly a number."""
    m = LEADING_NUMBER.match(text)
    if text.strip() and not (m and not text[m.end() :].strip()):
        failed[column] = text
    return int(m[1]) if m else 0


def _meta(element: ET.Element) -> dict[str, str | None]:
    found: dict[str, str | None] = {"key": None, "value": None}
    for child in element:
        family, local = _name(child)
        if family == "wp" and local in ("meta_key", "meta_value"):
            found[local[5:]] = _text(child)
    return found


def _comment(element: ET.Element, failed: dict[str, str]) -> dict:
    row: dict = {"comment_id": 0, "user_id": 0, "commentmeta": []}
    for child in element:
        family, local = _name(child)
        if family != "wp":
            continue
        if local in COMMENT_TEXT:
            row[COMMENT_TEXT[local]] = _text(child)
        elif local in ("comment_id", "comment_user_id"):
            row["comment_id" if local == "comment_id" else "user_id"] = _number(_text(child), local, failed)
        elif local == "commentmeta":
            row["commentmeta"].append(_meta(child))
    return row


def check_plain(xml: str) -> None:
    """Document types and entity declarations are refused, so that no entity can expand."""
    if "<!DOCTYPE" in xml or "<!ENTITY" in xml:
        raise ValueError("document types are refused")


def parse_item(root_tag: str, item: str) -> dict:
    """One item's row; of a repeated element the last counts, an element of a foreign namespace never."""
    check_plain(item)
    root = ET.fromstring(f"{root_tag}<channel>{item}</item></channel></rss>")
    element = root.find("channel/item")
    if element is None:
        raise ValueError("no item")
    row: dict = {"terms": [], "postmeta": [], "comments": [], "post_id": 0, "post_parent": 0, "menu_order": 0, "is_sticky": 0}
    failed: dict[str, str] = {}
    for child in element:
        family, local = _name(child)
        if family == "" and local in PLAIN:
            row[PLAIN[local]] = _text(child)
        elif family == "" and local == "category":
            if child.get("nicename") is not None:
                row["terms"].append({"name": _text(child), "slug": child.get("nicename"), "domain": child.get("domain")})
        elif family == "dc" and local == "creator":
            row["post_author"] = _text(child)
        elif local == "encoded" and family in ("content", "excerpt"):
            row["post_content" if family == "content" else "post_excerpt"] = _text(child)
        elif family == "wp":
            if local in WP_TEXT:
                row[local] = _text(child)
            elif local in schema.POST_NUMBERS:
                row[local] = _number(_text(child), local, failed)
            elif local == "postmeta":
                row["postmeta"].append(_meta(child))
            elif local == "comment":
                row["comments"].append(_comment(child, failed))
    row["failed_casts"] = list(failed.items())
    return row


_CATEGORY = re.compile(r"<category\b([^>]*?)(?:/>|>(.*?)</category>)", re.S)
_NESTED = re.compile(r"<wp:(postmeta|comment)>(.*?)</wp:\1>", re.S)
_COMMENT_META = re.compile(r"<wp:commentmeta>(.*?)</wp:commentmeta>", re.S)


def _tagged(xml: str, tag: str) -> str | None:
    """The text of the first element with this tag: CDATA sections as they are, else with its references decoded."""
    m = re.search(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", xml, re.S)
    return None if m is None else _plain(m[1])


def _plain(body: str) -> str:
    m = re.fullmatch(r"\s*<!\[CDATA\[(.*)\]\]>\s*", body, re.S)
    return m[1].replace("]]]]><![CDATA[>", "]]>") if m else html.unescape(body)


def parse_leniently(item: str) -> dict:
    """One item's row as ``parse_item`` makes it, by tags alone; tags within content are lower-cased, lone breaks closed."""
    nested, failed = _NESTED.findall(item), {}
    outside = _NESTED.sub("", item)
    row: dict = {"terms": [], "postmeta": [], "comments": []}
    row |= {column: _tagged(outside, tag) for tag, column in PLAIN.items()}
    row |= {column: _tagged(outside, f"wp:{tag}") for tag, column in WP_TEXT.items()}
    row |= {column: _number(_tagged(outside, f"wp:{column}") or "", column, failed) for column in schema.POST_NUMBERS}
    row["post_author"] = _tagged(outside, "dc:creator")
    for column, tag in (("post_content", "content:encoded"), ("post_excerpt", "excerpt:encoded")):
        text = _tagged(outside, tag)
        if text is not None:
            text = re.sub(r"</?[A-Z]+", lambda m: m[0].lower(), text)
            text = text.replace("<br>", "<br />").replace("<hr>", "<hr />")
        row[column] = text
    for attributes, body in _CATEGORY.findall(outside):
        own = {k: html.unescape(v) for k, v in re.findall(r'([\w:]+)="([^"]*)"', attributes)}
        if "nicename" in own:
            row["terms"].append({"name": _plain(body), "slug": own["nicename"], "domain": own.get("domain")})
    for tag, body in nested:
        if tag == "postmeta":
            row["postmeta"].append({"key": _tagged(body, "wp:meta_key"), "value": _tagged(body, "wp:meta_value")})
            continue
        meta = [{"key": _tagged(m, "wp:meta_key"), "value": _tagged(m, "wp:meta_value")} for m in _COMMENT_META.findall(body)]
        bare = _COMMENT_META.sub("", body)
        comment = {column: _tagged(bare, f"wp:{t}") for t, column in COMMENT_TEXT.items()}
        ids = {"comment_id": "comment_id", "comment_user_id": "user_id"}
        row["comments"].append(comment | {column: _number(_tagged(bare, f"wp:{t}") or "", t, failed) for t, column in ids.items()} | {"commentmeta": meta})
    row["failed_casts"] = list(failed.items())
    return row


def parse_channel(root_tag: str, xml: str) -> dict:
    """Authors and terms among the channel elements before the first item or after the last one."""
    check_plain(xml)
    root = ET.fromstring(f"{root_tag}<channel>{xml}</channel></rss>")
    authors, terms, failed = [], [], {}
    for ord_, element in enumerate(root.find("channel")):
        family, local = _name(element)
        if family != "wp":
            continue
        texts = {}
        for child in element:
            kind, name = _name(child)
            if kind == "wp":
                texts[name] = _text(child)
        if local in ("author", "wp_author"):
            row = {c: texts.get(c) for c in ("author_login", "author_email", "author_display_name", "author_first_name", "author_last_name")}
            authors.append(row | {"author_id": _number(texts.get("author_id", ""), "author_id", failed)})
        elif local in TERM_TAGS:
            phase, names = TERM_TAGS[local]
            row = {"phase": phase, "ord": ord_, "taxonomy": ("category", "post_tag", None)[phase], "parent_slug": None, "termmeta": []}
            row |= {column: texts.get(tag) for tag, column in names.items() if column != "term_id" and (column != "taxonomy" or tag in texts)}
            row["term_id"] = _number(texts.get("term_id", ""), "term_id", failed)
            row["termmeta"] = [_meta(child) for child in element if _name(child) == ("wp", "termmeta")]
            terms.append(row)
    return {"authors": authors, "terms": terms}
