"""URL occurrences in one piece of HTML with block comments, with their places in code points."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator, Mapping

import regex

#: Attributes that hold URLs, by tag.
URL_ATTRIBUTES = {
    "a": ["href"], "applet": ["codebase", "archive"], "area": ["href"], "audio": ["src"], "base": ["href"], "blockquote": ["cite"], "body": ["background"], "button": ["formaction"],
    "command": ["icon"], "del": ["cite"], "embed": ["src"], "form": ["action"], "frame": ["longdesc", "src"], "head": ["profile"], "html": ["manifest"], "iframe": ["longdesc", "src"],
    "image": ["href"], "img": ["longdesc", "src", "usemap", "lowsrc", "highsrc"], "input": ["src", "usemap", "formaction"], "ins": ["cite"], "link": ["href"], "object": ["classid", "codebase", "data", "usemap"],
    "q": ["cite"], "script": ["src"], "source": ["src"], "track": ["src"], "video": ["poster", "src"],
}
#: Block attributes that may hold relative URLs, by block.
BLOCK_ATTRIBUTES = {
    "wp:button": ["url", "linkTarget"], "wp:cover": ["url"], "wp:embed": ["url"], "wp:gallery": ["url", "fullUrl"], "wp:image": ["url", "src", "href"],
    "wp:media-text": ["mediaUrl", "href"], "wp:navigation-link": ["url"], "wp:navigation-submenu": ["url"], "wp:rss": ["feedURL"],
}

_TOKEN = re.compile(r"<!--(?P<comment>.*?)-->|<(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</[^>]*>", re.S)
_RAW_TEXT = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title")}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_BLOCK = re.compile(r"^\s*(wp:[A-Za-z0-9_-]+)\s+(\{.*\})\s*/?\s*$", re.S)
_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_CSS = re.compile(r"/\*.*?(?:\*/|$)|url\(\s*(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|((?:[^\s\"'()\\]|\\[0-9A-Fa-f]{1,6}\s?|\\.)*))\s*\)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S | re.I)
_CSS_ESCAPE = re.compile(r"\\(?:([0-9A-Fa-f]{1,6})\s?|(.))", re.S)
_HOST = r"(?:[^\W_]|[%\-]|[^\x00-\x7F\s\p{P}\p{Sm}\p{Sc}\p{Sk}])+"  # signs such as emoji may stand in international hosts
_TEXT_URL = regex.compile(rf"(?<![\w@/.:%-])(?:(?P<scheme>https?)://|(?P<slashes>//))?(?P<host>{_HOST}(?:\.{_HOST})*)(?P<port>:\d{{1,5}}(?!\d))?(?P<path>[/?#][^\s<>]*)?", regex.I)
_WORD = regex.compile(r"\S+")
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_CREDENTIALS = re.compile(r":[^\s/?#@]*@")
#: Characters that end no URL.
_BAD_END = "({[`!;:'\".,?«»“”‘’"


def css_unescape(text: str) -> str:
    return _CSS_ESCAPE.sub(lambda m: (chr(int(m[1], 16)) if m[1] and 0 < int(m[1], 16) < 0x110000 else "\ufffd") if m[1] else m[2].replace("\n", ""), text)


def css_urls(css: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, URL) of each ``url(...)`` outside comments and strings, data URIs left out."""
    for m in _CSS.finditer(css):
        if m[0][:4].lower() == "url(":
            url = css_unescape(next(g for g in m.groups() if g is not None))
            if url and not url.lower().startswith("data:"):
                yield m.start(), m.end(), url


def text_urls(text: str) -> Iterator[tuple[int, int, str, str | None]]:
    """(start, end, URL, top-level domain to check) of URLs in plain text; the domain is None where a scheme is given.

    Without scheme or slashes, a host needs a dot and a known domain. A path goes on to a blank or angle bracket and ends in
    no punctuation; one trailing bracket or full stop is left out. A host with credentials, or before two colons, is none.
    """
    for word in _WORD.finditer(text):  # no URL spans a blank, and one without slashes needs a dot
        if "." in word[0] or "//" in word[0]:
            yield from _word_urls(text, word.start(), word.end())


def _word_urls(text: str, start: int, stop: int) -> Iterator[tuple[int, int, str, str | None]]:
    for m in _TEXT_URL.finditer(text, start, stop):
        end = m.end()
        while end > m.end("host") and text[end - 1] in _BAD_END and (m["path"] is not None):
            end -= 1
        url = text[m.start() : end]
        if url[-1:] in (")", "."):
            url, end = url[:-1], end - 1
        if text[end : end + 1] == "@" or text[end : end + 2] == "::" or _CREDENTIALS.match(text, m.end("host")):
            continue
        tld = None
        if not m["scheme"] and not m["slashes"]:
            tld = m["host"].rpartition(".")[2].lower() if "." in m["host"].strip(".") else ""
            if not tld or tld.isdigit():
                continue
        yield m.start(), end, url, tld


def occurrences(markup: str, block_attributes: Mapping[str, list[str]] = BLOCK_ATTRIBUTES) -> Iterator[tuple[str, int, int, str, str, str | None]]:
    """(kind, start, end, raw, decoded, domain to check), in order of place. Kinds: attr, style, block, text.

    ``start`` to ``end`` is what a new URL replaces: an attribute's value, ``url(...)``, a JSON string with its quotes, or
    the URL in a text.
    """
    at, length = 0, len(markup)
    while at < length:
        m = _TOKEN.search(markup, at)
        yield from _in_text(markup, at, m.start() if m else length)
        if not m:
            return
        at = m.end()
        if m["comment"] is not None:
            yield from _in_block(m["comment"], m.start("comment"), block_attributes)
        elif m["tag"]:
            tag = m["tag"].lower()
            yield from _in_tag(tag, m["attrs"], m.start("attrs"))
            if tag in _RAW_TEXT:
                close = _RAW_TEXT[tag].search(markup, at)
                at = close.start() if close else length


def _decoded(raw: str) -> tuple[str, list[int] | range]:
    """A raw piece with its character references decoded, and for each place of the result one in the raw piece."""
    if "&" not in raw:
        return raw, range(len(raw) + 1)
    text, places, at = [], [], 0
    for m in _REFERENCE.finditer(raw):
        char = html.unescape(m[0])
        text += [raw[at : m.start()], char]
        places += [*range(at, m.start()), *[m.start()] * len(char)]
        at = m.end()
    return "".join([*text, raw[at:]]), [*places, *range(at, len(raw) + 1)]


def _in_text(markup: str, start: int, end: int) -> Iterator[tuple]:
    raw = markup[start:end]
    if "." not in raw and "//" not in raw and "&" not in raw:
        return
    text, places = _decoded(raw)
    for a, b, url, tld in text_urls(text):
        lo, hi = places[a], places[b]
        yield "text", start + lo, start + hi, raw[lo:hi], url, tld


def _in_block(comment: str, start: int, block_attributes: Mapping[str, list[str]]) -> Iterator[tuple]:
    m = _BLOCK.match(comment)
    if not m:
        return
    try:
        attributes = json.loads(m[2])
    except ValueError:
        return
    known, depth, name, at = block_attributes.get(m[1], []), 0, None, m.start(2)
    for token in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]', m[2], re.S):
        t = token[0]
        if t in "{[":
            depth += 1
        elif t in "}]":
            depth -= 1
        elif t == "," and depth == 1:
            name = None
        elif t[0] == '"' and depth == 1:
            if name is None:
                name = json.loads(t)
            elif isinstance(attributes.get(name), str):
                url = json.loads(t)
                absolute = re.match(r"(?:https?:)?//", url, re.I)
                if url and (absolute or name in known):
                    yield "block", start + at + token.start(), start + at + token.end(), t, url, None


def _in_tag(tag: str, attrs: str, start: int) -> Iterator[tuple]:
    wanted, seen = URL_ATTRIBUTES.get(tag, []), set()
    for m in _ATTRIBUTE.finditer(attrs):
        name = m[1].lower()
        group = next((g for g in (2, 3, 4) if m[g] is not None), None)
        if name in seen or group is None:
            continue
        seen.add(name)
        raw = m[group]
        if name == "style":
            css, places = _decoded(raw)
            for a, b, url in css_urls(css):
                lo, hi = places[a], places[b]
                yield "style", start + m.start(group) + lo, start + m.start(group) + hi, raw[lo:hi], url, None
        elif name in wanted and raw.strip():
            yield "attr", start + m.start(group), start + m.end(group), raw, html.unescape(raw).strip(), None
