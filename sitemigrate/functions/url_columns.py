"""URL expressions: parts, containment below a base, and rebasing, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#:]*)(?::(\d+))?)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"


def part(url: Column, n: int) -> Column:
    """Part of a URL: 1 scheme, 2 host, 3 port, 4 path, 5 query with ``?``, 6 fragment with ``#``; empty if absent."""
    return F.regexp_extract(url, PATTERN, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def decoded_path(url: Column) -> Column:
    path = part(url, 4)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.when(path.contains("%"), decoded).otherwise(path)


def with_scheme(url: Column, default: Column | str) -> Column:
    """A URL with a scheme in front where it begins with slashes or a host."""
    s = F.lit(default) if isinstance(default, str) else default
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), url).when(url.startswith("//"), F.concat(s, F.lit(":"), url)).otherwise(F.concat(s, F.lit("://"), url))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments taken away."""
    segments = F.split(F.substr(path, F.lit(2)), "/")

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(ends, "/"))).otherwise(path)


def resolve(url: Column, base: Column) -> Column:
    """A URL without scheme and host, read against ``base``: absolute, relative to the base's folder, or a query alone.

    Null for an empty URL or a fragment alone, which name the page they stand on.
    """
    path, base_path = part(url, 4), F.coalesce(F.nullif(part(base, 4), F.lit("")), F.lit("/"))
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    whole = F.when(path.startswith("/"), path).when(path == "", base_path).otherwise(F.concat(folder, path))
    origin = F.concat(scheme(base), F.lit("://"), part(base, 2), F.when(part(base, 3) != "", F.concat(F.lit(":"), part(base, 3))).otherwise(F.lit("")))
    return F.when((url != "") & ~url.startswith("#"), F.concat(origin, without_dots(whole), part(url, 5), part(url, 6)))


def is_child_url(url: Column, base: Column, same_host: Column | None = None) -> Column:
    """Same scheme and host (the port doesn't matter), and a path equal to the base's or below it.

    ``same_host`` replaces the comparison of hosts as they are written.
    """
    path, base_path = F.rtrim(decoded_path(url), F.lit("/")), F.rtrim(decoded_path(base), F.lit("/"))
    below = (path == base_path) | F.startswith(path, F.concat(base_path, F.lit("/")))
    same_host = (host(url) != "") & (host(url) == host(base)) if same_host is None else same_host
    return F.coalesce(same_host & (scheme(url) == scheme(base)) & below, F.lit(False))


def path_pattern(base: Column) -> Column:
    """A pattern for the base's decoded path at the start of a path in which any character may be percent-encoded."""
    letters = F.filter(F.split(F.rtrim(decoded_path(base), F.lit("/")), ""), lambda c: c != "")
    one = lambda c: F.concat(F.lit(r"(?:\Q"), c, F.lit(r"\E|(?i:"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"), F.lit("))"))
    return F.concat(F.lit("^"), F.array_join(F.transform(letters, one), ""))


def rebase_url(url: Column, base: Column, target: Column, relative: Column | None = None, same_host: Column | None = None) -> Column:
    """A URL below ``base`` moved below ``target``; null if it isn't below.

    Scheme, host and port become the target's, its path takes the place of the base's, and what follows keeps its own
    encoding. A URL without a trailing slash, query or fragment gets no slash. Where ``relative`` holds, only path, query and
    fragment are given.
    """
    path, query, fragment = part(url, 4), part(url, 5), part(url, 6)
    rest = F.ltrim(F.regexp_replace(path, path_pattern(base), F.lit("")), F.lit("/"))
    moved = F.concat(F.rtrim(part(target, 4), F.lit("/")), F.lit("/"), rest)
    bare = ~path.endswith("/") & (query == "") & (fragment == "")
    moved = F.when(bare, F.rtrim(moved, F.lit("/"))).otherwise(moved)
    port = F.when(part(target, 3) != "", F.concat(F.lit(":"), part(target, 3))).otherwise(F.lit(""))
    origin = F.concat(scheme(target), F.lit("://"), part(target, 2), port)
    if relative is not None:
        origin = F.when(relative, F.lit("")).otherwise(origin)
        moved = F.when(relative & (moved == ""), F.lit("/")).otherwise(moved)
    return F.when(is_child_url(url, base, same_host), F.concat(origin, moved, query, fragment))
