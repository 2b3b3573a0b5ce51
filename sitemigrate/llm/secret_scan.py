"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models of random strings.

Two first-order models give the likelihood of each next character: one of random strings, one of ordinary identifiers.
A long run of token characters that no fixed pattern covers is a secret when random text explains it better by
``min_ratio`` (a difference of natural logarithms). The models are counted from labelled strings of a bounded sample of
documents (``sample_docs``): what the fixed patterns find is random, words are ordinary; the random model starts from
a uniform prior, so that it works without any examples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemigrate.llm.common import free_name, hash_sample

#: The patterns, and the least length of what counts (for assign of group 2, else of the match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = [("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16)]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="


def _found(text: Column, pattern: str, group: int, least: int, order: int) -> Column:
    """Spans (start, kind, end, value) of a pattern's leftmost matches whose group has ``least`` characters.

    The pieces between matches and the matches, in turn, give the places. Runs of one class (``X+``, or a head and
    ``X+``) match the same places when the length is asked for in the pattern, so short runs need not be listed.
    """
    search = {HEX: r"[0-9a-f]{16,}", ACCESS: r"AKIA[A-Z0-9]{14,}"}.get(pattern, pattern)
    pieces = F.arrays_zip(F.split(text, search, -1).alias("gap"), F.regexp_extract_all(text, F.lit(search), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(search), F.lit(group)).alias("value"))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["all"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), x["value"].alias("value")))
        spans = F.when(F.length(x["value"]) >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(F.coalesce(end, start).cast("int").alias("at"), spans.alias("spans"))

    walked = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(search), walked).otherwise(none)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, sorted by start, then kind."""
    return F.sort_array(F.concat(*(_found(text, p, group, least, i) for i, (_, p, group, least) in enumerate(BASE))))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000, prior: float = 40.0) -> list[float]:
    """Log-likelihood ratios, random against ordinary, for pairs of ASCII characters (index 128 * first + second).

    The sample is the ``sample_docs`` documents with the smallest hashes of their ids and texts. Only counts of pairs, at
    most 2 * 128 * 128 rows, come to the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = hash_sample(rows, ["id", "text"], sample_docs).select("text")
    random = sample.select(F.explode(base_spans(F.col("text"))).alias("x")).select(F.col("x.value").alias("s"), F.lit(True).alias("random"))
    ordinary = sample.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_-]{4,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("s")).select("s", F.lit(False).alias("random"))
    strings = random.unionByName(ordinary).distinct()
    pairs = strings.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda i: F.substring("s", i, 2))).alias("pair"))
    rows = pairs.filter(F.length("pair") == 2).groupBy("random", "pair").count().collect()
    count = {(r["random"], r["pair"]): r["count"] for r in rows}
    out = [0.0] * (128 * 128)
    for a in ALPHABET:
        total = {kind: sum(count.get((kind, a + b), 0) for b in ALPHABET) for kind in (True, False)}
        for b in ALPHABET:
            p = {kind: (count.get((kind, a + b), 0) + weight / len(ALPHABET)) / (total[kind] + weight) for kind, weight in ((True, prior), (False, prior / 4))}
            out[128 * ord(a) + ord(b)] = math.log(p[True] / p[False])
    return out


def _markov_spans(text: Column, base: Column, ratios: list[float], min_ratio: float) -> Column:
    """Candidate runs outside ``base`` spans for which the ratios of their pairs add up to ``min_ratio`` or more."""
    table = F.transform(F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ","), lambda x: x.cast("double"))

    def ratio(s: Column) -> Column:
        codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(table, a * 128 + b + 1))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))

    free = F.filter(_found(text, CANDIDATE, 0, 20, len(BASE)), lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return F.filter(free, lambda x: ratio(x["value"]) >= min_ratio)


def _with_spans(docs: DataFrame, ratios: list[float], text_col: str, min_ratio: float) -> tuple[DataFrame, str, str, str]:
    """``docs`` with the text (null: empty), the fixed patterns' spans and all spans (by start, then kind), and their names."""
    text, base, more, every = (free_name(docs, name) for name in ("text_of", "base_of", "more_of", "all_of"))
    out = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn(base, base_spans(F.col(text)))
    out = out.withColumn(more, _markov_spans(F.col(text), F.col(base), ratios, min_ratio))
    return out.withColumn(every, F.sort_array(F.concat(base, more))), text, base, every


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k, *_ in BASE), F.lit("markov"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text", min_ratio: float = 12.0) -> DataFrame:
    """One row per input row: id, ``n_assign``, ``n_access``, ``n_hex``, ``n_markov``, ``base_spans``, ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind, joined with commas. A null text is
    empty; null ids and repeated rows stay; other columns are not read.
    """
    found, _, base, every = _with_spans(docs.select(F.col(id_col), F.col(text_col)), ratios, text_col, min_ratio)
    kinds = F.transform(every, lambda x: x["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate([k for k, *_ in BASE] + ["markov"])]
    return found.select(F.col(id_col), *n, _listed(F.col(base)).alias("base_spans"), _listed(F.col(every)).alias("spans"))


def redact(docs: DataFrame, ratios: list[float], text_col: str = "text", mask: str = "[SECRET]", min_ratio: float = 12.0) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mask``, overlapping spans by one; null texts stay null.

    Where a span starts behind the ends of all before it, a gap and a mask are written; the pieces are joined once.
    """
    found, own, _, every = _with_spans(docs, ratios, text_col, min_ratio)
    spans = F.col(every)
    ends = F.aggregate(spans, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x["end"]))))
    pieces = F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(own, at + 1, x["start"] - at), F.lit(mask))).otherwise(F.lit("")))
    last = F.element_at(ends, -1)
    text = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), F.substring(own, last + 1, F.length(own)))).otherwise(F.col(text_col))
    return found.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))
