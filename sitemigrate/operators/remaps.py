"""Remaps of any number applied to texts: strings of an export replaced in turn, each on the result of those before.

A text meets only the remaps that can occur in it. Every remap has an anchor: a run of bytes of its URL, the rarest among
all remaps, so that URLs with long common beginnings are told apart. Texts give the runs that are anchors of any remap, by a
table of bits of a fixed size, and are joined with the remaps by them; no list of all remaps of an export is made.

Remaps that a text meets are applied in order. What a replacement writes, with so much around it as the longest remap
needs, is looked at for anchors again, and remaps that it may have made possible join the others; this ends when none do.
Then no other remap occurs in any text on the way, so the result is that of all remaps in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemigrate.storage import keep

#: Bytes of a run; shorter URLs are their own anchors.
RUN = 8
#: Runs of a URL that may become its anchor, evenly spaced and at its end.
SPACED, LAST = 8, 12
#: Bits of the table that tells texts which runs are anchors; what it lets through wrongly is joined in vain.
FILTER_BITS = 1 << 26
RULE = "struct<n:int,from_url:string,to_url:string>"


def runs(data: bytes, size: int) -> np.ndarray:
    """The hash of each run of ``size`` bytes (at most 8), in order; no two runs of a size share one."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(b) - size + 1)
    run = np.zeros(n, np.uint64)
    for j in range(size):
        run = run << np.uint64(8) | b[j : j + n]
    return _spread(run ^ np.uint64((size * 0x9E3779B97F4A7C15) & (1 << 64) - 1))


def candidates(url: bytes) -> np.ndarray:
    """Runs that may be the anchor of a URL."""
    found = runs(url, min(len(url), RUN))
    return np.unique(np.concatenate((found[:: max(1, len(found) // SPACED)], found[-LAST:])))


def anchors(data: bytes, sizes: list[int], table: np.ndarray) -> np.ndarray:
    """The distinct runs of a text that the table knows."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(_known(runs(data, size), table) for size in sizes)]))


def _spread(x: np.ndarray) -> np.ndarray:
    """Every bit of 64-bit numbers over all others, one to one."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _long_lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rows]))), pa.int32()), pa.array(flat.view(np.int64)))


def _rules(remaps: DataFrame, by: str) -> DataFrame:
    """(of, rule, anchor): each remap with the rarest of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [x.as_py().encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _long_lists([candidates(u) for u in urls])], ["of", "from_url", "to_url", "anchors"])

    named = remaps.filter("from_url <> ''").select(F.col(by).cast("string").alias("of"), "from_url", "to_url").distinct()
    each = named.mapInArrow(run, "of string, from_url string, to_url string, anchors array<bigint>").select("of", "from_url", "to_url", F.explode("anchors").alias("anchor"))
    each = keep(named.sparkSession, each)
    counts = each.groupBy("of", "anchor").agg(F.count("*").alias("n"))
    best = each.join(counts, ["of", "anchor"]).groupBy("of", "from_url", "to_url").agg(F.min(F.struct("n", "anchor")).alias("best"))
    rule = F.struct((-F.length("from_url")).alias("n"), "from_url", "to_url").cast(RULE)
    return keep(named.sparkSession, best.select("of", rule.alias("rule"), F.col("best.anchor").alias("anchor")))


def _filter_of(rules: DataFrame) -> np.ndarray:
    """A table of ``FILTER_BITS`` bits with those of all anchors set; of a fixed size, so it is collected."""
    bit = F.pmod("anchor", F.lit(FILTER_BITS)) + 1  # buckets begin at value 1
    rows = rules.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    width = 4096
    table = np.zeros(FILTER_BITS // 8 + width, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * width
        table[at : at + width] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table


def _known(found: np.ndarray, table: np.ndarray) -> np.ndarray:
    bit = found.view(np.int64) % FILTER_BITS
    return found[(table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]


def fold(text: str, rules: list[dict], longest: int) -> tuple[str, list[str]]:
    """``text`` with ``rules`` applied in turn, and what each replacement wrote with ``longest`` characters on either side."""
    written = []
    for rule in rules:
        old, new = rule["from_url"], rule["to_url"]
        pieces = text.split(old)
        if len(pieces) == 1:
            continue
        text, at = new.join(pieces), 0
        for piece in pieces[:-1]:
            at += len(piece)
            written.append(text[max(0, at - longest) : at + len(new) + longest])
            at += len(new)
    return text, written


def apply_url_remap(docs: DataFrame, remaps: DataFrame, text_col: str, by: str = "export_id") -> DataFrame:
    """``docs`` with all remaps of their export applied to ``text_col``, longest first, each on the result of those before.

    ``remaps``: (``by``, from_url, to_url); empty ``from_url`` never match, of equal ones the smaller ``to_url`` comes first. Null
    texts stay null, rows without remaps stay as they are. An export may have any number of remaps. Texts are told apart
    by their hashes, so rows need no key.
    """
    spark = docs.sparkSession
    rules = _rules(remaps, by)
    facts = rules.agg(F.max(F.octet_length("rule.from_url")).alias("longest"), F.collect_set(F.least(F.octet_length("rule.from_url"), F.lit(RUN))).alias("sizes")).first()
    if facts["longest"] is None:
        return docs
    longest, sizes, known_bits = facts["longest"], sorted(facts["sizes"]), spark.sparkContext.broadcast(_filter_of(rules))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors((x.as_py() or "").encode(), sizes, known_bits.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _long_lists(found)], ["of", "key", "anchors"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [fold(text, sorted(rules, key=lambda r: (r["n"], r["from_url"].encode(), r["to_url"].encode())), longest) for text, rules in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            found = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(anchors(w.encode(), sizes, known_bits.value) for w in written)])) for _, written in done]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([text for text, _ in done], pa.string()), _long_lists(found)], ["of", "key", "text", "rules", "new_text", "anchors"])

    texts = docs.filter(F.col(text_col).isNotNull() & F.col(by).isNotNull()).select(F.col(by).cast("string").alias("of"), F.unhex(F.md5(text_col)).alias("key"), F.col(text_col).alias("text"))
    known = rules.select("of", "anchor", "rule")
    hits = texts.mapInArrow(look, "of string, key binary, anchors array<bigint>").select("of", "key", F.explode("anchors").alias("anchor")).distinct().join(known, ["of", "anchor"])
    lists = hits.groupBy("of", "key").agg(F.collect_set("rule").alias("rules"))
    state = keep(spark, texts.join(lists, ["of", "key"]).dropDuplicates(["of", "key"]).select("of", "key", "text", "rules"))
    while True:
        folded = keep(spark, state.mapInArrow(work, f"of string, key binary, text string, rules array<{RULE}>, new_text string, anchors array<bigint>"))
        more = folded.select("of", "key", "rules", F.explode("anchors").alias("anchor")).join(known, ["of", "anchor"]).filter(~F.array_contains("rules", F.col("rule")))
        more = keep(spark, more.groupBy("of", "key").agg(F.collect_set("rule").alias("more")))
        if not more.take(1):
            break
        state = keep(spark, folded.drop("new_text", "anchors").join(more, ["of", "key"], "left").withColumn("rules", F.array_union("rules", F.coalesce("more", F.array().cast(f"array<{RULE}>")))).drop("more"))
    done = folded.filter("new_text <> text").select(F.col("of").alias("__of"), F.col("key").alias("__key"), F.col("new_text").alias("__new"))
    joined = docs.join(done, (F.col(by).cast("string") == F.col("__of")) & (F.unhex(F.md5(text_col)) == F.col("__key")), "left")
    return joined.withColumn(text_col, F.coalesce("__new", text_col)).select(*docs.columns)
