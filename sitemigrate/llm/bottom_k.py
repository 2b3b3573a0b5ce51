"""Near-duplicates by exact Jaccard similarity, candidates from bottom-k sketches of one hash function.

A document's set is its distinct word shingles; its sketch, the k smallest of their hashes. Of the k smallest hashes of two
sets' union, each lies in both sets with the probability of their similarity; so sets that are 0.8 alike share at least
``LEAST`` retained values but for one pair in a thousand million, and sets of 51 shingles or fewer, whose sketches are
whole, share 0.8 of them for certain.

1. Equal sets become one class. Inverted lists of retained values count in how many classes each value stands. A class with
   too few shared values has no partner. All others go into the lists of their rarest values only, so many that two alike
   classes meet in one (shared values beyond these are too few).
2. Nothing pairs up a list's members. Each list has a pivot, the member whose hashes are the most common ones on average
   (of a family of copies, the text that the others were made from); its members are compared with it: by the sketch of the
   union first, then by their whole sets.
3. What may be left are links between members of different components. A class stays open if enough of its hashes stand in
   other components; how many do bounds the sizes of its partners. Open classes meet in lists of their rarest such hashes,
   by size: again with a pivot from another component as long as that merges components, then each with every member that
   the bounds allow. Near copies of one text are one component by then, and those changed too much for any link fail the
   bounds, as their changed hashes stand nowhere else.

The candidates grow with the lists' members, not with the square of a list: only the last step looks at pairs, of different
components, mutually possible by size and shared hashes. Each step is a join or an aggregation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemigrate.llm.common import materialize, window_hashes, word_hashes
from sitemigrate.llm.simhash import components


SHINGLE = 4
K = 64
#: Retained values that two sets of similarity 0.8 share, but for one pair in 10 ** 9.
LEAST = next(t for t in range(K) if sum(math.comb(K, i) * 0.8**i * 0.2 ** (K - i) for i in range(t + 1)) > 1e-9)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles, as signed numbers."""
    hashes = word_hashes((text or "").encode().translate(_LOWER))[2]
    if not len(hashes):
        return np.zeros(0, np.int64)
    return np.unique(window_hashes(hashes, min(size, len(hashes))).view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x.as_py()) for x in batch.column(2)]
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists([s[:K] for s in sets])]
        yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n", "key", "sketch"])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rows]))), pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingle_sets(texts: pa.Array) -> pa.Array:
    return _lists([shingle_set(x.as_py()) for x in texts])


def _least(n: Column) -> Column:
    """How many retained values a set of ``n`` shares with any that is alike."""
    return F.when(n <= 4 * K // 5, F.ceil(4 * n / 5)).otherwise(F.lit(LEAST)).cast("int")


def _may_link(a: Column, b: Column) -> Column:
    """Whether the sketch of two sets' union lets them be 0.8 alike; ``a`` and ``b`` are the sets, sorted."""
    a, b = F.slice(a, 1, K), F.slice(b, 1, K)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    both = F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(union, -1)))
    return F.when(F.size(union) < K, 5 * both >= 4 * F.size(union)).otherwise(both >= LEAST)


def _linked(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of ``n`` and ``m`` that share so many are 0.8 alike: 100 * intersection >= 80 * union, in whole numbers."""
    return 9 * shared >= 4 * (n + m)


def _rarest(values: Column, must_share: Column) -> Column:
    """Of (frequency, value) structs, the values that sets sharing ``must_share`` of them must meet in."""
    return F.transform(F.slice(F.sort_array(values), F.lit(1), F.size(values) - must_share + 1), lambda x: x["v"])


def classes_of(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text_hash, n, key) and classes of equal sets that aren't empty: (cls, key, id, text_hash, n, sketch)."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    own = materialize(spark, read.mapInArrow(_sketches, f"id {kind}, text_hash bigint, n bigint, key binary, sketch array<bigint>"), "sketches")
    one = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")).alias("one")
    classes = own.filter("n > 0").groupBy("key").agg(one, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = classes.select(F.monotonically_increasing_id().alias("cls"), "key", "one.id", "one.text_hash", "n", "sketch")
    return own.drop("sketch"), materialize(spark, classes, "classes")


def _sharing(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """Classes with enough shared values: (cls, n, shared: their values, by rarity, list: those that meet)."""
    postings = classes.select("cls", F.explode("sketch").alias("v"))
    counts = postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    by_class = postings.join(counts, "v").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"))
    found = by_class.join(classes.select("cls", "n"), "cls").withColumn("least", _least(F.col("n"))).filter(F.size("values") >= F.col("least"))
    return materialize(spark, found.select("cls", "n", F.transform("values", lambda x: x["v"]).alias("shared"), _rarest(F.col("values"), F.col("least")).alias("list")), "sharing")


def _cores(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(cls, n, core): how common a set's hashes are among the sets, the mean logarithm of their counts.

    Sets too many of whose hashes stand nowhere else can't have a partner and are left out.
    """
    postings = sets.select("cls", F.explode("set").alias("v"))
    counts = postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    common = postings.join(counts, "v").groupBy("cls").agg(F.count("*").alias("common"), F.sum(F.log("df")).alias("weight"))
    rows = common.join(sets.select("cls", F.size("set").alias("n")), "cls").filter(5 * F.col("common") >= 4 * F.col("n"))
    return materialize(spark, rows.select("cls", "n", (F.col("weight") / F.col("n")).alias("core")), "cores")


def _sets(spark: SparkSession, docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, set) of the classes ``wanted`` (cls, id, text_hash): texts meet their class's first row, and are shingled again."""
    texts = docs.select(F.col(id_col).alias("of"), F.xxhash64(text_col).alias("hash_of"), F.col(text_col).alias("text"))
    met = texts.join(wanted, texts["of"].eqNullSafe(wanted["id"]) & (texts["hash_of"] == wanted["text_hash"])).select("cls", _shingle_sets(F.col("text")).alias("set"))
    return materialize(spark, met.dropDuplicates(["cls"]), "sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, p) pairs with both sets."""
    x, p = sets.select(F.col("cls").alias("x"), F.col("set").alias("set_x")), sets.select(F.col("cls").alias("p"), F.col("set").alias("set_p"))
    return pairs.join(x, "x").join(p, "p")


def _pivots(lists: DataFrame) -> DataFrame:
    """(v, p): the pivot of each list (v, x, core) of two members or more."""
    of = lists.groupBy("v").agg(F.max_by("x", F.struct("core", -F.col("x"))).alias("p"), F.count("*").alias("df"))
    return of.filter("df > 1").drop("df")


def _verified(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) among pairs (x, p): by the sketch of the union, then by the whole sets."""
    both = _with_sets(materialize(spark, pairs, "pairs"), sets)
    sure = both.filter(_may_link(F.col("set_x"), F.col("set_p"))).filter(_linked(F.size(F.array_intersect("set_x", "set_p")), F.size("set_x"), F.size("set_p")))
    return materialize(spark, sure.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct(), "links")


def _size_class(n: Column) -> Column:
    return F.when(n < 32, n).otherwise(F.floor(F.log(n) * 16)).cast("int")


def _open_lists(spark: SparkSession, sharing: DataFrame, cores: DataFrame, sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of hashes where components may meet: probes and entries (v, z, x, comp, core, n, most, left).

    Entries are the smaller partners, by their size class z; probes ask for partners no larger than themselves. ``most`` is
    the largest size of a partner, by the hashes that stand in other components; ``left`` counts those hashes from this one
    on, by rarity, so that partners who first meet here share no more than that.
    """
    named = lambda df: df.join(labels.select(F.col("v").alias("x"), "label"), "x", "left").withColumn("comp", F.coalesce("label", "x")).drop("label")
    mixed = lambda df: df.groupBy("v").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("v", "df")
    known = cores.select(F.col("cls").alias("x"), "n", "core")
    values = named(sharing.select(F.col("cls").alias("x"), F.explode("shared").alias("v")).join(known, "x"))
    opened = values.join(mixed(values), "v").groupBy("x", "n", "core", "comp").agg(F.count("*").alias("o")).filter(F.col("o") >= _least(F.col("n")))
    hashes = materialize(spark, opened.join(sets.withColumnRenamed("cls", "x"), "x").select("x", "n", "core", "comp", F.explode("set").alias("v")), "hashes")
    held = hashes.join(mixed(hashes), "v").groupBy("x", "n", "core", "comp").agg(F.collect_list(F.struct("df", "v")).alias("values"))
    must = F.ceil(4 * F.col("n") / 5).cast("int")
    held = held.filter(F.size("values") >= must).withColumn("most", F.floor(9 * F.size("values") / 4).cast("long") - F.col("n"))
    placed = held.select("x", "n", "core", "comp", "most", F.size("values").alias("o"), F.posexplode(_rarest(F.col("values"), must)).alias("at", "v"))
    rows = materialize(spark, placed.withColumn("left", F.col("o") - F.col("at")).drop("o", "at"), "open")
    entries = rows.filter("most >= n").withColumn("z", _size_class(F.col("n")))
    sizes = F.sequence(_size_class(F.ceil(4 * F.col("n") / 5)), _size_class(F.least("n", "most")))
    probes = rows.filter(5 * F.col("most") >= 4 * F.col("n")).withColumn("z", F.explode(sizes))
    return probes, entries


def _link_rest(spark: SparkSession, sharing: DataFrame, cores: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(v, label): components over ``links`` (a, b) and all links between those."""
    labels = components(spark, links)
    possible = (F.col("n_p") <= F.least("n", "most")) & (5 * F.col("n_p") >= 4 * F.col("n")) & (F.col("n") <= F.col("most_p"))
    possible &= _linked(F.least("left", "left_p"), F.col("n"), F.col("n_p"))
    while True:
        probes, entries = _open_lists(spark, sharing, cores, sets, labels)
        best = entries.groupBy("v", "z", "comp").agg(F.max_by("x", F.struct("core", -F.col("x"))).alias("p"))  # summed up before the shuffle
        ends = best.groupBy("v", "z").agg(F.min(F.struct("comp", "p")).alias("lo"), F.max(F.struct("comp", "p")).alias("hi"))
        tops = ends.select("v", "z", F.col("lo.comp").alias("lo"), F.col("lo.p").alias("p_lo"), F.col("hi.comp").alias("hi"), F.col("hi.p").alias("p_hi"))
        meeting = probes.join(tops, ["v", "z"]).filter("lo < hi OR lo <> comp").withColumn("p", F.when(F.col("lo") != F.col("comp"), F.col("p_lo")).otherwise(F.col("p_hi")))
        meeting = materialize(spark, meeting.select("v", "z", "x", "comp", "n", "most", "p"), "meeting")
        new = _verified(spark, meeting.select("x", "p").distinct(), sets)
        merged = new.count()
        if merged:
            links = materialize(spark, links.unionByName(new), "links")
            labels = components(spark, links)
        if 100 * merged <= meeting.select("x").distinct().count():  # few are left to merge
            break
    probes, entries = _open_lists(spark, sharing, cores, sets, labels)
    tops = entries.groupBy("v", "z").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    probes = probes.drop("core").join(tops, ["v", "z"]).filter("lo < hi OR lo <> comp")
    pairs = probes.join(entries.select("v", "z", F.col("x").alias("p"), F.col("comp").alias("comp_p"), F.col("n").alias("n_p"), F.col("most").alias("most_p"), F.col("left").alias("left_p")), ["v", "z"])
    new = _verified(spark, pairs.filter("comp <> comp_p").filter(possible).select("x", "p").distinct(), sets)
    return components(spark, links.unionByName(new)) if new.take(1) else labels


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles`` and ``component_id`` (the smallest id reachable over links).

    A text of fewer words than a shingle is one shingle; a null or blank text has no shingles and is linked with nothing, so
    its component is its own id. Rows that repeat an id are documents of their own. Null ids take part and are the smallest
    of a component only if it has no other. Other columns aren't read.
    """
    own, classes = classes_of(spark, docs, id_col, text_col)
    sharing = _sharing(spark, classes)
    postings = sharing.select("cls", F.explode("list").alias("v"))
    met = postings.join(postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "v").select("cls").distinct()
    sets = _sets(spark, docs, classes.select("cls", "id", "text_hash").join(met, "cls"), id_col, text_col)
    cores = _cores(spark, sets)
    lists = postings.join(cores, "cls").select("v", F.col("cls").alias("x"), "core")
    pairs = lists.join(_pivots(lists), "v").filter("x <> p").select("x", "p").distinct()
    labels = _link_rest(spark, sharing, cores, sets, _verified(spark, pairs, sets))
    of = materialize(spark, classes.select("cls", "key", "id").join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")).select("key", "id", "label"), "labelled")
    least = materialize(spark, of.groupBy("label").agg(F.min("id").alias("component_id")), "least")
    named = materialize(spark, of.join(least, "label").select(F.col("key").alias("of"), "component_id"), "named")
    full = own.filter("n > 0").join(named, F.col("key") == F.col("of")).select("id", "n", "component_id")
    rows = full.unionByName(own.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids to keep: those that are the smallest of their component, and null ids of components without another."""
    return near_duplicates(spark, docs, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col).distinct()
