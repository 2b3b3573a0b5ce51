"""Near-duplicates by SimHash fingerprints that differ in at most three bits, found by meeting in the middle.

Two fingerprints within three bits have variants, each at most one bit from its own, that differ from one another in at
most one bit. So every distinct fingerprint emits all its variants within half the radius (itself and 64 others), and
variants meet. Which bit still differs is unknown, so the 64 places are cut into blocks and a variant is dealt once for
each block by its bits outside that block; variants that differ in one bit meet in the group of the block with that bit.
In a group, fingerprints that emitted the same variant differ in two bits at most, and those whose variants differ in
one bit of the block differ in three at most: all such links hold, and no other pair within three bits is missed. So
a variant's emitters are linked to the smallest of them, and neighbouring variants by their smallest: the links grow with
the variants, never with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemigrate.llm.common import free_name, materialize, n_partitions


RADIUS = 3
#: Variants that meet in one bucket, about; 16 bytes each.
VARIANTS = 1 << 19


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text, as a signed 64-bit number (as Spark's long holds it)."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hash_ = xxhash.xxh64_intdigest
        hashes = np.array([hash_(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)  # zip ends with the last shingle
    n = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)].astype("<u8")
        n += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * n > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(x.as_py()) for x in texts], pa.int64())


def _spread(blocks: int, buckets: int):
    """Deals the variants of fingerprints: rows (bucket, variants and owners as one binary)."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [np.uint64(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1)) for i in range(blocks)]
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                variants = (own[:, None] ^ flips).ravel()
                owners = np.repeat(own, 65)
                for j, mask in enumerate(masks):
                    key = variants & ~mask
                    with np.errstate(over="ignore"):
                        at = ((key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
                    order = np.argsort(at, kind="stable")
                    cuts = np.flatnonzero(np.diff(at[order])) + 1
                    ids, blobs = [], []
                    for rows in np.split(order, cuts):
                        ids.append(int(at[rows[0]]) * blocks + j)
                        blobs.append(np.concatenate((variants[rows], owners[rows])).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run, masks


def _meet(masks: list[np.uint64]):
    """Links between owners of variants that meet in a bucket, as a spanning forest of the bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        mask = masks[key[0].as_py() % len(masks)]
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("blob").combine_chunks()]
        variant = np.concatenate([x[: len(x) // 2] for x in parts])
        owner = np.concatenate([x[len(x) // 2 :] for x in parts])
        outside = variant & ~mask
        order = np.lexsort((owner, variant & mask, outside))
        variant, owner, outside = variant[order], owner[order], outside[order]
        first = np.flatnonzero(np.concatenate(([True], outside[1:] != outside[:-1])))
        alone = np.minimum.reduceat(owner, first) == np.maximum.reduceat(owner, first)
        keep = ~np.repeat(alone, np.diff(np.append(first, len(outside))))  # groups with one owner link nothing
        variant, owner, outside = variant[keep], owner[keep], outside[keep]
        if not len(variant):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        new = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
        least = owner[new]  # a variant's smallest owner
        a, b = [np.repeat(least, np.diff(np.append(new, len(variant))))], [owner]
        names = variant[new]
        by_name = np.argsort(names)
        names, least = names[by_name], least[by_name]
        for bit in range(64):
            step = np.uint64(1) << np.uint64(bit)
            if step & mask:
                low = np.flatnonzero(names & step == 0)
                at = np.minimum(np.searchsorted(names, names[low] | step), len(names) - 1)
                hit = names[at] == names[low] | step
                a.append(least[low[hit]])
                b.append(least[at[hit]])
        a, b = np.concatenate(a), np.concatenate(b)
        close = np.bitwise_count(a ^ b) <= RADIUS  # what met is verified, though no other pair can meet
        a, b = _forest(a[close], b[close])
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest node that the links reach, in place of the links."""
    differ = a != b
    nodes, at = np.unique(np.concatenate((a[differ], b[differ])), return_inverse=True)
    x, y = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while len(x):
        hi, lo = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    own = root != np.arange(len(nodes))
    return nodes[root[own]], nodes[own]


def links(spark: SparkSession, fingerprints: DataFrame, blocks: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``, long) that connect all within three bits of each other."""
    variants = 65 * blocks * fingerprints.count()
    buckets = max(n_partitions(spark), -(-variants // VARIANTS))
    run, masks = _spread(blocks, buckets)
    dealt = fingerprints.mapInArrow(run, "bucket long, blob binary").repartition(buckets, "bucket")
    return dealt.groupBy("bucket").applyInArrow(_meet(masks), "a long, b long").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Rows (v, label) for every node of the edges (a, b): the smallest node that it is connected with.

    Each round hooks every node to its smallest neighbour, follows the hooks, and contracts the edges, which at least
    halves the nodes that are left; edges and labels are written to the shared folder in each round.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(spark, edges, "edges")
    labels = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p"))
        hook = materialize(spark, hook, "hooks")
        while True:  # follow the hooks to their ends
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = materialize(spark, hook.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")), "hooks")
            hook = jumped.select("v", "p")
            if not jumped.filter("moved").take(1):
                break
        if labels is None:
            labels = hook.withColumnRenamed("p", "label")
        else:
            up = hook.withColumnsRenamed({"v": "label", "p": "q"})
            labels = materialize(spark, labels.join(up, "label", "left").select("v", F.coalesce("q", "label").alias("label")), "labels")
        ends = edges.join(hook.withColumnsRenamed({"v": "a", "p": "pa"}), "a").join(hook.withColumnsRenamed({"v": "b", "p": "pb"}), "b")
        edges = materialize(spark, ends.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.withColumnsRenamed({"a": "v", "b": "label"})


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = 2) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``, ``group_fp`` and ``text_hash`` (long).

    ``component_id`` is the smallest id among rows reachable over links; ``group_fp`` names the component even where ids
    repeat or are null. Null and empty texts have fingerprint zero and link like any other. Null ids take part and never
    are the smallest, unless a component has no other (then null). Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), _fingerprints(F.col(text_col)).alias("fp"))
    own = materialize(spark, own, "fingerprints")
    distinct = materialize(spark, own.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    spread = distinct.select("fp").repartition(n_partitions(spark))  # also where a few files hold all fingerprints
    labels = components(spark, links(spark, spread, blocks))
    named = distinct.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("group_fp"), "first_id")
    named = materialize(spark, named, "named")
    smallest = named.groupBy("group_fp").agg(F.min("first_id").alias("component_id"))
    of = materialize(spark, named.join(materialize(spark, smallest, "smallest"), "group_fp").select("fp", "group_fp", "component_id"), "groups")
    return own.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_fp", "text_hash")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (of repeated ids, any one row)."""
    groups = near_duplicates(spark, docs, id_col, text_col)
    id_, group, hash_, n, own_hash = (free_name(docs, name) for name in ("id", "group", "hash", "n", "own_hash"))
    firsts = groups.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(id_), F.col("group_fp").alias(group), F.col("text_hash").alias(hash_))
    keep = materialize(spark, firsts.groupBy(id_, group).agg(F.min(hash_).alias(hash_), F.count("*").alias(n)), "firsts")
    rows = docs.withColumn(own_hash, F.xxhash64(text_col))
    kept = rows.join(keep, rows[id_col].eqNullSafe(keep[id_]) & (rows[own_hash] == keep[hash_]))
    alone = kept.filter(F.col(n) == 1).select(*docs.columns)  # most rows: no copy of them has their id
    repeated = kept.filter(F.col(n) > 1).groupBy(id_, group).agg(*(F.first(c).alias(c) for c in docs.columns))
    return alone.unionByName(repeated.select(*docs.columns))
