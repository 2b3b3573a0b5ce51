"""Exact top-k inner products on a bit-sliced index.

The index holds, for a block of rows and each attribute, the bits of the quantised values as bitmaps ("slices"): slice s
of an attribute has a bit for each row whose value has bit s set. A query's scores for all rows of a block are added up
with bitmap arithmetic (full adders on whole bitmaps), which gives the slices of the scores. From the most significant
slice downward, rows are taken while fewer than k have a set bit; the rest narrows to those still equal to the k-th. Rows
equal in all slices are ties, resolved by the smaller id. Nothing is approximated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitemigrate.llm.common import materialize, n_partitions, named_again, number_ids

#: Components below this, after scaling, are 64-bit numbers; vectors with larger ones are wide, of Python's whole numbers.
LIMIT = 2.0**56
#: Bytes of quantised vectors for a block and for a pack of queries (65,536 and 64 vectors of 64 components).
BLOCK_BYTES, PACK_BYTES = 32 << 20, 32 << 10


def quantise(vector: list | None, scale: float) -> np.ndarray | None:
    """floor(scale * x) of each component as a double; none for a null vector or one with a null or non-finite component."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all():
        return None
    if (np.abs(v) >= LIMIT / scale).any():
        return np.array([math.floor(Fraction(x) * Fraction(scale)) for x in v.tolist()], object)
    return np.floor(v * scale).astype(np.int64)


def _packed(q: np.ndarray) -> bytes:
    return ",".join(map(str, q)).encode() if q.dtype == object else q.astype("<i8").tobytes()


def _unpacked(blobs: list[bytes], dims: int, wide: bool) -> np.ndarray:
    if wide:
        return np.array([[int(x) for x in blob.split(b",")] for blob in blobs], object)
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), dims)


def rank_key(score: int) -> bytes:
    """Bytes in the order of whole numbers of any size: the length, with the sign, before the digits."""
    n = (abs(score).bit_length() + 7) // 8
    digits = score if score >= 0 else (1 << 8 * n) + score
    return (32768 + (n if score >= 0 else -n)).to_bytes(2, "big") + digits.to_bytes(n, "big")


def build_index(ids: np.ndarray, values: np.ndarray) -> dict:
    """The slices of ``values`` (rows x attributes), offset so that all are non-negative, for rows sorted by id."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    low = int(values.min(initial=0))
    kind = object if values.dtype == object else np.uint64
    of = int if kind is object else np.uint64
    width = max(1, (int(values.max()) - low).bit_length()) if values.size else 1
    n_words = -(-len(ids) // 64)
    slices = np.zeros((values.shape[1], width, n_words), "<u8")  # attributes x bits x words
    bits = np.zeros(n_words * 64, np.uint8)
    for j in range(values.shape[1]):  # by attribute, so that no second copy of the block is made
        shifted = (values[order, j] - low).astype(kind)
        for s in range(width):
            bits[: len(ids)] = shifted >> of(s) & of(1)
            slices[j, s] = np.packbits(bits, bitorder="little").view("<u8")
    return {"ids": ids, "low": low, "slices": slices}


def _add(planes: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The sum of bitmaps by weight (``planes[w]`` count 2**w each), as slices; full adders leave one bitmap a weight."""
    out, w = [], 0
    while w < len(planes):
        have = planes[w]
        while len(have) > 1:
            if w + 1 == len(planes):
                planes.append([])
            if len(have) > 2:
                a, b, c = have.pop(), have.pop(), have.pop()
                x = a ^ b
                have.insert(0, x ^ c)
                planes[w + 1].append(a & b | x & c)
            else:
                a, b = have.pop(), have.pop()
                have.append(a ^ b)
                planes[w + 1].append(a & b)
        out.append(have[0] if have else None)
        w += 1
    return out


def scores(index: dict[str, np.ndarray], query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of (score - base) for all rows of a block, and base.

    A bit of the query times an attribute is the attribute, shifted. So for each bit of the query, the slices of the
    attributes with that bit are added as stacks; a negative component takes the complement of its attribute instead.
    """
    slices = index["slices"]
    n_attributes, width, n_words = slices.shape
    low = int(index["low"])
    negative = query < 0
    size = np.abs(query)
    base = low * sum(query.tolist()) - ((1 << width) - 1) * sum(size[negative].tolist())
    planes: list[list[np.ndarray]] = [[] for _ in range(width)]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for bit in range(int(size.max(initial=0)).bit_length()):
        with_bit = np.flatnonzero(size >> bit & 1)
        stacks = [~slices[j] if negative[j] else slices[j] for j in with_bit]
        for carry, stack in enumerate(_add([stacks]) if stacks else []):
            if stack is not None:
                for s in range(width):
                    while len(planes) <= bit + carry + s:
                        planes.append([])
                    planes[bit + carry + s].append(stack[s])
    zero = np.zeros(n_words, np.uint64)
    return [zero if x is None else x for x in _add(planes)], base


def top(index: dict[str, np.ndarray], query: np.ndarray, k: int, leave_out: int | None) -> list[tuple[int, int]]:
    """The k best (id, score) of a block for one query, ties to the smaller id; rows with the id ``leave_out`` don't count."""
    ids = index["ids"]
    planes, base = scores(index, query)
    n_words = index["slices"].shape[2]
    tied = np.zeros(n_words * 64, np.uint8)
    tied[: len(ids)] = ids != leave_out if leave_out is not None else 1
    tied = np.packbits(tied, bitorder="little").view("<u8")
    taken = np.zeros(n_words, np.uint64)
    n_taken = 0
    for plane in planes[::-1]:
        ahead = tied & plane
        n = int(np.bitwise_count(ahead).sum())
        if n_taken + n <= k:
            taken |= ahead
            n_taken += n
            tied &= ~plane
            if n_taken == k:
                break
        else:
            tied = ahead
    rows = _rows(taken)
    if n_taken < k:
        rows = np.concatenate((rows, _rows(tied)[: k - n_taken]))
    bits = [(plane[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) for plane in planes]
    found = [(int(ids[r]), base + sum(int(b[i]) << w for w, b in enumerate(bits))) for i, r in enumerate(rows)]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def _rows(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return words[at] * 64 + bit


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 65_536, query_rows: int = 64, packs: int = 256) -> DataFrame:
    """For each row of ``queries`` its ``k`` best rows of ``vectors`` (all, if fewer): query_id, rank, vec_id, score (long).

    Both tables need ``id_col`` (of one type, with any ids) and ``vector_col``. Rows with a null id, a null vector, or null or
    non-finite components take no part; finite ones may be of any size. Ranks are exact at any score; one that doesn't fit
    a long is given as the largest or smallest long. Vectors of another length than
    the query's don't meet it. A query meets every row but those with its own id; repeated rows are rows of their own.

    Rows are indexed in blocks of about ``block_rows``, queries are packed by ``query_rows``; both hold fewer long vectors (see
    ``BLOCK_BYTES``). Each pack goes to each block, and a block is copied once for every ``packs`` packs (or for each
    partition, if there are fewer blocks). A copy meets its packs as one group, so a worker holds one block and a bounded
    number of packs, whatever the tables' sizes.
    """
    both, names = number_ids(spark, vectors.select(id_col, vector_col, F.lit(False).alias("asks")).unionByName(queries.select(id_col, vector_col, F.lit(True).alias("asks"))), id_col)

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, q) for i, v, a in zip(*(c.to_pylist() for c in batch.columns)) if i is not None and (q := quantise(v, scale)) is not None]
            columns = [pa.array([i for i, _, _ in rows], pa.int64()), pa.array([a for _, a, _ in rows], pa.bool_()), pa.array([len(q) for *_, q in rows], pa.int32())]
            columns += [pa.array([q.dtype == object for *_, q in rows], pa.bool_()), pa.array([_packed(q) for *_, q in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "asks", "dims", "wide", "q"])

    rows = both.select(F.col(id_col), F.col(vector_col).cast("array<double>"), "asks").mapInArrow(quantised, "id long, asks boolean, dims int, wide boolean, q binary")
    rows = materialize(spark, rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    count = {r["asks"]: r for r in rows.groupBy("asks").agg(F.count("*").alias("n"), F.sum(F.octet_length("q")).alias("bytes")).collect()}
    n_blocks, n_packs = (max(1, math.ceil(count[asks]["n"] / size), math.ceil(count[asks]["bytes"] / most)) if asks in count else 1 for asks, size, most in ((False, block_rows, BLOCK_BYTES), (True, query_rows, PACK_BYTES)))
    copies = max(math.ceil(n_packs / packs), min(n_packs, math.ceil(n_partitions(spark) / n_blocks)))

    def index(table: pa.Table) -> pa.Table:
        dims, wide = table.column("dims")[0].as_py(), table.column("wide")[0].as_py()
        values = _unpacked(table.column("q").to_pylist(), dims, wide) if dims else np.zeros((table.num_rows, 0), np.int64)
        built = build_index(table.column("id").to_numpy(), values)
        return pa.table({"dims": pa.array([dims], pa.int32()), "block": table.column("block")[:1], "ids": [built["ids"].tobytes()], "low": [str(built["low"])], "width": pa.array([built["slices"].shape[1]], pa.int32()), "slices": [built["slices"].tobytes()]})

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy().astype("<i8").tobytes()
        return pa.table({"dims": table.column("dims")[:1], "pack": table.column("pack")[:1], "asked": [ids], "wide": table.column("wide")[:1], "q": pa.array([table.column("q").to_pylist()], pa.list_(pa.binary()))})

    found_kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def search(blocks: pa.Table, packed: pa.Table) -> pa.Table:
        found = []
        for dims, ids, low, width, slices in zip(*(blocks.column(c) for c in ("dims", "ids", "low", "width", "slices"))):
            ids, dims = np.frombuffer(ids.as_buffer(), "<i8"), dims.as_py()
            of = {"ids": ids, "low": int(low.as_py()), "slices": np.frombuffer(slices.as_buffer(), "<u8").reshape(dims, width.as_py(), -(-len(ids) // 64))}
            for own, wide, q in zip(*(packed.column(c) for c in ("asked", "wide", "q"))):
                own = np.frombuffer(own.as_buffer(), "<i8")
                q = _unpacked(q.as_py(), dims, wide.as_py()) if dims else np.zeros((len(own), 0), np.int64)
                found += [(int(i), v, rank_key(s), max(-(1 << 63), min(s, (1 << 63) - 1))) for i, x in zip(own, q) for v, s in top(of, x, k, int(i))]
        return pa.table([pa.array([x[c] for x in found], kind) for c, kind in enumerate(found_kinds)], ["query_id", "vec_id", "key", "score"])

    by_hash = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    indexes = rows.filter("NOT asks").withColumn("block", by_hash(n_blocks)).groupBy("dims", "wide", "block").applyInArrow(index, "dims int, block long, ids binary, low string, width int, slices binary")
    asked = rows.filter("asks").withColumn("pack", by_hash(n_packs)).groupBy("dims", "wide", "pack").applyInArrow(pack, "dims int, pack long, asked binary, wide boolean, q array<binary>")
    # Groups are dealt to a fixed number of tasks: by their bytes, which are few, Spark would put many into one.
    meet, tasks = ["dims", "block", "copy"], max(n_partitions(spark), n_blocks * copies)
    indexes = indexes.withColumn("copy", upto(copies)).repartition(tasks, *meet).groupBy(*meet)
    asked = asked.withColumn("copy", F.pmod("pack", F.lit(copies))).withColumn("block", upto(n_blocks)).repartition(tasks, *meet).groupBy(*meet)
    best = indexes.cogroup(asked).applyInArrow(search, "query_id long, vec_id long, key binary, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return named_again(ranked.select("query_id", "rank", "vec_id", "score"), names, "query_id", "vec_id")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
