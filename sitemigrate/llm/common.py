"""Helpers shared by the corpus operators: shared storage, words and their hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of characters other than the ASCII blanks. ``bytes.split()`` cuts UTF-8 text in the same places.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or else the checkpoint folder set.

    Without either, a session in one process (as in tests) gets a temporary folder, made once; any other session is an
    error, as its executors would write to disks of their own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="sitemigrate-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared_dir.own = own
    return f"file://{own}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no earlier stage. Hadoop deletes the table when the driver ends.
    """
    return materialize_at(spark, df, name)[0]


def materialize_at(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the folder, which ``drop_table`` can delete before the driver ends."""
    path = f"{shared_dir(spark)}/sitemigrate-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath.getParent())
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``materialize_at`` has written and nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath.getParent(), True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, docs: DataFrame, text_col: str, size: int) -> int:
    """So many buckets that each gets about ``size`` bytes of text, and no fewer than shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(n_partitions(spark), -(-total // size))


def hash_sample(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``columns``; all rows, if there are no more.

    Only rows below a threshold that lets somewhat more than ``n`` through are ordered, so no task gets rows of all others.
    """
    total = df.count()
    share = min(1.0, (1.2 * n + 200) / max(total, 1))
    key = F.pmod(F.xxhash64(*columns), F.lit(1 << 31))
    name = free_name(df, "key")
    return df.withColumn(name, key).filter(F.col(name) <= int(share * (1 << 31))).orderBy(name, *columns).limit(n).drop(name)


def number_ids(spark: SparkSession, df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with numbers (long) in ``id_col``, and a table (number, id) to get back, or none where ids are numbers already.

    Ids of any other type are numbered in their order, equal ids alike; null ids stay null.
    """
    if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(id_col, F.col(id_col).cast("long")), None
    distinct = df.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    ranged = materialize(spark, distinct.repartitionByRange(n_partitions(spark), "id").select("id", F.spark_partition_id().alias("part")), "ids")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before = F.array(*(F.lit(sum(sizes.get(k, 0) for k in range(part))).cast("long") for part in range(max(sizes, default=0) + 1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) + F.element_at(before, F.col("part") + 1) - 1
    names = materialize(spark, ranged.select(place.cast("long").alias("number"), "id"), "numbers")
    known = names.select(F.col("id").alias(free_name(df, "known")), F.col("number").alias(free_name(df, "number")))
    joined = df.join(known, df[id_col] == F.col(known.columns[0]), "left")
    return joined.select(*(F.col(known.columns[1]).alias(c) if c == id_col else df[c] for c in df.columns)), names


def named_again(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """``df`` with the ids of ``names`` in place of the numbers in ``columns``."""
    for column in columns if names is not None else ():
        of = names.select(F.col("number").alias(free_name(df, "number")), F.col("id").alias(free_name(df, "id")))
        joined = df.join(of, df[column] == F.col(of.columns[0]), "left")
        df = joined.select(*(F.col(of.columns[1]).alias(c) if c == column else df[c] for c in df.columns))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def ascii_lower(col: Column | str) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One random 64-bit value for each byte, and an odd base for the polynomial (with its inverse modulo 2**64).
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = np.full(max(n, 1 << 16), _BASE if which == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[which] = have = np.multiply.accumulate(step)
    return have[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte offsets) and 64-bit hash of every word of UTF-8 ``data``, without a loop over words.

    The hash is a polynomial over random byte values modulo 2**64, taken from prefix sums, and mixed at the end.
    """
    b = np.frombuffer(data, np.uint8)
    inside = ~_BLANK[b]
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    if len(b) > 1 << 20:  # the tables of powers stay small: long texts are hashed in runs of whole words
        cut = np.searchsorted(end, np.arange(1 << 20, len(b) + (1 << 20), 1 << 20))
        hashes, at = [], 0
        for k in np.unique(np.append(cut, len(start))):
            if k > at:
                lo, hi = int(start[at]), int(end[k - 1])
                hashes.append(_hash_words(b[lo:hi], start[at:k] - lo, end[at:k] - lo))
                at = int(k)
        return start, end, np.concatenate(hashes)
    return start, end, _hash_words(b, start, end)


def _hash_words(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _power("up", len(b)), out=sums[1:])
        return mix64((sums[end] - sums[start]) * _power("down", len(b))[start] + (end - start).astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` hashes in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
        return mix64(out)
