"""Packing of token sequences into as few fixed-size sequences as it can: exact complements first, then best fit.

Only lengths matter for a plan, and a length lies between 1 and the capacity. So the driver plans on a histogram of at
most ``capacity`` numbers, whatever the input's size: it takes the longest length left, looks up the gap it leaves among
single lengths, sums of two and sums of three, and consumes as many of the combination as all its lengths have left.
What finds no exact complement is placed best fit, longest first. A plan row says "ranks r..r+m of length l go to
sequences s..s+m at offset o"; each piece finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemigrate.llm.bpe import Codec
from sitemigrate.llm.common import materialize

CAPACITY = 4096


#: Classes of bytes: 0 blanks, 1 letters (ASCII and the two-byte letters up to U+00FF), 2 digits, 3 other ASCII, 4 all others.
_KIND = np.full(256, 4, np.uint8)
_KIND[:128] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 4  # an apostrophe may start a word's short form
#: What the split pattern of the vocabulary keeps whole, among the characters of the classes 1 to 3.
_ONE_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\s\dA-Za-z'\x80-\U0010ffff]+")


def cut_words(texts: pa.Array) -> pa.Array:
    """Texts with a blank between the words of each chunk, where letters, single digits and symbols meet.

    Chunks with a byte of class 4 stay as they are. ``texts`` are strings without nulls.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    base = int(offsets[0])
    b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[base : int(offsets[-1])]
    kind = _KIND[b]
    signs = np.flatnonzero((b == 0x97) | (b == 0xB7))  # the two signs among the letters of 0xC3
    kind[signs[b[signs - 1] == 0xC3]] = 4
    edge = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge &= (kind[1:] != 0) & (kind[:-1] != 0)
    at = np.flatnonzero(edge) + 1
    other = np.flatnonzero(kind == 4)
    if len(other):
        blanks = np.flatnonzero(kind == 0)
        chunk = np.unique(np.searchsorted(blanks, other))
        at = at[~np.isin(np.searchsorted(blanks, at), chunk)]
    moved = (offsets - base + np.searchsorted(at, offsets - base)).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(np.insert(b, at, 0x20)))


class BatchCodec(Codec):
    """Ids of groups of texts, new words encoded by the tokenizers library many at a time.

    Words are cut with numpy where that is plain (letters up to U+00FF, digits, ASCII symbols). New ones are joined with
    blanks, and the ids of the whole are cut at ids with the word-end suffix. Any other chunk between blanks goes to the
    library by itself, so that its own tables decide what a letter is.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.read(path)
        self.ends = np.array([x.endswith(self.suffix) for x in self.labels])
        self.most = most
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _missing(self, names: list[str]) -> list[str]:
        """Names that neither generation of the cache has; those of the older one move to the newer one."""
        if len(self.words) > self.most:
            self.words, self.old = {}, self.words
        new = [w for w in names if w not in self.words]
        if not self.old:
            return new
        known = {w: ids for w in new if (ids := self.old.get(w)) is not None}
        self.words.update(known)
        return [w for w in new if w not in known]

    def _encode_new(self, names: list[str]) -> None:
        plain = _ONE_WORD.fullmatch
        one = [w for w in names if plain(w)]
        alone = names if not one else [w for w in names if not plain(w)] if len(one) < len(names) else []
        texts = [" ".join(one[lo : lo + 1000]) for lo in range(0, len(one), 1000)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own, ids = one[1000 * k : 1000 * k + 1000], np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(own):  # a word that the library cuts on its own account
                alone += own
                continue
            data = ids.tobytes()
            self.words.update(zip(own, (data[a:b] for a, b in zip([0, *cuts], cuts))))
        for lo in range(0, len(alone), 10_000):
            part = alone[lo : lo + 10_000]
            self.words.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null text has none. Texts that may hold special tokens go whole.

        Texts are cut at ASCII blanks, where no word goes on, and A-Z is lowered first, so that words repeat more often; only
        distinct words become Python strings, and the ids of all are put together by index.
        """
        texts = texts.fill_null("")
        special = pc.match_substring(texts, "<|")
        lists = pc.ascii_split_whitespace(cut_words(pc.ascii_lower(pc.if_else(special, "", texts))))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._encode_new(self._missing(names))
        ids = pa.array(list(map(self.words.__getitem__, names)), pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        offsets = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = ids.buffers()[2].to_pybytes() if len(ids) and ids.buffers()[2] is not None else b""
        out = [data[lo:hi] for lo, hi in zip(offsets, offsets[1:])]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def runs_of_bytes(texts: pa.Array, most: int = 12 << 20) -> Iterator[pa.Array]:
    """Slices of at most ``most`` bytes of text, or of one row."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


_codecs: dict[str, BatchCodec] = {}


def batch_codec(path: str) -> BatchCodec:
    """The codec of a vocabulary file, loaded once in a Python process."""
    if path not in _codecs:
        _codecs[path] = BatchCodec(path)
    return _codecs[path]


def tokenize_pieces(docs: DataFrame, vocab_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of at most ``capacity`` tokens.

    Columns: id, piece, start, length, ids_crc32, ids (null unless ``with_ids``), and part and rank: the task, and the
    piece's number among those of its length in that task. A null text is empty, and so one piece of one token.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = batch_codec(vocab_path)
        end = end_id.to_bytes(4, "little")
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at = 0
            for texts in runs_of_bytes(batch.column(1)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                row, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
                for i, ids in enumerate(c.encode_all(texts)):
                    ids += end
                    for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[first : first + 4 * capacity]
                        n = len(own) // 4
                        row.append(i)
                        piece.append(k)
                        start.append(first // 4)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        rank.append(seen[n])
                        kept.append(np.frombuffer(own, np.int32) if with_ids else None)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(kept, pa.list_(pa.int32())), pa.array(rank, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32", "ids", "rank"],
                )

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>, rank long")
        .withColumn("part", F.spark_partition_id())
        .withColumnRenamed("id", id_col)
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, how many, first sequence, offset), and the number of sequences, for counts by length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        left[length] += n
    used = np.zeros(capacity + 1, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    made = 0

    def take(lengths: list[int], n: int, first: int, offset: int) -> None:
        for length in lengths:
            out.append((length, int(used[length]), n, first, offset))
            used[length] += n
            left[length] -= n
            offset += length

    def complement(gap: int) -> list[int] | None:
        """Lengths that fill a gap exactly, as few as can be, of those with enough left."""
        if left[gap]:
            return [gap]
        a = np.arange((gap + 1) // 2, gap)  # the larger of two
        ok = (left[a] > 0) & (left[gap - a] > 0) & ((a != gap - a) | (left[a] > 1))
        if ok.any():
            x = int(a[ok][-1])
            return [x, gap - x]
        for x in np.flatnonzero(left[: gap - 1])[::-1]:  # the largest of three
            rest = gap - int(x)
            b = np.arange((rest + 1) // 2, min(int(x), rest - 1) + 1)
            if not len(b):
                break
            c = rest - b
            ok = (left[b] >= 1 + (b == x)) & (left[c] >= 1 + (c == b) + (c == x))
            if ok.any():
                y = int(b[ok][-1])
                return [int(x), y, rest - y]
        return None

    residual: list[tuple[int, int]] = []  # length and how many found no exact complement
    for length in range(capacity, 0, -1):
        while left[length]:
            gap = capacity - length
            if gap:
                left[length] -= 1
                rest = complement(gap)
                left[length] += 1
                if rest is None:
                    residual.append((length, int(left[length])))
                    left[length] = 0
                    break
            else:
                rest = []
            need: dict[int, int] = {}
            for x in [length, *rest]:
                need[x] = need.get(x, 0) + 1
            n = min(int(left[x]) // k for x, k in need.items())
            take([length, *rest], n, made, 0)
            made += n
    open_: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, how many)
    gaps = np.zeros(capacity + 1, bool)
    for length, n in residual:
        left[length] = n
        while n:
            fit = np.flatnonzero(gaps[length:])
            if not len(fit):  # each new sequence takes as many of this length as it holds
                each = min(capacity // length, n)
                full = n // each
                for k in range(each):
                    take([length], full, made, k * length)
                first, m, gap = made, full, capacity - each * length
                made += full
                n -= full * each
            else:
                gap = length + int(fit[0])
                first, m = open_[gap].pop()
                if not open_[gap]:
                    gaps[gap] = False
                if m > n:
                    open_[gap].append((first + n, m - n))
                    gaps[gap] = True
                    m = n
                take([length], m, first, capacity - gap)
                n -= m
                gap -= length
            if gap:
                open_.setdefault(gap, []).append((first, m))
                gaps[gap] = True
    return out, made


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces (``length``, ``part`` and ``rank`` are used).

    An empty table gives an empty result. The order of repeated rows doesn't matter: every row is placed once.
    """
    by = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(counts, capacity)
    rows.sort()
    table = np.array(rows or [(0, 0, 0, 0, 0)], np.int64)
    key = table[:, 0] << 48 | table[:, 1]

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        row = np.searchsorted(key, length << 48 | rank, "right") - 1
        return pa.StructArray.from_arrays([pa.array(table[row, 3] + rank - table[row, 1]), pa.array(table[row, 4])], ["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = by.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(start, ["length", "part"]).withColumn("__at", place("length", F.col("rank") + F.col("before")))  # ids stay out of Python
    return ranked.select(*(c for c in pieces.columns if c not in ("part", "rank")), "__at.*")


def pack_documents(spark: SparkSession, docs: DataFrame, vocab_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Null ids stay null; repeated rows are packed one by one; other columns are not read. The pieces (not the texts) are
    written once to the shared folder, so that texts are encoded once and ranks don't change when a task runs again.
    """
    pieces = materialize(spark, tokenize_pieces(docs, vocab_path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    packed = pack_pieces(spark, pieces, capacity)
    return packed.select(id_col, "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
