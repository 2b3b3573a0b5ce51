"""Periodic runs of words, exactly, by recompression.

The words of several documents, each behind a separator of its own, become one sequence. Two steps shrink it in turn
until one symbol is left: every block of equal symbols becomes one symbol (block compression), and every symbol of a left
class followed by one of a right class becomes one with it (pair compression). Equal symbols of a level stand for equal
words, and what becomes of a symbol depends on its neighbours alone, so equal stretches are cut alike but for their ends.
The levels are a run-length grammar of the sequence. A longest common extension climbs both places level by level, past at
most one symbol (or block) on each, and comes down where symbols differ; thousands of queries go side by side.

A run of period q and length 2q or more holds two neighbours i and i + q of the grid of multiples of q. So for every q the
grid's neighbours are asked how far they extend each other in either direction, n/1 + n/2 + ... places in all; where the
smallest period asked about is q, the maximal stretch is a run. Places on the grid whose words, or whose six-word
neighbourhoods, can't match are left out beforehand by hashes. No suffix array is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitemigrate.llm.common import WORD, free_name, mix64, window_hashes


MIN_LENGTH = 12
#: Words that share a grammar, about; a longer document has one of its own.
BATCH_WORDS = 1 << 18
#: Grid places that are looked at side by side.
GRID = 1 << 20


class Grammar:
    """The levels of a sequence of numbers, and longest common extensions by them.

    Level k has symbols ``sym[k]``, whose parts on the level below lie from ``first[k]`` up to ``end[k]``; ``parent[k]`` is
    the place, on the level above, of the symbol that a symbol of level k belongs to. ``rules[k]`` are the parts of each
    symbol: (symbol, times) of a block, (left, right) of a pair, where a lone symbol has right -1. The sequence must begin
    and end with numbers that stand nowhere else.
    """

    def __init__(self, sequence: np.ndarray):
        _, sym = np.unique(sequence, return_inverse=True)
        self.sym, self.first, self.rules = [sym.astype(np.int64)], [None], [None]
        level = 0
        while len(self.sym[-1]) > 1:
            self._add(*_blocks(self.sym[-1]))
            if len(self.sym[-1]) > 1:
                self._add(*_pairs(self.sym[-1], level))
            level += 1
        self.end = [None, *(np.append(f[1:], len(self.sym[k])) for k, f in enumerate(self.first[1:]))]
        self.parent = [np.repeat(np.arange(len(f)), e - f) for f, e in zip(self.first[1:], self.end[1:])]

    def _add(self, first: np.ndarray, parts: np.ndarray) -> None:
        """A level whose symbols begin at ``first`` and are told apart by ``parts``; none, if nothing shrinks."""
        if len(first) < len(self.sym[-1]):
            rules, sym = _numbered(parts)
            self.sym.append(sym)
            self.first.append(first)
            self.rules.append(rules)

    def mirrored(self) -> Mirror:
        return Mirror(self)

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of the sequence from each ``i`` and from each ``j`` (they differ)."""
        return _extend(self, i, j)


class Mirror:
    """The same grammar read backwards: extensions to the left."""

    def __init__(self, of: Grammar):
        sizes = [len(s) for s in of.sym]
        self.n = sizes[0]
        self.sym = [s[::-1] for s in of.sym]
        self.parent = [sizes[k + 1] - 1 - p[::-1] for k, p in enumerate(of.parent)]
        self.first = [None, *(sizes[k] - e[::-1] for k, e in enumerate(of.end[1:]))]
        self.end = [None, *(sizes[k] - f[::-1] for k, f in enumerate(of.first[1:]))]

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers before each ``i`` and before each ``j`` are equal in turn."""
        return _extend(self, self.n - i, self.n - j)


def _numbered(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of two columns of small numbers, and the number of each row."""
    width = int(parts[:, 1].max()) + 2
    codes, sym = np.unique(parts[:, 0] * width + parts[:, 1] + 1, return_inverse=True)
    return np.stack((codes // width, codes % width - 1), axis=1), sym


def _blocks(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of equal symbols begin, and (symbol, times) of each."""
    first = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1])))
    return first, np.stack((sym[first], np.diff(np.append(first, len(sym)))), axis=1)


def _pairs(sym: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where left-right pairs and lone symbols begin, and (left, right or -1) of each.

    The classes are a hash of the symbol; of several hashes, the one that joins most pairs.
    """
    best = None
    for seed in range(4):
        left = (mix64(sym.astype(np.uint64) + np.uint64(((level * 4 + seed) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        joined = left[:-1] & ~left[1:]
        if best is None or np.count_nonzero(joined) > np.count_nonzero(best):
            best = joined
    if not best.any():  # a few symbols of one class: the first two differ, as blocks are gone
        best = np.zeros(len(sym) - 1, bool)
        best[(sym[:-1] == sym[0]) & (sym[1:] != sym[0])] = True
    first = np.flatnonzero(np.concatenate(([True], ~best)))
    right = np.append(np.where(best, sym[1:], -1), -1)[first]
    return first, np.stack((sym[first], right), axis=1)


def _extend(g: Grammar | Mirror, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """See ``Grammar.extend``; the last symbol of each level is a stop that equals no other."""
    at, a, b = np.arange(len(i)), i.astype(np.int64), j.astype(np.int64)
    halted = []
    for k in range(len(g.sym)):  # up, where both begin a symbol of the next level, if need be past one part of a symbol
        if k + 1 == len(g.sym) or not len(at):
            halted.append((at, a, b))
            break
        up_a, up_b = g.parent[k][a], g.parent[k][b]
        inside = np.flatnonzero((g.first[k + 1][up_a] != a) | (g.first[k + 1][up_b] != b))
        if len(inside):
            a[inside], b[inside] = _pass(g, k, a[inside], b[inside])
            up_a, up_b = g.parent[k][a], g.parent[k][b]
        go = (g.first[k + 1][up_a] == a) & (g.first[k + 1][up_b] == b) & (g.sym[k][a] == g.sym[k][b])
        halted.append((at[~go], a[~go], b[~go]))
        at, a, b = at[go], up_a[go], up_b[go]
    at, a, b = (np.zeros(0, np.int64),) * 3
    for k in range(len(halted) - 1, -1, -1):  # down: equal first parts are passed, until words differ on the lowest level
        at, a, b = (np.concatenate(x) for x in zip((at, a, b), halted[k]))
        while (equal := g.sym[k][a] == g.sym[k][b]).any():
            a[equal], b[equal] = _pass(g, k, a[equal], b[equal])
        if k:
            a, b = g.first[k][a], g.first[k][b]
    out = np.zeros(len(i), np.int64)
    out[at] = a - i[at]
    return out


def _pass(g: Grammar | Mirror, k: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both places one part further where their symbols are equal; within blocks, as far as the shorter one goes."""
    sym = g.sym[k]
    step = np.ones(len(a), np.int64)
    if k + 1 < len(g.sym):
        left = np.minimum(g.end[k + 1][g.parent[k][a]] - a, g.end[k + 1][g.parent[k][b]] - b)
        step = np.where(sym[a] == sym[np.minimum(a + 1, len(sym) - 1)], left, step)  # a pair has no equal neighbours
    step[sym[a] != sym[b]] = 0
    return a + step, b + step


def grid(words: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods q of the harmonic grid at which a run of ``min_length`` or more words may lie.

    A run pairs ``max(q, min_length - q)`` words in a row with the words q later, i among them; so a stretch of half of
    ``min_length`` pairs that holds i must have equal hashes.
    """
    n, half = len(words), min_length // 2
    hashes = window_hashes(words.astype(np.uint64) + np.uint64(1), half)
    places, periods = [], []
    lo = 1
    while lo <= n // 2:
        counts = (n - 1) // np.arange(lo, n // 2 + 1)
        take = max(1, int(np.searchsorted(np.cumsum(counts), GRID)))
        q = np.arange(lo, lo + min(take, len(counts)))
        counts = counts[: len(q)]
        period = np.repeat(q, counts)
        place = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
        hit = np.flatnonzero(words[place] == words[place + period])
        place, period = place[hit], period[hit]
        near = np.zeros(len(place), bool)
        for back in range(half):
            s = place - back
            ok = (s >= 0) & (s + period < len(hashes))
            near[ok] |= hashes[s[ok]] == hashes[s[ok] + period[ok]]
        places.append(place[near])
        periods.append(period[near])
        lo = int(q[-1]) + 1
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.zeros(0, np.int64),) * 2


def find_runs(documents: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs of each sequence of word numbers: rows (start, length, period), by start and period."""
    base, parts, where, place, period = 1, [np.array([-1])], [], [], []
    grids = [grid(words, min_length) for words in documents]
    for d, words in enumerate(documents):
        at, q = grids[d]
        if len(at):
            place.append(at + base)
            period.append(q)
            where.append(np.full(len(at), d))
            parts += [words.astype(np.int64), np.array([-2 - d])]
            base += len(words) + 1
    out = [np.zeros((0, 3), np.int64)] * len(documents)
    if not place:
        return out
    place, period, where = np.concatenate(place), np.concatenate(period), np.concatenate(where)
    offset = np.zeros(len(documents), np.int64)
    used = np.unique(where)
    sizes = np.array([len(documents[d]) + 1 for d in used])
    offset[used] = 1 + np.cumsum(sizes) - sizes
    grammar = Grammar(np.concatenate(parts))
    after, before = grammar.extend(place, place + period), grammar.mirrored().extend(place, place + period)
    length = before + after + period
    good = (length >= np.maximum(min_length, 2 * period)) & (before + after >= period)
    rows = np.stack((where, place - before - offset[where], length, period), axis=1)[good]
    order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    smallest = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))) if len(rows) else np.zeros(0, bool)
    rows = rows[smallest]  # a stretch's smallest period divides its others
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(documents) + 1))
    return [rows[cuts[d] : cuts[d + 1], 1:] for d in range(len(documents))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change[:-1]) > 0
    return b" ".join(words) if not dropped.any() else b" ".join([w for w, d in zip(words, dropped.tolist()) if not d])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text without the repetitions: words that no run holds after its first period, joined by one space.
    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Repeated rows and ids each give their row;
    other columns aren't read. A text is held by one task; nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType
    arrow, runs_type = to_arrow_type(kind), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(ids: pa.Array, texts: list) -> Iterator[pa.RecordBatch]:
        lo = 0
        while lo < len(texts):
            words, numbers, total = [], [], 0
            while lo + len(words) < len(texts) and total < BATCH_WORDS:
                own = (texts[lo + len(words)].as_py() or "").encode().split()
                known: dict[bytes, int] = {}
                numbers.append(np.array([known.setdefault(w, len(known)) for w in own], np.int64))
                words.append(own)
                total += len(own)
            found = find_runs(numbers, min_length)
            flat = np.concatenate(found)
            steps = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), steps)
            collapsed = pa.array([collapse(w, r).decode() for w, r in zip(words, found)], pa.string())
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(words)).cast(arrow), pa.array([len(w) for w in words], pa.int64()), runs.cast(runs_type), collapsed], ["id", "n_words", "runs", "collapsed"])
            lo += len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows(batch.column(0), batch.column(1))

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where a tenth of the texts, told by the CRC of their ids, become periodic from some word on (the fixed test)."""
    h, words = free_name(docs, "h"), free_name(docs, "words")
    g = F.floor(F.col(h) / 10)
    n = F.nullif(F.size(words), F.lit(0))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    periodic = F.concat(F.slice(words, F.lit(1), a), F.transform(F.sequence(a, n - 1), lambda i: F.element_at(words, a + (i - a) % p + 1)))
    marked = docs.withColumn(h, F.crc32(F.col(id_col).cast("string")))
    marked = marked.withColumn(words, F.when(F.col(h) % 10 == 0, F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))))
    text = F.when(n > 0, F.array_join(periodic, " ")).otherwise(F.col(text_col))
    return marked.withColumn(text_col, text).select(*docs.columns)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The longest run of each row (ties: smallest start, then period), and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select(F.col(id_col), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    exponent: Column = F.floor(1000 * length / period).cast("long")
    return rows.select(id_col, "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: DuckDB SQL for the query ``op12``: equal words of a text at every distance, put together to stretches.
ORACLE_SQL = r"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS text,
         xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
                     lambda k: [(256 + ascii(substr(doc_id::VARCHAR, k::INT, 1)))::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
                   lambda c, x: CASE WHEN x >= 256 THEN xor(c, x - 256) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END))::BIGINT AS h
  FROM documents
), split AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS original FROM raw
), shaped AS (
  SELECT *, len(original) AS n, CASE WHEN len(original) > 0 THEN g % len(original) END AS a FROM split
), words AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
         THEN list_transform(range(n), lambda i: original[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE original END AS w
  FROM shaped
), flat AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM words
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM flat x JOIN flat y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         arg_max({'s': start, 'l': length, 'p': period}, [length, -start, -period]) AS best
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.i) AS collapsed FROM flat f ANTI JOIN dropped d ON f.doc_id = d.doc_id AND f.i = d.i GROUP BY f.doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM words w LEFT JOIN listed l ON w.doc_id = l.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
