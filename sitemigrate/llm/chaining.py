"""Fuzzy passages shared across documents, found by collinear chaining of shared k-mers of words.

1. Seeds: of the hashes of all runs of ``K`` words, those that are smallest in a window of ``W`` runs (any ``K + W - 1``
   equal words share a seed); with ``W = 1`` all runs are seeds. A seed's occurrences are linked to its first one, not to each other: first within a task's
   batch, then among the batches' first ones, so that a passage in a third of all documents makes one link for each.
2. Chains: links of one pair of documents on one diagonal merge to blocks; blocks are chained in the order of both
   documents, at a gap cost, with a Fenwick tree over the places in the earlier document. One seed opens a chain.
3. Alignment: the words between a chain's blocks, and beyond its ends, are aligned, so that replaced, added and missing
   words inside a passage are bridged; a chain that isn't dense enough is cut at its gaps. A document's aligned spans
   merge to passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitemigrate.llm.common import buckets_for, materialize, mix64, named_again, number_ids, window_hashes, word_hashes

K, W = 5, 1
GAP_COST = 0.1
SEED = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<i4")])
LINK = np.dtype([("doc", "<i8"), ("other", "<i8"), ("pos", "<i4"), ("at", "<i4")])
#: How far beyond a chain's ends words are looked at: to both ends of a passage of 50 words with one seed.
MARGIN = 48
#: Seeds that a task deals at once, and bytes of text for a bucket: both bound a task's memory.
PART, BUCKET_BYTES = 1 << 20, 8 << 20


def words_of(text: str | None) -> bytes:
    """The text in UTF-8 with A-Z in lower case; words are cut at ASCII blanks."""
    return (text or "").encode("utf-8").lower()


def seeds_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place (in words) of the seeds of a text with these word hashes."""
    runs = window_hashes(hashes, K)
    if len(runs) <= 1 or W == 1:
        return runs, np.arange(len(runs))
    w = min(W, len(runs))
    view = np.lib.stride_tricks.sliding_window_view(runs, w)
    at = np.unique(np.arange(len(view)) + view.argmin(axis=1))
    return runs[at], at


def _pack(rows: np.ndarray) -> bytes:
    """Rows as compressed planes of bytes, of each column's differences."""
    planes = []
    for name in rows.dtype.names:
        v = np.ascontiguousarray(rows[name]).view(f"<u{rows.dtype[name].itemsize}")
        planes.append(np.diff(v, prepend=v.dtype.type(0)).view(np.uint8).reshape(len(v), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob, kind: np.dtype) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    rows, at = np.empty(len(data) // kind.itemsize, kind), 0
    for name in kind.names:
        size = kind[name].itemsize
        plane = np.ascontiguousarray(data[at : at + size * len(rows)].reshape(size, -1).T)
        rows[name] = np.cumsum(plane.view(f"<u{size}").ravel(), dtype=f"<u{size}").view(kind[name])
        at += size * len(rows)
    return rows


def _by_bucket(rows: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by the bucket of their keys; rows of a bucket stay in order."""
    at = ((mix64(keys.view(np.uint64)) >> np.uint64(33)) * np.uint64(buckets)) >> np.uint64(31)
    at, order = _sorted_places(at)
    yield from _runs(at, rows, order)


def _by_hash(seeds: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Seeds by the range of their hash; within a bucket, 48 bits of the place in that range stand for the hash."""
    low, high, n = seeds["h"] & np.uint64(0xFFFFFFFF), seeds["h"] >> np.uint64(32), np.uint64(buckets)
    low *= n
    high = high * n + (low >> np.uint64(32))  # hash * buckets is high * 2**32 + the lower half of low
    at, order = _sorted_places(high >> np.uint64(32))
    seeds["h"] = (high & np.uint64(0xFFFFFFFF)) << np.uint64(16) | (low & np.uint64(0xFFFFFFFF)) >> np.uint64(16)
    yield from _runs(at, seeds, order)


def _runs(at: np.ndarray, rows: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    starts = np.flatnonzero(np.concatenate((at[:1] == at[:1], at[1:] != at[:-1])))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield int(at[lo]), rows[order[lo:hi]]


def _sorted_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small keys in order, and the place of each; places of equal keys rise."""
    bits = np.uint64(max(1, len(keys).bit_length()))
    both = np.sort(keys.astype(np.uint64) << bits | np.arange(len(keys), dtype=np.uint64))
    return both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _link_to_first(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The occurrences of each seed in its first document, and links of all others to them (none within one document).

    Where a document has a seed several times, its n-th occurrence is linked to the first document's n-th, counted round and
    round. If the first document has several, ``at`` is negative (``~at``): a chain of that seed alone tries all of them.
    """
    if not len(seeds):
        return seeds, np.zeros(0, LINK)
    bits = np.uint64(max(1, len(seeds).bit_length()))  # the upper bits of each hash, and its place: one quick sort of numbers
    key = np.sort((seeds["h"] >> bits << bits) | np.arange(len(seeds), dtype=np.uint64))
    top, at = key >> bits, (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = top[1:] == top[:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    alone = np.ones(len(seeds), bool)
    alone[at[several]] = False
    firsts, links = _link_groups(seeds[np.sort(at[several])])
    return np.concatenate((seeds[alone], firsts)), links


def _link_groups(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seeds = seeds[np.lexsort((seeds["pos"], seeds["doc"], seeds["h"]))]
    if not len(seeds):
        return seeds, np.zeros(0, LINK)
    group = np.concatenate(([True], seeds["h"][1:] != seeds["h"][:-1]))
    run = np.concatenate(([True], group[1:] | (seeds["doc"][1:] != seeds["doc"][:-1])))
    group_at, run_at = np.flatnonzero(group)[np.cumsum(group) - 1], np.flatnonzero(run)[np.cumsum(run) - 1]
    run_size = np.diff(np.append(np.flatnonzero(run), len(seeds)))[np.cumsum(run) - 1]
    partner = seeds[group_at + (np.arange(len(seeds)) - run_at) % run_size[group_at]]
    other = partner["doc"] != seeds["doc"]
    links = np.zeros(int(other.sum()), LINK)
    links["doc"], links["other"], links["pos"] = seeds["doc"][other], partner["doc"][other], seeds["pos"][other]
    links["at"] = np.where(run_size[group_at][other] > 1, ~partner["pos"][other], partner["pos"][other])
    return seeds[~other], links


def _in_order(rows: np.ndarray) -> np.ndarray:
    """Rows by document and place: numbers next to each other pack well."""
    return rows[np.lexsort((rows["pos"], rows["doc"]))]


def batch_seeds(docs: list[int], texts: list[bytes]) -> np.ndarray:
    """All runs of ``K`` words of texts, without runs across two of them."""
    sizes = np.array([len(t) + 1 for t in texts])
    start, _, words = word_hashes(b"\n".join(texts))
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))  # each text's first word
    n = np.diff(first)
    h, places = seeds_of(words)
    of = np.repeat(np.arange(len(texts)), n)[places]
    pos = places - first[:-1][of]
    inside = pos <= n[of] - K
    out = np.empty(int(inside.sum()), SEED)
    out["h"], out["doc"], out["pos"] = h[inside], np.array(docs, np.int64)[of[inside]], pos[inside]
    return out


def _seed_batches(buckets: int):
    def deal(parts: list[np.ndarray]) -> pa.RecordBatch:
        firsts, links = map(_in_order, _link_to_first(np.concatenate(parts) if parts else np.empty(0, SEED)))
        rows = [(b, False, _pack(x)) for b, x in _by_hash(firsts, buckets)]
        rows += [(b, True, _pack(x)) for b, x in _by_bucket(links, links["doc"].copy(), buckets)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "linked", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        held: tuple[list, list] = ([], [])
        n_bytes = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[0].append(doc)
                held[1].append(words_of(text.as_py()))
                n_bytes += len(held[1][-1])
                if n_bytes >= 1 << 19:
                    parts.append(batch_seeds(*held))
                    size, n_bytes, held = size + len(parts[-1]), 0, ([], [])
                    if size >= PART:
                        yield deal(parts)
                        parts, size = [], 0
        if held[0]:
            parts.append(batch_seeds(*held))
        yield deal(parts)

    return run


def _seed_bucket(buckets: int):
    """Links by document, of the seeds in a bucket and those linked before."""

    def run(table: pa.Table) -> pa.Table:
        parts: dict[bool, list] = {True: [], False: []}
        for linked, blob in zip(table.column("linked").to_pylist(), table.column("blob").combine_chunks()):
            parts[linked].append(_unpack(blob.as_buffer(), LINK if linked else SEED))
        _, links = _link_to_first(np.concatenate(parts[False]) if parts[False] else np.empty(0, SEED))
        links = _in_order(np.concatenate([links, *parts[True]]))
        rows = [(b, _pack(x)) for b, x in _by_bucket(links, links["doc"].copy(), buckets)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def chain_blocks(x: np.ndarray, y: np.ndarray, n: np.ndarray, gap_cost: float = GAP_COST) -> list[tuple[float, list[int]]]:
    """Chains (score, blocks in order) of blocks that start at x and y and are n long, best first, no block in two.

    score(i) = n_i + max(0, score(j) - gap_cost * (distance in x + distance in y)) over blocks j that end before i starts
    in both. The distance is a difference of sums, so the best j is a prefix maximum, which the Fenwick tree keeps.
    """
    m = len(x)
    order = np.lexsort((y, x))
    by_end = np.argsort(x + n, kind="stable")
    ends = np.unique(y + n)
    rank_end, rank_start = np.searchsorted(ends, y + n) + 1, np.searchsorted(ends, y, "right")
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends) + 1)
    score, before = [0.0] * m, [-1] * m
    k = 0
    for i in map(int, order):
        while k < m and x[by_end[k]] + n[by_end[k]] <= x[i]:
            j = int(by_end[k])
            entry = (score[j] + gap_cost * float(x[j] + n[j] + y[j] + n[j]), j)
            at = int(rank_end[j])
            while at <= len(ends):
                if tree[at] < entry:
                    tree[at] = entry
                at += at & -at
            k += 1
        at, best = int(rank_start[i]), (-np.inf, -1)
        while at:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        gain = best[0] - gap_cost * float(x[i] + y[i])
        score[i] = float(n[i]) + max(0.0, gain)
        before[i] = best[1] if gain > 0 else -1
    used, out = [False] * m, []
    for i in sorted(range(m), key=lambda i: -score[i]):
        blocks, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            blocks.append(j)
            j = before[j]
        if blocks:
            out.append((score[i] - (score[j] if j >= 0 else 0.0), blocks[::-1]))
    return out


CHAINS = "doc long, other long, start int, stop int, from_at int, to_at int, again boolean, xs array<int>, ys array<int>, ns array<int>, others array<long>"


def blocks_of(links: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links on one diagonal of a pair of documents, merged to blocks by pair: doc, other, x, y, n, again.

    ``again`` says that the other document has a seed of the block at other places too.
    """
    again = links["at"] < 0
    at = np.where(again, ~links["at"], links["at"]).astype(np.int64)
    doc, other, pos = links["doc"], links["other"], links["pos"].astype(np.int64)
    order = np.lexsort((pos, pos - at, other, doc))
    doc, other, pos, at, again = doc[order], other[order], pos[order], at[order], again[order]
    apart = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (pos[1:] - at[1:] != pos[:-1] - at[:-1])
    start = np.flatnonzero(np.concatenate(([True], apart | (pos[1:] - pos[:-1] > K))))
    stop = np.append(start[1:], len(doc)) - 1
    return doc[start], other[start], pos[start], at[start], pos[stop] - pos[start] + K, np.logical_or.reduceat(again, start)


def _may_chain(x: np.ndarray, n: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """For blocks from ``pair[p]`` to ``pair[p + 1]``: whether two of them may be near enough for one chain.

    A chain is worth at most the pair's words in blocks, so a gap of more than that over the gap cost is never bridged.
    """
    of = np.repeat(np.arange(len(pair) - 1), np.diff(pair))
    order = np.lexsort((x, of))
    total = np.bincount(of, n, len(pair) - 1)
    near = (of[1:] == of[:-1]) & ((x[order][1:] - (x + n)[order][:-1]) * GAP_COST < total[of[1:]])
    out = np.zeros(len(pair) - 1, bool)
    out[of[1:][near]] = True
    return out


def _chain_bucket(least: int):
    """Chains as rows; those of one block, shorter than ``least`` and without other places, as one row for each document."""
    names = [c.split()[0] for c in CHAINS.split(", ")]

    def lists(offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v)) for v in values]

    def run(table: pa.Table) -> pa.Table:
        links = np.concatenate([_unpack(b.as_buffer(), LINK) for b in table.column("blob").combine_chunks()])
        doc, other, x, y, n, again = blocks_of(links)
        pair = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]), [True])))
        chained = _may_chain(x, n, pair)
        order, sizes = [np.flatnonzero(~np.repeat(chained, np.diff(pair)))], []
        for p in np.flatnonzero(chained).tolist():
            lo, hi = int(pair[p]), int(pair[p + 1])
            for _, blocks in chain_blocks(x[lo:hi], y[lo:hi], n[lo:hi]):
                order.append(np.array(blocks) + lo)
                sizes.append(len(blocks))
        sizes = np.concatenate((np.ones(len(order[0]), np.int64), np.array(sizes, np.int64)))
        order = np.concatenate(order)
        doc, other, x, y, n, again = (v[order] for v in (doc, other, x.astype(np.int32), y.astype(np.int32), n.astype(np.int32), again))
        stop = np.cumsum(sizes)
        first, last = stop - sizes, stop - 1
        short = (sizes == 1) & ~again[first] & (n[first] < least)
        some = np.repeat(~short, sizes)
        f, l = first[~short], last[~short]
        ends = [np.maximum(0, x[f] - MARGIN), x[l] + n[l] + MARGIN, np.maximum(0, y[f] - MARGIN), y[l] + n[l] + MARGIN]
        chains_ = [pa.array(doc[f]), pa.array(other[f]), *(pa.array(v.astype(np.int32)) for v in ends), pa.array(again[f] & (sizes[~short] == 1)), *lists(np.concatenate(([0], np.cumsum(sizes[~short]))), x[some], y[some], n[some]), pa.nulls(len(f), pa.list_(pa.int64()))]
        one = first[short]
        one = one[np.argsort(doc[one], kind="stable")]
        own = np.flatnonzero(np.concatenate((np.ones(min(1, len(one)), bool), doc[one][1:] != doc[one][:-1])))
        *places, others = lists(np.append(own, len(one)), x[one], y[one], n[one], other[one])
        singles = [pa.array(doc[one][own]), *(pa.nulls(len(own), t) for t in (pa.int64(), *[pa.int32()] * 4, pa.bool_())), *places, others]
        return pa.concat_tables([pa.table(chains_, names=names), pa.table(singles, names=names)])

    return run


# --- a first look at chains of one seed ----------------------------------------------------------------------------------

REACH = 5


def neighbours(hashes: np.ndarray, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
    """Hashes of the ``REACH`` pairs of words on each side of a block (that ends before ``left`` and starts again at ``right``).

    A pair outside the text is ``none``. Real pairs are neither 0 nor 1.
    """
    pairs = (window_hashes(hashes, 2) >> np.uint64(32)).astype(np.uint32)
    pairs = np.append(np.maximum(pairs, 2), np.uint32(none))
    steps = np.arange(REACH)
    at = np.concatenate((left[:, None] - 2 - steps, right[:, None] + steps), axis=1)
    return pairs[np.where((at >= 0) & (at < len(pairs) - 1), at, len(pairs) - 1)]


def may_go_on(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether ``extend`` gets beyond a block on either side, from the neighbours in both documents."""
    out = np.zeros(len(own), bool)
    for side in (0, REACH):
        for d, e in _STEPS:
            out |= own[:, side + d] == other[:, side + e]
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, xs, ys, ns, others, text) to one row for each single seed, with its neighbours."""
    for batch in batches:
        rows = []
        for doc, text, *found in zip(batch.column(0).to_pylist(), batch.column(5), *(batch.column(k) for k in range(1, 5))):
            x, y, n, other = (v.values.to_numpy() for v in found)
            near = neighbours(word_hashes(words_of(text.as_py()))[2], x, x + n, 0)
            rows.append((np.full(len(x), doc), other, x, y, n, near))
        doc, other, x, y, n, near = (np.concatenate(v) for v in zip(*rows)) if rows else (np.zeros((0, 2 * REACH), t) for t in ("i8", "i8", "i4", "i4", "i4", "u4"))
        near = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * REACH), len(near), [None, pa.py_buffer(near.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.array(v.ravel()[: len(near)]) for v in (doc, other, x, y, n)), near], ["doc", "other", "x", "y", "n", "near"])


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, other, x, y, n, near, text of other), those that may go on, as chains of one block."""
    last, hashes = None, np.zeros(0, np.uint64)
    for batch in batches:
        doc, other, x, y, n = (batch.column(k).to_numpy() for k in range(5))
        there, texts = np.zeros((len(doc), 2 * REACH), np.uint32), batch.column(6)
        cuts = np.flatnonzero(np.concatenate((other[:1] == other[:1], other[1:] != other[:-1])))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)]):
            for k in range(lo, hi):  # rows that repeat an id have texts of their own
                text = texts[k].as_py()
                if text != last:
                    last, hashes = text, word_hashes(words_of(text))[2]
                    there[k:hi] = neighbours(hashes, y[k:hi], y[k:hi] + n[k:hi], 1)
                elif k == lo:
                    there[lo:hi] = neighbours(hashes, y[lo:hi], y[lo:hi] + n[lo:hi], 1)
        own = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32).reshape(-1, 2 * REACH)
        keep = np.flatnonzero(may_go_on(own, there))
        doc, other, x, y, n = (v[keep] for v in (doc, other, x, y, n))
        ends = [np.maximum(0, x - MARGIN), x + n + MARGIN, np.maximum(0, y - MARGIN), y + n + MARGIN]
        each = pa.array(np.arange(len(keep) + 1), pa.int32())
        arrays = [pa.array(doc), pa.array(other), *(pa.array(v.astype(np.int32)) for v in ends), pa.array(np.zeros(len(keep), bool)), *(pa.ListArray.from_arrays(each, pa.array(v)) for v in (x, y, n))]
        yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in CHAINS.split(", ")[:-1]])


# --- alignment -----------------------------------------------------------------------------------------------------------


def align(a: list, b: list) -> int:
    """The most words of two runs that can be matched in order (the longest common subsequence), with a bit for each word.

    Exact for any lengths: a word of ``b`` costs a few operations on an integer with one bit for each word of ``a``.
    """
    common = set(a).intersection(b)
    a, b = [w for w in a if w in common], [w for w in b if w in common]
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places[w]
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


#: Words to go on in both documents after a difference, the nearest places first.
_STEPS = [(d, s - d) for s in range(1, 5) for d in sorted(range(s + 1), key=lambda d, s=s: abs(2 * d - s))]


def extend(a: list, b: list, slack: int = 2, min_identity: float = 0.7) -> tuple[int, int, int]:
    """How far two runs go on together from their starts: (words of a, words of b, matched).

    Equal words are taken; at a difference, the nearest place is tried where two words in turn are equal again. Over more
    than ``slack`` gaps, ``min_identity`` of the words must match up to there.
    """
    i = j = matched = best_i = best_j = best = gaps = 0
    n, m = len(a), len(b)
    while True:
        while i < n and j < m and a[i] == b[j]:
            i, j, matched = i + 1, j + 1, matched + 1
        if matched > best and (gaps <= slack or matched >= min_identity * max(i, j)):
            best_i, best_j, best = i, j, matched
        gaps += 1
        for di, dj in _STEPS:
            p, q = i + di, j + dj
            if p + 1 < n and q + 1 < m and a[p] == b[q] and a[p + 1] == b[q + 1]:
                i, j = p, q
                break
        else:
            return best_i, best_j, best


def align_chain(own: list[bytes], other: list[bytes], start: int, from_at: int, xs: list[int], ys: list[int], ns: list[int], least: int = 12, min_identity: float = 0.7) -> list[tuple[int, int, int, int, int]]:
    """(start, stop, other's start, other's stop, matched words) of an aligned chain; nothing if the words don't agree.

    ``own`` and ``other`` hold the words from places ``start`` and ``from_at`` on. A chain of which less than
    ``min_identity`` matches is cut at its gaps: every run of blocks that is dense enough, and in no longer such run, comes
    out by itself (runs may overlap), if it has ``least`` matched words.
    """
    if len(xs) == 1:  # most chains are one seed and go nowhere
        i, j, c = xs[0] - start, ys[0] - from_at, ns[0]
        if own[i : i + c] != other[j : j + c] or len(own[i : i + c]) < c:
            return []
        left, right = extend(own[:i][::-1], other[:j][::-1], min_identity=min_identity), extend(own[i + c :], other[j + c :], min_identity=min_identity)
        for l, r in ((left, right), ((0, 0, 0), (0, 0, 0))):
            matched = c + l[2] + r[2]
            if matched >= least and matched >= min_identity * (c + max(l[0] + r[0], l[1] + r[1])):
                return [(xs[0] - l[0], xs[0] + c + r[0], ys[0] - l[1], ys[0] + c + r[1], matched)]
        return []
    x, y, n = np.array(xs) - start, np.array(ys) - from_at, np.array(ns)
    m, gap = len(xs), np.zeros(len(xs), np.int64)
    before, after = np.zeros((m, 3), np.int64), np.zeros((m, 3), np.int64)  # extensions of each block where the chain is cut
    between = []
    for k, (i, j, c) in enumerate(zip(x.tolist(), y.tolist(), ns)):
        if own[i : i + c] != other[j : j + c] or len(own[i : i + c]) < c:
            return []
        if k:
            between.append((own[x[k - 1] + ns[k - 1] : i], other[y[k - 1] + ns[k - 1] : j]))
            gap[k] = align(*between[-1])
    before[0] = extend(own[: x[0]][::-1], other[: y[0]][::-1], min_identity=min_identity)
    after[-1] = extend(own[x[-1] + n[-1] :], other[y[-1] + n[-1] :], min_identity=min_identity)
    stop_m = np.cumsum(gap + n)
    start_m = stop_m - n

    def ends(grow: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in both documents and matched words where a run of blocks starts, and where it stops."""
        return np.stack((x, y, start_m), 1) - grow * before, np.stack((x + n, y + n, stop_m), 1) + grow * after

    def spans(i: int, lo: int, starts: np.ndarray, stops: np.ndarray) -> tuple[int, np.ndarray | None]:
        """The last block, from ``lo`` on, at which a dense run from block ``i`` stops."""
        size = stops[lo:] - starts[i]
        dense = np.flatnonzero(size[:, 2] >= min_identity * size[:, :2].max(axis=1))
        return (lo + int(dense[-1]), size[dense[-1]]) if len(dense) else (-1, None)

    found, far, variants = [], -1, [ends(1)]
    if spans(0, m - 1, *variants[0])[0] < 0:
        for k, (a, b) in enumerate(between):
            after[k], before[k + 1] = extend(a, b, min_identity=min_identity), extend(a[::-1], b[::-1], min_identity=min_identity)
        variants = [ends(1), ends(0)]
    for i in range(m):
        if far == m - 1:
            break
        best = max(((*spans(i, max(i, far + 1), *v), -k) for k, v in enumerate(variants)), key=lambda r: (r[0], r[2]))
        if best[0] > far:
            far, size = best[0], best[1]
            at = variants[-best[2]][0][i]
            if size[2] >= least:
                found.append((start + int(at[0]), start + int(at[0] + size[0]), from_at + int(at[1]), from_at + int(at[1] + size[1]), int(size[2])))
    return found


def align_again(own: list[bytes], other: list[bytes], start: int, x: int, y: int, n: int, least: int = 12, min_identity: float = 0.7) -> list[tuple[int, int, int, int, int]]:
    """As ``align_chain``, for one block whose first words stand at several places of ``other`` (all of its words).

    Where the block doesn't hold at ``y``, every other place is tried; the one with the most matched words counts.
    """
    lo = max(0, y - MARGIN)
    found = align_chain(own, other[lo : y + n + MARGIN], start, lo, [x], [y], [n], least, min_identity)
    if found:
        return found
    seed, tried = own[x - start : x - start + K], []
    for at in (i for i, w in enumerate(other) if w == seed[0] and other[i : i + K] == seed):
        lo = max(0, at - MARGIN)
        tried += align_chain(own, other[lo : at + n + MARGIN], start, lo, [x], [at], [K], least, min_identity)
    return sorted(tried, key=lambda r: (-r[4], r))[:1]


def chains(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """Chains of one seed or more between a document and the first one that shares its seeds.

    Those of one block of fewer than ``least`` words come as one row for each document, with ``others`` beside the places.
    """
    buckets = buckets_for(spark, docs, text_col, BUCKET_BYTES)
    kept = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    dealt = kept.mapInArrow(_seed_batches(buckets), "bucket long, linked boolean, blob binary")
    links = dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_seed_bucket(buckets), "bucket long, blob binary")
    return links.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_chain_bucket(least), CHAINS)


def aligned(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, min_identity: float = 0.7) -> DataFrame:
    """Aligned chains with ``least`` matched words, cut where they aren't dense: doc, other, start, stop, other_start,
    other_stop, matched (places in words, stop exclusive).

    A short chain of one seed first takes only hashes of its neighbours to the other document: where ``extend`` can't get
    beyond the seed, it is done. Every other chain takes its slice of the document's words along. Spark splits these joins
    where many chains ask for one document.
    """
    found = materialize(spark, chains(spark, docs, id_col, text_col, least), "chains")
    texts = docs.select(F.col(id_col).cast("long").alias("of"), F.col(text_col).alias("text")).filter("of IS NOT NULL AND text IS NOT NULL")
    chain = ["doc", "other", "start", "from_at", "to_at", "again", "xs", "ys", "ns"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            out = []
            for text, lo, hi in zip(batch.column(9).to_pylist(), batch.column(2).to_pylist(), batch.column(10).to_pylist()):
                if text != last:
                    last, words = text, words_of(text).split()
                out.append(b" ".join(words[lo:hi]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:9], pa.array(out, pa.binary())], [*chain, "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "other", "start", "stop", "other_start", "other_stop", "matched"]
        last, words = None, []
        for batch in batches:
            rows = []
            for doc, other, start, from_at, to_at, again, xs, ys, ns, own, text in zip(*(batch.column(k).to_pylist() for k in range(11))):
                if text != last:
                    last, words = text, words_of(text).split()
                if again:
                    found = align_again(own.split(), words, start, xs[0], ys[0], ns[0], least, min_identity)
                else:
                    found = align_chain(own.split(), words[from_at:to_at], start, from_at, xs, ys, ns, least, min_identity)
                rows += [(doc, other, *r) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names)

    kinds = "doc long, other long, start int, from_at int, to_at int, again boolean, xs array<int>, ys array<int>, ns array<int>"
    singles = found.filter("others IS NOT NULL").join(texts, F.col("doc") == F.col("of")).select("doc", "xs", "ys", "ns", "others", "text")
    signed = singles.mapInArrow(_sign, "doc long, other long, x int, y int, n int, near binary").join(texts, F.col("other") == F.col("of"))
    looked = signed.select("doc", "other", "x", "y", "n", "near", "text").mapInArrow(_look, CHAINS.rpartition(", ")[0])
    found = found.filter("others IS NULL").drop("others").unionByName(looked)
    sliced = found.join(texts, F.col("doc") == F.col("of")).select(*chain, "text", "stop").mapInArrow(cut, f"{kinds}, words binary")
    both = sliced.join(texts, F.col("other") == F.col("of")).select(*chain, "words", "text")
    return both.mapInArrow(run, "doc long, other long, start long, stop long, other_start long, other_stop long, matched long").distinct()


def passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30, min_identity: float = 0.7, join_within: int = 3) -> DataFrame:
    """Passages of a document that an earlier one (smaller id) has too, exactly or nearly.

    Ids are of any type; their order says which document is earlier. Columns: id, ``start``, ``stop`` (places of words, stop exclusive), ``n_words``, ``matched`` (words matched at most once
    for each source), ``sources`` (sorted ids of the earlier documents, one link for each seed's first occurrence) and
    ``spans`` (for each aligned chain: source, start, stop, source's start and stop). Spans that overlap or lie within
    ``join_within`` words merge; a passage has ``min_words`` words at least, ``min_identity`` of an aligned span's words match.
    A passage is sure to be looked at if it has ``K`` equal words in a row; one without (70 % alike with a change every three
    words, say) can be missed, as can one whose ``K``-word runs all occur first in other documents, since each run links to
    its first document only. From one run, ``MARGIN`` words are looked at on both sides.
    Rows with a null id or text, or with few words, find nothing. Rows that repeat an id are one document; a chain counts if
    it holds in any of their texts. Repeats within one document are none across documents.
    """
    docs, names = number_ids(spark, docs.select(id_col, text_col), id_col)
    spans = aligned(spark, docs, id_col, text_col, min_identity=min_identity)
    earlier = Window.partitionBy("doc").orderBy("start", "stop", "other", "other_start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("stop").over(earlier) + join_within, F.lit(True))
    numbered = spans.withColumn("new", new).withColumn("n", F.sum(F.col("new").cast("int")).over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    merged = named_again(numbered, names, "doc", "other").groupBy("doc", "n").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("matched").alias("matched"), F.sort_array(F.collect_set("other")).alias("sources"),
        F.sort_array(F.collect_list(F.struct("other", F.col("start").alias("start"), F.col("stop").alias("stop"), "other_start", "other_stop"))).alias("spans"),
    )
    kept = merged.withColumn("n_words", F.col("stop") - F.col("start")).filter(F.col("n_words") >= min_words)
    return kept.select(F.col("doc").alias(id_col), "start", "stop", "n_words", "matched", "sources", "spans")
