"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays.

The statistics of a text are counted with numpy from its bytes. The trees are fitted on a bounded sample of labelled
documents (``max_labels``, by the hash of their ids) and held as plain arrays, so that a batch of documents walks down
all trees at once. Features that only speak against a document (symbols, repeats, shouting) are monotone: the score
never rises with them, whatever the sample says.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitemigrate.llm.common import free_name, hash_sample, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
#: (name, -1 if the score may only fall as the feature rises, else 0)
FEATURES = [
    ("log_words", 0), ("mean_word", 0), ("symbols_per_word", -1), ("dup_line_share", -1), ("repeat_share", -1), ("distinct_share", 0), ("top_word_share", -1),
    ("upper_share", -1), ("digit_share", -1), ("calls_per_word", -1), ("stops_per_word", 0), ("words_per_line", 0), ("longest_word", 0),
]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts (in the order of ``BASE``) and the features of a text; a null text is empty."""
    data = (text or "").encode("utf-8")
    start, end, h = word_hashes(data)
    n = len(h)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    word_chars = int(len(data) - count[0x80:0xC0].sum() - count[0x20] - count[0x09:0x0E].sum())
    symbols = int(sum(count[b] for b in SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        _, at, times = np.unique(window_hashes(h, 3), return_inverse=True, return_counts=True)
        again = times[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeat = int(covered.sum())
    _, times = np.unique(h, return_counts=True)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    features = [
        float(np.log1p(n)), word_chars / n, symbols / n, dup_lines / len(lines), repeat / n, len(times) / n, float(times.max()) / n,
        upper / max(upper + lower, 1), float(count[48:58].sum()) / max(word_chars, 1), float(count[33] + count[63]) / n, float(count[44] + count[46]) / n, n / len(lines), float((end - start).max()),
    ]
    return [n, word_chars, symbols, dup_lines, repeat], features


def base_failed(base: np.ndarray) -> np.ndarray:
    """The fixed rules: fewer than 50 words, or more than half of them within repeated runs of three."""
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability that a document is good, for rows of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        z = self.bias + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss, split on quantile bins by gradient and curvature.

    A split on a constrained feature must keep its leaves' values in order, and bounds below it keep them so. With no
    rows, or rows of one class, the trees are empty and the bias decides (all good where nothing is known).
    """
    n, m = x.shape if x.ndim == 2 else (0, len(monotone))
    good = float(y.sum()) if n else 0.0
    bias = float(np.log((good + 0.5) / (n - good + 0.5))) if n else 20.0
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if n and 0 < good < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1)  # code <= k if x <= cuts[k]
        flat = code + np.arange(m) * (bins + 1)
        z = np.full(n, bias)

        def leaf(v: float) -> int:
            k = len(feature)
            for into, what in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, rate * v)):
                into.append(what)
            return k

        def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
            g, h = grad[rows], hess[rows]
            sum_g, sum_h = g.sum(), h.sum()
            own = float(np.clip(-sum_g / (sum_h + ridge), lo, hi))
            if level == depth or sum_h < 2 * least:
                k = leaf(own)
                z[rows] += value[k]
                return k
            size = m * (bins + 1)
            index = flat[rows].ravel()
            at_g = np.bincount(index, np.repeat(g, m), size).reshape(m, bins + 1).cumsum(axis=1)
            at_h = np.bincount(index, np.repeat(h, m), size).reshape(m, bins + 1).cumsum(axis=1)
            rest_g, rest_h = sum_g - at_g, sum_h - at_h
            v_left, v_right = (np.clip(-a / (b + ridge), lo, hi) for a, b in ((at_g, at_h), (rest_g, rest_h)))
            loss = lambda a, b, v: a * v + 0.5 * (b + ridge) * v * v
            gain = loss(sum_g, sum_h, own) - loss(at_g, at_h, v_left) - loss(rest_g, rest_h, v_right)
            order = np.array(monotone)[:, None]
            gain[(at_h < least) | (rest_h < least) | (order * (v_right - v_left) < 0)] = -1
            for j in range(m):
                gain[j, len(cuts[j]) :] = -1
            j, cut = divmod(int(gain.argmax()), bins + 1)
            if gain[j, cut] <= 1e-6:
                k = leaf(own)
                z[rows] += value[k]
                return k
            k = leaf(0.0)
            mid = (v_left[j, cut] + v_right[j, cut]) / 2
            below, above = ((lo, mid), (mid, hi)) if monotone[j] > 0 else ((mid, hi), (lo, mid)) if monotone[j] < 0 else ((lo, hi), (lo, hi))
            goes = code[rows, j] <= cut
            feature[k], threshold[k] = j, float(cuts[j][cut])
            left[k] = grow(rows[goes], level + 1, *below)
            right[k] = grow(rows[~goes], level + 1, *above)
            return k

        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
    if not roots:
        for into, what in ((feature, 0), (threshold, np.inf), (left, 0), (right, 0), (value, 0.0), (roots, 0)):
            into.append(what)
    return Trees(np.array(roots), np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value, float), bias, depth)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(x.as_py())[1] for x in texts], pa.list_(pa.float64()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 20_000) -> Trees:
    """Trees fitted on at most ``max_labels`` labelled documents, those with the smallest hashes of their ids.

    Labels with a null id or value are left out; of a repeated id, the smallest label counts and one of its texts.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).dropna()
    sample = hash_sample(known, ["__id", "__label"], max_labels)
    sample = sample.groupBy("__id").agg(F.min("__label").alias("__label"))
    labelled = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")  # at most max_labels rows
    rows = labelled.select("__id", "__label", _features("__text").alias("x")).groupBy("__id", "__label").agg(F.min("x").alias("x")).orderBy("__id").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r["__label"] > 0) for r in rows]), [m for _, m in FEATURES])



def verdicts(trees: Trees, threshold: float = 0.5):
    """A column function: the base counts, ``base_failed``, ``kept`` and ``score`` of a text, as one struct."""
    kinds = {**dict.fromkeys(BASE, T.LongType()), "base_failed": T.BooleanType(), "kept": T.BooleanType(), "score": T.DoubleType()}

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in kinds.items()]))
    def run(texts: pa.Array) -> pa.Array:
        both = [statistics(x.as_py()) for x in texts]
        base = np.array([b for b, _ in both], np.int64).reshape(len(both), len(BASE))
        score = trees.score(np.array([f for _, f in both], float).reshape(len(both), len(FEATURES)))
        failed = base_failed(base)
        arrays = [*(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
        return pa.StructArray.from_arrays(arrays, [*BASE, "base_failed", "kept", "score"])

    return run


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, base counts, ``base_failed``, ``kept``, ``score``. A null or empty text fails the base rules."""
    return docs.select(F.col(id_col), verdicts(trees, threshold)(F.col(text_col)).alias("__verdict")).select(id_col, "__verdict.*")


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns as they were."""
    name = free_name(docs, "verdict")
    return docs.withColumn(name, verdicts(trees, threshold)(F.col(text_col))).filter(F.col(name)["kept"]).select(*docs.columns)
