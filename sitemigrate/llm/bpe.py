"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, one after the other, into one deterministic automaton over tokens that accepts exactly the
token sequences that BPE makes. It starts with one state and an arc for every base symbol. The gadget for the merge
(a, b) copies the state behind ``a``, leaves the arc ``b`` out of the copy, leads all ``a`` arcs to the copy, and gives
every state that has an arc ``a`` an arc ``ab`` to where ``b`` led. Two properties keep the tables small:

* all arcs with one label lead to one state, so a state is kept for each label, not for each arc;
* a copy differs from its origin by one arc, so a state is (origin, missing label, time), and whether it has an arc is
  found along the origins, or, for a label made later than the state, along the label's left parts.

A word is encoded from left to right: for each prefix exactly one label can end its path, and the arc tables tell
which. Decoding emits the labels of the arcs that the ids name.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No letters or numbers are assigned from here on.
PLANES = 0x40000
BLANK = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    table = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def other_letters(tokenizer) -> dict[int, str]:
    """Code points that the library's split takes for another class than the regex module does, with one of that class.

    The library is asked for all code points below ``PLANES`` that are not surrogates: for each class of the regex module
    one text of all its characters. Letters and symbols then stay in one piece, numbers alone, where both agree.
    """
    every = "".join(map(chr, [*range(1, 0x27), *range(0x28, 0xD800), *range(0xE000, PLANES)]))
    cut = lambda text: [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    stands = {"letter": "a", "number": "1", "blank": " ", "symbol": "\U000fffff"}

    def kind(c: str) -> str:
        """By what the library does with the character before and after a letter, and twice."""
        pieces = len(cut(f"a{c}{c}"))
        return "letter" if pieces == 1 else "number" if pieces == 3 else "symbol" if cut(f"{c}a") == [(0, 1), (1, 2)] else "blank"

    out = {}
    for name, pattern in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("blank", r"\p{White_Space}"), ("symbol", r"[^\p{L}\p{N}\p{White_Space}]")):
        text = "".join(regex.findall(pattern, every))
        kinds = np.full(len(text), "blank", object)
        for lo, hi in cut(text):  # all characters of a piece are of one class
            kinds[lo:hi] = name if hi - lo == len(text) else kind(text[lo])
        out |= {ord(text[i]): stands[kinds[i]] for i in np.flatnonzero(kinds != name).tolist()}
    return out


class Automaton:
    """The automaton for a list of merges; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        n = max(vocab.values(), default=-1) + 1
        self.ids = vocab
        self.rank, self.left = [-1] * n, [-1] * n
        self.alive = [True] * n
        # The copies made for one label form a chain: their times, and at which place which arc went missing. A state is
        # (label of the chain, place in it); place 0 is the state from which the chain started, one of another chain.
        self.start: list[tuple[int, int]] = [(-1, 0)] * n
        self.times: list[list[int]] = [[] for _ in range(n)]
        self.missing: list[dict[int, int]] = [{} for _ in range(n)]
        for k, (x, y) in enumerate(merges):
            self._gadget(k, vocab[x], vocab[y], vocab[x + y])
        self.n_states = 1 + sum(map(len, self.times))
        self.arcs: dict[int, bool] = {}
        self.width = n

    def behind(self, t: int) -> tuple[int, int]:
        """The state behind label ``t`` by now."""
        return (t, len(self.times[t])) if self.times[t] else self.start[t]

    def _gadget(self, k: int, a: int, b: int, ab: int) -> None:
        self.rank[ab], self.left[ab] = k, a
        if not (self.alive[a] and self.alive[b] and self.has(self.behind(a), b)):
            self.alive[ab] = False
            return
        self.start[ab] = self.behind(b)
        self.times[a].append(k)
        self.missing[a][b] = len(self.times[a])

    def has(self, state: tuple[int, int], t: int) -> bool:
        """Whether a state has an arc labelled ``t``."""
        chain, place = state
        while True:
            if not self.alive[t]:
                return False
            if chain < 0:  # the first state has every arc
                return True
            if self.missing[chain].get(t, place + 1) <= place:
                return False
            place = min(place, bisect_right(self.times[chain], self.rank[t]))
            if place:  # a state of the time when t was made: it got an arc t if it had one for t's left part
                t = self.left[t]
            else:
                chain, place = self.start[chain]

    def follows(self, t: int, u: int) -> bool:
        """Whether ``u`` may follow ``t``: a look-up in the table of arcs, which fills as pairs are asked for."""
        key = t * self.width + u
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            known = self.arcs[key] = self.has(self.behind(t), u)
        return known

    def table(self, suffix: str) -> dict:
        """The letters' transitions: a trie whose nodes are (next letters, label here, label here at a word's end)."""
        root: dict = {}
        for word, t in self.ids.items():
            if self.alive[t]:
                ends = bool(suffix) and word.endswith(suffix)
                node, nexts = None, root
                for c in word[: -len(suffix)] if ends else word:
                    node = nexts.setdefault(c, [{}, -1, -1])
                    nexts = node[0]
                if node:
                    node[2 if ends else 1] = t
        return root

    def encode(self, word: str, table: dict) -> list[int]:
        """The ids of one word of base letters; its last letter takes the word's end.

        Longest labels are tried first. The path to a place is the only one, so a place from which no path leads on is
        never entered again.
        """
        n, arcs, width = len(word), self.arcs, self.width
        out: list[int] = []
        tried: list[tuple[int, list[tuple[int, int]]]] = []
        dead: set[int] = set()
        at, before = 0, -1
        while at < n:
            found, nexts, i = [], table, at
            while i < n:
                node = nexts.get(word[i])
                if node is None:
                    break
                nexts, t, at_end = node
                i += 1
                if i == n:
                    t = at_end
                if t >= 0:
                    found.append((t, i))
            while True:
                while found:
                    t, i = found.pop()
                    if i in dead:
                        continue
                    if before >= 0:
                        go = arcs.get(before * width + t)
                        if go is None:
                            go = self.follows(before, t)
                        if not go:
                            continue
                    break
                else:
                    if not tried:
                        raise ValueError(f"no path spells {word!r}")
                    dead.add(at)
                    at, found = tried.pop()
                    out.pop()
                    before = out[-1] if out else -1
                    continue
                break
            tried.append((at, found))
            out.append(t)
            at, before = i, t
        return out


class Chunks(dict):
    """Ids (little-endian unsigned 32-bit) by blank-free chunk of text; keeps the chunks used last, in bounded memory."""

    def __init__(self, encode, most: int = 250_000):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) < 64:
            self[chunk] = ids
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
        return ids


class Codec:
    """Encodes and decodes as a vocabulary file of the tokenizers library says (BPE with a word-end suffix).

    Supported are the normalizer NFC, blanks to one space, lower case; the split pattern of the file; byte-level letters;
    special tokens that are found in the raw text. Blanks never belong to a piece, so chunks between blanks are encoded
    by themselves.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = self.read(path)
        library = Tokenizer.from_file(path)  # its tables say what a letter is, and how newer characters are normalised
        self.normalise, self.other = library.normalizer.normalize_str, other_letters(library)
        self.others = frozenset(map(chr, self.other))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.table = self.automaton.table(self.suffix)
        self.letters = byte_letters()
        self.words = Chunks(self._word, 250_000)
        self.chunks = Chunks(self._chunk, 250_000)

    def read(self, path: str) -> dict:
        """Takes the rules and labels of a vocabulary file, and returns its model."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a word-end BPE with NFC, blank and case normalisation")
        self.suffix = model["end_of_word_suffix"]
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        return model

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk without blanks, normalised."""
        if chunk.isascii():
            return self.pieces.findall(chunk.lower())
        if chunk.isprintable():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # no final form of sigma
        else:  # among others, characters that are newer than Python's tables
            chunk = self.normalise(chunk)
        if self.others.isdisjoint(chunk):
            return self.pieces.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pieces.finditer(chunk.translate(self.other))]

    def _word(self, piece: str) -> bytes:
        letters = "".join([self.letters[b] for b in piece.encode("utf-8")])
        return array("I", self.automaton.encode(letters, self.table)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(chunk)))

    def _plain(self, text: str) -> bytes:
        parts = text.split()
        if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks for str.split, not for the pattern
            parts = [x for x in BLANK.split(text) if x]
        return b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (null: none), as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The labels of the ids' arcs, as the library joins them where a file has no decoder."""
        return " ".join(map(self.labels.__getitem__, array("I", ids)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, compiled once in a Python process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids`` (array of int), ``decoded`` (null unless ``decode``).

    A null or empty text has no tokens and decodes to the empty string. Rows are kept one by one, repeated or not; null
    ids stay null; other columns are not read. ``vocab_path`` must exist on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [c.encode(x) for x in part.column(1).to_pylist()]
                lists = [array("I", x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array([x.tolist() for x in lists], pa.list_(pa.int32())), pa.array([c.decode(x) if decode else None for x in ids], pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with SHA-256 digests of the ids (32-bit little-endian) and of the decoded text instead.

    The digests are taken beside the codec, so that ids don't cross to the JVM and back.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        sha = hashlib.sha256
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py())
                n.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_text.append(sha(c.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
