import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import empty_documents, odd_documents
from sitemigrate.llm import bpe, packing
from sitemigrate.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tools():
    return bpe.Codec(vocabulary()), packing.BatchCodec(vocabulary()), tokenizers.Tokenizer.from_file(vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=12), st.sampled_from(["<|endoftext|>", "the", "don't", "ing", "\x1c", " ", "Å", "²3", "'s", "  ", ":\U0003d000"])), max_size=8))
def test_codecs_agree_with_the_library(tools, parts):
    text = "".join(parts)
    own, batch, library = tools
    want = library.encode(text, add_special_tokens=False).ids
    assert array("I", own.encode(text)).tolist() == want
    assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)
    assert array("I", batch.encode_all(pa.array([text]))[0]).tolist() == want


def test_every_code_point_is_cut_as_the_library_cuts_it(tools):
    """Each one between letters, and before and after numbers and symbols; the texts of 64 are told apart where they differ."""
    own, batch, library = tools
    every = [chr(x) for x in range(0x110000) if not 0xD800 <= x <= 0xDFFF]
    texts = [" ".join(f"a{c}b {c}{c}1!{c}!" for c in every[lo : lo + 64]) for lo in range(0, len(every), 64)]
    wrong = []
    for lo in range(0, len(texts), 512):
        part = texts[lo : lo + 512]
        for text, e, other in zip(part, library.encode_batch_fast(part, add_special_tokens=False), batch.encode_all(pa.array(part))):
            if not array("I", own.encode(text)).tolist() == array("I", other).tolist() == e.ids:
                wrong.append(text)
    assert wrong == []


def test_newer_characters_in_pairs(tools):
    """Compositions and decompositions of characters that Python's tables may lack."""
    own, batch, library = tools
    rng = random.Random(8)
    odd = [chr(x) for x in range(0x80, 0x32000) if not chr(x).isprintable() and not 0xD800 <= x <= 0xDFFF]
    texts = ["".join(rng.choice((rng.choice(odd), rng.choice("aé\u0301\u0308ΣĞ1'")))  for _ in range(6)) for _ in range(5000)] + [chr(a) + chr(b) for a, b in ((0x113C2, 0x113C2), (0x16121, 0x1611E), (0x16D67, 0x16D67))]
    for text, e, other in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), batch.encode_all(pa.array(texts))):
        assert array("I", own.encode(text)).tolist() == array("I", other).tolist() == e.ids


def naive(symbols, merges):
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        best = min(((rank[p], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if best is None:
            return symbols
        symbols = [*symbols[: best[1]], symbols[best[1]] + symbols[best[1] + 1], *symbols[best[1] + 2 :]]


def test_automaton_of_random_merges():
    rng = random.Random(1)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(25):
            x, y = rng.choice(list(vocab)), rng.choice(list(vocab))
            if x + y not in vocab and len(x + y) < 9:
                vocab[x + y] = len(vocab)
                merges.append((x, y))
        automaton = bpe.Automaton(vocab, merges)
        table = automaton.table("")
        names = {i: t for t, i in vocab.items()}
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            # at a word's end the table looks for labels with the suffix; without one, all labels end a word
            plain = _same_ends(table)
            assert [names[t] for t in automaton.encode(word, plain)] == naive(list(word), merges)


def _same_ends(table):
    def copy(nodes):
        return {c: [copy(n[0]), n[1], n[1]] for c, n in nodes.items()}

    return copy(table)


def test_encoding_odd_documents(spark, tools):
    docs = odd_documents(spark)
    rows = bpe.encode_documents(docs, vocabulary()).collect()
    want = sorted((repr(r["doc_id"]), tools[2].encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), list(r["ids"])) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert bpe.encode_documents(empty_documents(spark), vocabulary()).count() == 0


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_odd_documents(spark, tools):
    docs = odd_documents(spark)
    rows = packing.pack_documents(spark, docs, vocabulary(), with_ids=True).collect()
    check_places(rows, 4096)
    want = []
    for r in docs.collect():
        ids = [*tools[2].encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(repr(r["doc_id"]), k // 4096, k, ids[k : k + 4096]) for k in range(0, len(ids), 4096)]
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], list(r["ids"])) for r in rows) == sorted(want)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    assert packing.pack_documents(spark, empty_documents(spark), vocabulary()).count() == 0


def expand(rows):
    return [{"sequence_id": first + k, "offset": offset, "length": length, "rank": rank + k} for length, rank, n, first, offset in rows for k in range(n)]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.data())
def test_plans_place_every_rank_once(capacity, data):
    counts = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 30), max_size=12))
    rows, n = packing.plan(counts, capacity)
    places = expand(rows)
    assert sorted((p["length"], p["rank"]) for p in places) == sorted((length, k) for length, m in counts.items() for k in range(m))
    assert check_places(places, capacity) == n
    total = sum(length * m for length, m in counts.items())
    assert -(-total // capacity) <= n <= 2 * (total // capacity) + 1


@pytest.mark.parametrize("counts, best", [({4000: 5, 96: 5}, 5), ({4000: 5, 50: 5, 46: 5}, 5), ({4000: 3, 40: 3, 30: 3, 26: 3}, 3), ({2048: 7}, 4), ({4096: 2}, 2), ({1: 4097}, 2), ({}, 0)])
def test_exact_complements_are_found(counts, best):
    assert packing.plan(counts)[1] == best
