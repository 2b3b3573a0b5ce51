"""Short passages with many changes."""

import random

import numpy as np
import pytest

from cases import documents, words
from sitemigrate.llm import chaining


@pytest.mark.parametrize("every", [6, 8, 10])
def test_short_passages_with_a_word_changed_in_every_few(spark, every):
    rng = random.Random(every)
    rows, wanted = [], {}
    for i in range(40):
        n = rng.randint(30, 50)
        passage = words(rng, n).split()
        changed = [f"new{i}x{k}" if k % every == every - 1 else w for k, w in enumerate(passage)]
        rows += [(i, f"{words(rng, 40)} {' '.join(passage)} {words(rng, 40)}"), (100 + i, f"{words(rng, 20)} {' '.join(changed)} {words(rng, 20)}")]
        wanted[100 + i] = (20, 20 + n - (n % every == 0))
    got = {r["doc_id"]: r for r in chaining.passages(spark, documents(spark, rows), min_words=29).collect()}
    assert set(got) == set(wanted)
    assert all(got[i]["sources"] == [i - 100] and got[i]["start"] <= a and got[i]["stop"] >= b - 2 and got[i]["n_words"] <= b - a + 8 for i, (a, b) in wanted.items())


def test_one_seed_opens_a_passage(spark):
    """Five equal words in a row, once; every fourth word changed elsewhere (77 % alike)."""
    rng = random.Random(31)
    passage = words(rng, 45).split()
    changed = [f"new{k}" if k % 4 == 3 and k != 23 else w for k, w in enumerate(passage)]
    got = chaining.passages(spark, documents(spark, [(1, f"{words(rng, 40)} {' '.join(passage)}"), (2, f"{words(rng, 30)} {' '.join(changed)} {words(rng, 30)}")])).collect()
    assert [(r["doc_id"], r["sources"]) for r in got] == [(2, [1])] and got[0]["start"] <= 32 and got[0]["stop"] >= 73


def test_packed_rows_come_back():
    rng = np.random.default_rng(0)
    for n in (1, 50):
        for kind in (chaining.SEED, chaining.LINK):
            rows = np.frombuffer(rng.bytes(n * kind.itemsize), kind)
            assert (chaining._unpack(chaining._pack(rows), kind) == rows).all()


def test_a_seed_that_stands_earlier_in_the_first_document_too(spark):
    """The one seed of a passage stands at three places of the first document; the passage is at the second."""
    rng = random.Random(37)
    passage = words(rng, 45).split()
    changed = [f"new{k}" if k % 4 == 3 and k != 23 else w for k, w in enumerate(passage)]
    seed = " ".join(passage[20:27])
    first = f"{words(rng, 40)} {seed} {words(rng, 60)} {' '.join(passage)} {words(rng, 60)} {seed} {words(rng, 30)}"
    got = chaining.passages(spark, documents(spark, [(1, first), (2, f"{words(rng, 30)} {' '.join(changed)} {words(rng, 30)}")])).collect()
    assert [(r["doc_id"], r["sources"]) for r in got] == [(2, [1])] and got[0]["start"] <= 32 and got[0]["stop"] >= 73


def test_a_repeated_passage_links_round_and_round(spark):
    rng = random.Random(38)
    passage = words(rng, 40)
    rows = [(1, f"{words(rng, 30)} {passage} {words(rng, 30)} {passage}"), (2, " ".join(f"{words(rng, 50)} {passage}" for _ in range(5)))]
    got = sorted((r["start"], r["stop"]) for r in chaining.passages(spark, documents(spark, rows)).collect())
    assert len(got) == 5 and all(50 + 90 * k - 3 <= a <= 50 + 90 * k and 90 + 90 * k <= b <= 93 + 90 * k for k, (a, b) in enumerate(got))


def test_batches_of_texts_have_the_seeds_of_each_text():
    rng = random.Random(39)
    texts = [chaining.words_of(t) for t in ("", words(rng, 4), words(rng, 60), " \n", words(rng, 5), words(rng, 33))]
    got = chaining.batch_seeds([7, 3, 5, 1, 9, 2], texts)
    want = [(h, doc, pos) for doc, t in zip([7, 3, 5, 1, 9, 2], texts) for h, pos in zip(*(x.tolist() for x in chaining.seeds_of(chaining.word_hashes(t)[2])))]
    assert got.tolist() == want


def test_links_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(50):
        rows = {(int(rng.integers(6)), int(rng.integers(30))): int(rng.integers(12)) * 0x9E3779B97F4A7C15 % (1 << 64) for _ in range(int(rng.integers(60)))}
        seeds = np.array([(h, d, p) for (d, p), h in rows.items()], chaining.SEED)
        firsts, links = chaining._link_to_first(seeds)
        want_firsts, want = set(), set()
        for h in set(rows.values()):
            by_doc = {}
            for (d, p), x in sorted(rows.items()):
                if x == h:
                    by_doc.setdefault(d, []).append(p)
            first = min(by_doc)
            want_firsts |= {(h, first, p) for p in by_doc[first]}
            ps = by_doc[first]
            want |= {(d, first, p, ps[k % len(ps)] if len(ps) == 1 else ~ps[k % len(ps)]) for d, own in by_doc.items() if d != first for k, p in enumerate(own)}
        assert set(firsts.tolist()) == want_firsts and set(links.tolist()) == want and len(links) == len(want)


def test_ids_of_other_types(spark):
    rng = random.Random(41)
    passage = words(rng, 60)
    rows = [(f"d{i}", f"{words(rng, 30)} {passage if i in (3, 7, 9) else words(rng, 60)}") for i in range(10)] + [(None, passage)]
    got = chaining.passages(spark, spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["sources"]) for r in got) == [("d7", ["d3"]), ("d9", ["d3"])]
    assert all(x["other"] == "d3" for r in got for x in r["spans"])
