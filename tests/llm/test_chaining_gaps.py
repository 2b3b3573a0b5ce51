"""Passages that chain over long gaps."""

import random

from cases import documents, words
from sitemigrate.llm import chaining


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_alignment_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        assert chaining.align(a, b) == brute_lcs(a, b)
    a = [rng.randrange(400) for _ in range(900)]
    b = [rng.randrange(400) if rng.random() < 0.2 else w for w in a]
    assert chaining.align(a, b) == brute_lcs(a, b) > 700


def test_header_and_footer_with_other_words_between(spark):
    rng = random.Random(21)
    head, foot = words(rng, 60), words(rng, 60)
    got = chaining.passages(spark, documents(spark, [(i, f"{head} {words(rng, 150)} {foot}") for i in (1, 2)])).collect()
    spans = sorted((r["doc_id"], r["start"], r["stop"]) for r in got)
    assert [s[0] for s in spans] == [2, 2]
    assert spans[0][1] == 0 and 60 <= spans[0][2] <= 64 and 206 <= spans[1][1] <= 210 and spans[1][2] == 270


def test_long_insertion_between_exact_halves(spark):
    rng = random.Random(22)
    one, two = words(rng, 500), words(rng, 500)
    got = chaining.passages(spark, documents(spark, [(1, f"{one} {two}"), (2, f"{one} {words(rng, 600)} {two}")])).collect()
    spans = sorted((r["doc_id"], r["start"], r["stop"]) for r in got)
    assert len(spans) == 2 and spans[0][1] == 0 and 500 <= spans[0][2] <= 504 and 1096 <= spans[1][1] <= 1100 and spans[1][2] == 1600


def test_long_gap_without_seeds_counts_what_matches(spark):
    """250 words of which every fifth is another one: no seed in them, more than 40,000 pairs of words."""
    rng = random.Random(23)
    one, gap, two = words(rng, 60), words(rng, 250).split(), words(rng, 60)
    other = [w if k % 5 else f"new{k}" for k, w in enumerate(gap)]
    got = chaining.passages(spark, documents(spark, [(1, f"{one} {' '.join(gap)} {two}"), (2, f"{one} {' '.join(other)} {two}")])).collect()
    assert [(r["doc_id"], r["start"], r["stop"], r["matched"]) for r in got] == [(2, 0, 370, 320)]
