import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import documents, empty_documents, odd_documents, words
from sitemigrate.llm import bottom_k, merkle, periodic_runs


def brute_near_duplicates(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def family(rng, n):
    """Copies of one text with changed words, cuts and additions; many are near the threshold."""
    base, rows = [f"w{rng.randrange(900)}" for _ in range(100)], []
    for c in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            a = rng.randrange(80)
            del w[a : a + rng.randint(1, 18)]
        if rng.random() < 0.2:
            w += [f"y{rng.randrange(20)}" for _ in range(rng.randint(1, 25))]
        rows.append((c, " ".join(w)))
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    rows = family(rng, 120) + [(1000 + i, words(rng, rng.randint(1, 60))) for i in range(30)] + [(2000, None), (2001, " \t"), (2002, "One Two"), (2003, "one two"), (2004, "one two three"), (2004, "again")]
    got = bottom_k.near_duplicates(spark, documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near_duplicates(rows)


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_near_duplicates_take_odd_rows(spark, make):
    docs = make(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = bottom_k.near_duplicates(spark, docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near_duplicates(rows)
    text_ids = bottom_k.near_duplicates(spark, docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert text_ids.count() == len(rows)


def brute_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 12, 40, 150])
            w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(np.array(w, np.int64))
        least = rng.choice([12, 12, 4])
        for w, found in zip(docs, periodic_runs.find_runs(docs, least)):
            assert [tuple(r) for r in found.tolist()] == sorted(brute_runs(w.tolist(), least), key=lambda r: (r[0], r[2]))


def test_grammar_gives_its_sequence_back_and_answers_extensions():
    rng = random.Random(4)
    s = np.array([-1, *(rng.randrange(2) for _ in range(600)), -2])
    grammar = periodic_runs.Grammar(s)
    sequence = grammar.sym[-1]
    for level in range(len(grammar.sym) - 1, 0, -1):
        parts = []
        below = grammar.sym[level - 1]
        for symbol, a, b in zip(sequence.tolist(), grammar.first[level].tolist(), grammar.end[level].tolist()):
            left, right = grammar.rules[level][symbol].tolist()
            parts += [left, right] if len(below[a:b]) == 2 and below[a] != below[a + 1] else [left] * (b - a)
        assert parts == below.tolist()
        sequence = below
    i = np.array([rng.randrange(1, 500) for _ in range(400)])
    j = i + np.array([rng.randrange(1, 100) for _ in range(400)])
    after, before = grammar.extend(i, j), grammar.mirrored().extend(i, j)
    for x, y, f, b in zip(i.tolist(), j.tolist(), after.tolist(), before.tolist()):
        assert f == next(k for k in range(700) if s[x + k] != s[y + k])
        assert b == next(k for k in range(700) if s[x - 1 - k] != s[y - 1 - k])


def test_runs_of_odd_rows_and_of_a_text_of_one_word(spark):
    docs = odd_documents(spark).select("doc_id", "text").union(spark.createDataFrame([(99, "a " * 30_000), (98, "x y " * 6)], "doc_id long, text string"))
    got = {(r["doc_id"], r["n_words"]): r for r in periodic_runs.periodic_runs(docs).collect()}
    assert got[99, 30_000]["runs"] == [(0, 30_000, 1)] and got[99, 30_000]["collapsed"] == "a"
    assert got[98, 12]["runs"] == [(0, 12, 2)] and got[98, 12]["collapsed"] == "x y"
    assert len(got[5, 0]["runs"]) == 0 and got[5, 0]["collapsed"] == ""
    digests = periodic_runs.digests(periodic_runs.periodic_runs(docs)).collect()
    assert len(digests) == docs.count()
    assert {r["runs_sha256"] for r in digests if r["n_runs"] == 0} == {hashlib.sha256(b"").hexdigest()}
    assert periodic_runs.periodic_runs(empty_documents(spark)).count() == 0


def test_planted_runs_follow_the_rule(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 40))) for i in range(80)] + [(None, "a b"), (200, None)]
    got = {r["doc_id"]: r["text"] for r in periodic_runs.with_planted_runs(documents(spark, rows)).collect()}
    for i, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            assert got[i].split() == [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        else:
            assert got[i] == text


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows, columns):
    """(id, leaf, subroot, root, proof) by whole trees."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        steps = []
        for nodes in levels[:-1]:
            run = i - i % 8
            steps.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
            i //= 8
        return steps

    groups = {}
    for r in rows:
        leaf = sha("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in columns))
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, doc_id) in enumerate(sorted(groups[g])):
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], path(trees[g], i) + path(top, k)))
    return sorted(out, key=repr)


def test_manifest_against_whole_trees(spark):
    rng = random.Random(7)
    sizes = {None: 1, "": 3, "de": 70, "en": 700, "fr": 9, "é": 8, **{f"l{k}": rng.randint(1, 90) for k in range(14)}}
    rows = [(rng.randrange(10**6) if rng.random() < 0.99 else None, words(rng, 3) if rng.random() < 0.9 else None, lang, "s" if rng.random() < 0.5 else None, 5) for lang, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    got = merkle.manifest(spark, docs, columns, block_levels=1).collect()  # partitions of 8 leaves: ragged rounds on every level
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in got), key=repr) == brute_manifest([r.asDict() for r in docs.collect()], columns)


def test_audit_finds_what_was_tampered_with(spark):
    rows = [(i, "Text A" if i % 2 else "text", ("en", None)[i % 2], "s", 4) for i in range(40)]
    docs = spark.createDataFrame([*rows, (7, None, "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in merkle.audit(spark, docs, merkle.tampered_third()).collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["doc_id"] % 2 == 1 and r["lang"] is None
        assert r["verified"] is not changed and (r["folded_root"] == r["root"]) is not changed


@pytest.mark.parametrize("make", [odd_documents, empty_documents])
def test_manifest_takes_odd_rows(spark, make):
    docs = make(spark)
    got = merkle.audit(spark, docs, F.col("text")).collect()
    assert len(got) == docs.count() and all(r["verified"] for r in got)
