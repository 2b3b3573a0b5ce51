import random

import pytest
import xxhash

from cases import documents, empty_documents, odd_documents, words
from sitemigrate.llm import line_dedup, simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for k in range(64):
            n[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * n[k] > len(shingles))


def brute_components(prints):
    """Label (index of the first row reached) of each row, by all pairs."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def brute_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    labels = brute_components(prints)
    least = {}
    for (i, _), label in zip(rows, labels):
        if i is not None:
            least[label] = min(least.get(label, i), i)
    return sorted(((i, format(p, "016x"), least.get(label)) for (i, _), p, label in zip(rows, prints, labels)), key=repr)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        text = words(rng, rng.randint(20, 200)).split()
        for c in range(rng.randint(1, 6)):
            other = list(text)
            for _ in range(c % 3):
                other[rng.randrange(len(other))] = words(rng, 1)
            rows.append((len(rows), " ".join(other)))
    rows += [(100, None), (101, ""), (102, "a"), (103, "A b")]
    got = simhash.near_duplicates(spark, documents(spark, rows))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=repr) == brute_groups(rows)


@pytest.mark.parametrize("blocks", [1, 2, 4])
def test_links_of_chosen_distances(spark, blocks):
    rng = random.Random(blocks)
    prints = []
    for _ in range(40):
        centre = rng.getrandbits(64)
        prints.append(centre)
        for d in (1, 2, 3, 3, 3, 4, 5):
            prints.append(centre ^ sum(1 << b for b in rng.sample(range(64), d)))
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(spark, df, blocks)
    labels = {r["v"]: r["label"] for r in simhash.components(spark, edges).collect()}
    got, want = {}, {}
    for s, label in zip(signed, brute_components(prints)):
        got.setdefault(labels.get(s, s), set()).add(s)
        want.setdefault(label, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "a long, b long")
    assert {r["label"] for r in simhash.components(spark, edges).collect()} == {0}
    assert simhash.components(spark, edges.limit(0)).count() == 0


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = simhash.near_duplicates(spark, docs).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == brute_groups(rows)
    kept = simhash.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute_components([brute_fingerprint(t) for _, t in rows])))
    assert simhash.near_duplicates(spark, empty_documents(spark)).count() == 0
    assert simhash.drop_near_duplicates(spark, empty_documents(spark)).count() == 0


def brute_lines(rows):
    """(id, text) to (n_lines, n_removed, text) for distinct rows."""
    seen, out = {}, {}
    distinct = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in distinct:
        lines = t.split("\n")
        counted = [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        for a, b, c in zip(counted, counted[1:], counted[2:]):
            seen.setdefault((a[1], b[1], c[1]), []).append(((i, t), (a[0], b[0], c[0])))
    gone = {}
    for places in seen.values():
        for who, at in places[1:]:
            gone.setdefault(who, set()).update(at)
    for who in distinct:
        lines = who[1].split("\n")
        lost = gone.get(who, set())
        out[who] = (len(lines), len(lost), "\n".join(x for k, x in enumerate(lines) if k not in lost) if lost else who[1])
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    pool = [words(rng, 5) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", " \t"]) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "a\r\nb \n\tc\n")]
    got = {(r["doc_id"]): (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(spark, documents(spark, rows)).collect()}
    want = brute_lines(rows)
    assert got.pop(200) == (0, 0, None)
    assert got == {i: v for (i, _), v in want.items()}


def test_lines_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = line_dedup.dedup_lines(spark, docs)
    assert [c for c in got.columns if c not in ("n_lines", "n_removed")] == [c for c in docs.columns if c != "n_lines"]
    rows = got.collect()
    assert len(rows) == docs.count()
    again = next(r for r in rows if r["doc_id"] == 15)
    assert (again["n_lines"], again["n_removed"], again["text"]) == (8, 3, "a\nb\nc\n\n")
    assert line_dedup.dedup_lines(spark, empty_documents(spark)).count() == 0


def test_a_window_keeps_its_first_occurrence(spark):
    rows = [(1, "x\na\nb\nc\nd\ny"), (2, "a\nb\nc\nd"), (3, "q\n\na\n\nb\nc\nq")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark, documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "q\n\n\nq"}
