import collections
import math
import random
import zlib

import numpy as np
import pytest

from cases import documents, empty_documents, odd_documents, words
from sitemigrate.llm import chaining, hpylm


def brute_chain(x, y, n, cost):
    best = [0.0] * len(x)
    for i in sorted(range(len(x)), key=lambda i: (x[i], y[i])):
        before = [best[j] - cost * (x[i] - x[j] - n[j] + y[i] - y[j] - n[j]) for j in range(len(x)) if x[j] + n[j] <= x[i] and y[j] + n[j] <= y[i]]
        best[i] = n[i] + max([0.0, *before])
    return max(best)


def test_chains_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        m = int(rng.integers(1, 25))
        x, y, n = rng.integers(0, 120, m), rng.integers(0, 120, m), rng.integers(1, 15, m)
        chains = chaining.chain_blocks(x, y, n)
        assert chains[0][0] == pytest.approx(brute_chain(x, y, n, chaining.GAP_COST))
        assert sorted(b for _, blocks in chains for b in blocks) == list(range(m))
        for _, blocks in chains:
            assert all(x[a] + n[a] <= x[b] and y[a] + n[a] <= y[b] for a, b in zip(blocks, blocks[1:]))


def test_equal_runs_share_a_seed():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 60, chaining.K + chaining.W - 1).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate((rng.integers(0, 1 << 60, int(rng.integers(0, 40))).astype(np.uint64), shared, rng.integers(0, 1 << 60, int(rng.integers(0, 40))).astype(np.uint64))) for _ in range(2))
        assert set(chaining.seeds_of(a)[0].tolist()) & set(chaining.seeds_of(b)[0].tolist())


def test_extension_bridges_edits():
    assert chaining.extend([1, 2, 9, 3, 4, 5], [1, 2, 3, 4, 5]) == (6, 5, 5)
    assert chaining.extend([1, 2, 9, 3, 4], [1, 2, 8, 3, 4, 7]) == (5, 5, 4)
    assert chaining.extend([1], [2]) == (0, 0, 0) and chaining.extend([], [1]) == (0, 0, 0)


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(11)
    passage = words(rng, 70).split()
    fuzzy = list(passage)
    for k in (9, 20, 33, 48, 60):
        fuzzy[k] = "changed"
    del fuzzy[40]
    fuzzy.insert(15, "added")
    rows = [(i, words(rng, 150)) for i in range(40)]
    rows += [(50, f"{words(rng, 40)} {' '.join(passage)} {words(rng, 40)}"), (51, f"{words(rng, 20)} {' '.join(passage).upper()}"), (52, f"{words(rng, 30)}\n{' '.join(fuzzy)} {words(rng, 10)}")]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, " ".join(rows[4][1].split()[:20])), (70, "same " * 500), (71, "same " * 300), (80, None), (81, "")]
    rows += [(90 + i, f"{words(rng, 25)} {' '.join(passage)}") for i in range(30)]
    return {r["doc_id"]: r for r in chaining.passages(spark, documents(spark, rows, 5)).collect()}


def test_passages_are_found_with_their_edges(found):
    assert (found[51]["start"], found[51]["stop"], found[51]["sources"]) == (20, 90, [50])
    assert found[52]["sources"] == [50] and found[52]["start"] <= 32 and found[52]["stop"] >= 98 and found[52]["matched"] >= 60
    assert all(20 <= found[90 + i]["start"] <= 25 and found[90 + i]["stop"] == 95 for i in range(30))  # a word or two before may be alike


def test_copies_link_to_the_first_and_clean_documents_stay(found):
    assert (found[60]["n_words"], found[60]["sources"], found[61]["sources"]) == (150, [3], [3])
    assert 62 not in found and 50 not in found and not any(i < 40 for i in found)
    assert found[71]["sources"] == [70]


def test_odd_documents_find_copies_only(spark):
    got = chaining.passages(spark, odd_documents(spark)).collect()
    assert {r["doc_id"] for r in got} == {2, 3, 13} and all(r["sources"] == [1] for r in got)
    assert chaining.passages(spark, empty_documents(spark)).count() == 0


# --- language model ------------------------------------------------------------------------------------------------------


def brute_base(rows):
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    count = collections.Counter(w for (_, t), h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    return sorted(((i, h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for (i, t), h in zip(tokens, held)), key=repr)


def taken(scored):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored), key=repr)


def test_base_scores_and_perplexity(spark):
    rng = random.Random(13)
    vocabulary = words(rng, 40).split()
    after = {w: rng.sample(vocabulary, 3) for w in vocabulary}
    rows = []
    for i in range(150):
        text = [rng.choice(vocabulary)]
        while len(text) < 60:
            text.append(rng.choice(after[text[-1]]))
        rows.append((i, " ".join(text)))
    scored = hpylm.score_documents(spark, documents(spark, rows)).collect()
    assert taken(scored) == brute_base(rows)
    held = [r for r in scored if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in scored)


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, 50)) for i in range(40)]
    one, two = (sorted((r["doc_id"], round(r["score"], 6)) for r in hpylm.score_documents(spark, documents(spark, rows, n)).collect()) for n in (1, 6))
    assert one == two


def test_odd_documents_and_no_training(spark):
    docs = odd_documents(spark)
    assert taken(hpylm.score_documents(spark, docs).collect()) == brute_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert hpylm.score_documents(spark, empty_documents(spark)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = hpylm.score_documents(spark, documents(spark, [(only, "a b")])).first()
    assert (row["n_known"], row["train_tokens"], row["held_out"]) == (0, 0, True) and row["score"] <= 0


def test_predictive_probabilities_sum_to_one():
    """Over all known words and the unknown one, for each context of a bucket with all words: a text's start, and classes."""
    rng = np.random.default_rng(2)
    v, contexts = 30, np.array([0, 1, 4], np.uint32)  # the start belongs to class 0, which is context 1
    count = rng.integers(0, 4, (v, 3)) * (rng.random((v, 3)) < 0.7)
    count[:, 0] += 1
    cells = hpylm.pack(np.full(v, -1, np.int32), count.sum(axis=1), np.full(v, 3, np.uint32), np.tile(contexts, v), count.ravel().astype(np.uint32))
    model = hpylm.Model(0, int(count.sum()), v, hpylm.classes_of(np.zeros(0, np.int64)), 5, [])
    n = len(model.classes)
    for _ in range(3):
        bucket = hpylm.Bucket(0, cells, model)
        *_, drawn = bucket.draws()
        assert [x.tolist() for x in vars(bucket.unpacked(bucket.packed(drawn))).values()][:5] == [x.tolist() for x in vars(drawn).values()][:5]
        sums = bucket.sums(drawn)
        model.states.append(hpylm.State(sums[:n], sums[n : 2 * n], np.zeros(0), np.zeros(0), float(sums[4 * n]), float(sums[4 * n + 1]), (0.6, 0.5, 0.4), (1.5, 1.0, 0.7)))
    p = 10 ** hpylm.Bucket(0, cells, model).log10_predictive(1).reshape(v, 3)
    state = model.states[2]
    of_class = (state.strength[1] + state.discount[1] * state.tables[[1, 4]]) / (state.strength[1] + state.seated[[1, 4]]) * model.root(state, np.zeros(1), np.zeros(1))
    of_start = (state.strength[0] + state.discount[0] * state.tables[0]) / (state.strength[0] + state.seated[0]) * of_class[0]
    assert (p.sum(axis=0) + np.array([of_start, *of_class])) == pytest.approx(np.ones(3))


def brute_tables(c, discount, strength, others, parent):
    """Chances of 1 to c tables for one dish, from all ways to seat its customers."""
    weight = collections.Counter()

    def sit(left, sizes, w):
        if not left:
            weight[len(sizes)] += w
            return
        for k, n in enumerate(sizes):
            sit(left - 1, [*sizes[:k], n + 1, *sizes[k + 1 :]], w * (n - discount))
        sit(left - 1, [*sizes, 1], w * (strength + discount * (others + len(sizes))) * parent)

    sit(c, [], 1.0)
    total = sum(weight.values())
    return [weight[t] / total for t in range(1, c + 1)]


@pytest.mark.parametrize("c, others", [(2, 0), (5, 3), (6, 40)])
def test_tables_have_their_exact_distribution(c, others):
    n = 40_000
    drawn, first = hpylm.resample(np.random.default_rng(0), np.full(n, c), np.ones(n), np.full(n, others), np.full(n, 0.03), 0.45, 2.0, hpylm.log_stirling(0.45))
    assert np.bincount(drawn, minlength=c + 1)[1:] / n == pytest.approx(brute_tables(c, 0.45, 2.0, others, 0.03), abs=0.012) and (drawn == first).all()
    few = hpylm.resample(np.random.default_rng(0), np.array([0, 1, 5000]), np.ones(3), np.zeros(3), np.full(3, 0.1), 0.5, 1.0, hpylm.log_stirling(0.5))[0]
    assert few[:2].tolist() == [0, 1] and 1 <= few[2] <= 5000


def test_parameters_are_found_again():
    """Restaurants seated by known parameters give parameters near them."""
    rng = random.Random(5)
    customers, tables, cells = [], [], np.zeros((hpylm.EXACT + 1, hpylm.EXACT + 1), int)
    for _ in range(300):
        seats = []
        for n in range(40):
            at = rng.random() * (n + 3.0)
            for k, size in enumerate(seats):
                at -= size - 0.6
                if at < 0:
                    seats[k] += 1
                    break
            else:
                seats.append(1)
        customers.append(40)
        tables.append(len(seats))
        for size in seats:  # a dish of its own for each table
            cells[size, 1] += 1
    drawn = [hpylm.sample_parameters(np.random.default_rng(k), np.array(customers), np.array(tables), cells, 3.0) for k in range(20)]
    assert np.mean([d for d, _ in drawn]) == pytest.approx(0.6, abs=0.06) and 1.5 < np.median([s for _, s in drawn]) < 6


def test_log_gamma():
    x = np.array([0.01, 0.5, 1.0, 3.7, 40.0, 1e6])
    assert hpylm._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-9)


class Sequential:
    """The same three levels, one customer taken out and seated again at a time."""

    def __init__(self, classes, words, discount, strength, seed):
        self.classes, self.words, self.d, self.s, self.rng = classes, words, discount, strength, random.Random(seed)
        self.seats = collections.defaultdict(lambda: collections.defaultdict(list))  # restaurant -> dish -> sizes of tables

    def up(self, place):
        return None if place is None else ("root",) if place[0] == "class" else ("class", self.classes[place[1]]) if place[0] == "context" else None

    def p(self, place, w):
        if place is None:
            return 1 / (self.words + 1)
        level = {"context": 0, "class": 1, "root": 2}[place[0]]
        d, s, room = self.d[level], self.s[level], self.seats[place]
        tables, customers = sum(map(len, room.values())), sum(map(sum, room.values()))
        own = room.get(w, [])
        return (sum(own) - d * len(own) + (s + d * tables) * self.p(self.up(place), w)) / (s + customers)

    def add(self, place, w):
        if place is None:
            return
        level = {"context": 0, "class": 1, "root": 2}[place[0]]
        own = self.seats[place][w]
        weights = [n - self.d[level] for n in own] + [(self.s[level] + self.d[level] * sum(map(len, self.seats[place].values()))) * self.p(self.up(place), w)]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            self.add(self.up(place), w)

    def remove(self, place, w):
        own = self.seats[place][w]
        k = self.rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            if self.up(place) is not None:
                self.remove(self.up(place), w)


def test_scores_are_near_a_sequential_sampler(spark, monkeypatch):
    """Held-out perplexity with fixed parameters: the parallel sweeps against one customer at a time."""
    rng = random.Random(15)
    vocabulary = words(rng, 30).split()
    after = {w: rng.sample(vocabulary, 4) for w in vocabulary}
    rows = []
    for i in range(60):
        text = [rng.choice(vocabulary)]
        while len(text) < 25:
            text.append(rng.choice(after[text[-1]]) if rng.random() < 0.8 else rng.choice(vocabulary))
        rows.append((i, " ".join(text)))
    discount, strength = (0.5, 0.4, 0.3), (1.0, 2.0, 3.0)
    taken_in_turn = iter(range(10_000))
    monkeypatch.setattr(hpylm, "sample_parameters", lambda *a: (lambda k: (discount[k], strength[k]))(next(taken_in_turn) % 3))
    scored = hpylm.score_documents(spark, documents(spark, rows), sweeps=12, burn_in=4).collect()
    held = {r["doc_id"]: r for r in scored if r["held_out"]}

    def kind(w):
        return "" if w is None else (min(len(w), 15), ord(w[-1]) & 15)

    pairs = {i: [(("context", a), w) for a, w in zip([None, *t.split()], [*t.split(), "END"])] for i, t in rows}
    train = [x for i, own in pairs.items() if i not in held for x in own]
    classes = {a: kind(a) for own in pairs.values() for (_, a), _ in own}
    model = Sequential(classes, len({w for _, w in train}), discount, strength, 1)
    for place, w in train:
        model.add(place, w)
    total, draws = collections.Counter(), 0
    for sweep in range(12):
        for place, w in train:
            model.remove(place, w)
            model.add(place, w)
        if sweep >= 4:
            draws += 1
            for i in held:
                for k, (place, w) in enumerate(pairs[i]):
                    total[i, k] += model.p(place, w)
    want = sum(math.log10(x / draws) for x in total.values())
    assert sum(r["score"] for r in held.values()) == pytest.approx(want, rel=0.01)


def test_tokens_of_many_texts_are_those_of_each():
    rng = random.Random(16)
    texts = [None, "", " \t", "One two", words(rng, 40), "x" * 50, None]
    h, kind, n = hpylm.tokens_of_all(texts)
    want = [hpylm.tokens_of(t) for t in texts]
    assert n.tolist() == [len(w[0]) for w in want]
    assert h.tolist() == [x for w in want for x in w[0].tolist()] and kind.tolist() == [x for w in want for x in w[1].tolist()]
