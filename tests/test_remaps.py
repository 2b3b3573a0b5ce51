import random
from collections import Counter

import numpy as np

from sitemigrate.operators import remaps

REMAPS = "export_id string, from_url string, to_url string"


def in_turn(rules, export, text):
    if text is None:
        return None
    for _, old, new in sorted({(-len(f), f, t) for e, f, t in rules if e == export and f}, key=lambda r: (r[0], r[1].encode(), r[2].encode())):
        text = text.replace(old, new)
    return text


def test_equal_to_all_remaps_in_turn(spark):
    """Chained and overlapping remaps of all lengths, on texts that are made of them."""
    rng = random.Random(5)
    piece = lambda n: "".join(rng.choice("ab/é") for _ in range(n))
    rows, rules = [(None, "ab"), ("w", "ab"), ("x", None), ("x", "")], [("x", "", "never")]
    for export in "xy":
        urls = [piece(rng.choice([1, 2, 5, 7, 8, 9, 12, 24, 30])) for _ in range(20)]
        rules += [(export, u, rng.choice([rng.choice(urls), "Q", "", rng.choice(urls)[:4] + rng.choice(urls)])) for u in urls]
        rows += [(export, "".join(rng.choice([piece(3), rng.choice(urls), " "]) for _ in range(8))) for _ in range(40)]
    got = remaps.apply_url_remap(spark.createDataFrame(rows, "export_id string, text string"), spark.createDataFrame(rules, REMAPS), "text")
    assert Counter(map(tuple, got.collect())) == Counter((e, in_turn(rules, e, t)) for e, t in rows)


def test_many_remaps_of_one_export(spark):
    n = 60_000
    rules = spark.range(n).selectExpr("'x' AS export_id", "concat('https://old.example.org/wp-content/uploads/2020/01/image-', id, '.png') AS from_url", "concat('/media/', id, '.png') AS to_url")
    texts = spark.range(500).selectExpr("'x' AS export_id", "id", f"concat('see https://old.example.org/wp-content/uploads/2020/01/image-', (id * 7919) % {n}, '.png and no more') AS text")
    got = remaps.apply_url_remap(texts, rules, "text").collect()
    assert {r["id"]: r["text"] for r in got} == {i: f"see /media/{i * 7919 % n}.png and no more" for i in range(500)}


def test_no_remaps_leave_texts_alone(spark):
    texts = spark.createDataFrame([("x", "a")], "export_id string, text string")
    assert remaps.apply_url_remap(texts, spark.createDataFrame([], REMAPS), "text").collect() == texts.collect()


def test_runs_of_a_part_are_runs_of_the_whole():
    rng = random.Random(1)
    for _ in range(200):
        url = bytes(rng.randrange(97, 105) for _ in range(rng.choice([1, 5, 8, 20, 24, 80])))
        text = bytes(rng.randrange(97, 105) for _ in range(40)) + url + b"tail"
        assert np.isin(remaps.candidates(url), remaps.runs(text, min(len(url), remaps.RUN))).all()
