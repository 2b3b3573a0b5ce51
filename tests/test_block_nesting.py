import random
import time

from sitemigrate.operators import blocks


def stack_walk(rows):
    """(ord, depth, breadcrumbs, error) of one document's delimiters, by a stack."""
    stack, out = [], []
    for r in rows:
        if r["is_closer"] and (not stack or stack[-1] != r["block"]):
            return [*out, (r["ord"], len(stack), list(stack), True)]
        inner = list(stack) if r["is_closer"] else [*stack, r["block"]]
        out.append((r["ord"], len(inner), inner, False))
        if r["is_closer"]:
            stack.pop()
        elif not r["void"]:
            stack.append(r["block"])
    return out


def test_nesting_against_a_stack(spark):
    rng, docs = random.Random(3), []
    for i in range(120):
        text, open_ = "", []
        for _ in range(rng.randint(0, 30)):
            kind, name = rng.random(), rng.choice("abc")
            if kind < 0.4:
                text, open_ = text + f'<!-- wp:{name} {{"k":1}} -->', [*open_, name]
            elif kind < 0.55:
                text += f"<!-- wp:{name} /-->"
            elif kind < 0.6:
                text += "<!-- a comment -->"
            elif open_ and kind < 0.97:
                text, open_ = text + f"<!-- /wp:{open_[-1]} -->", open_[:-1]
            else:
                text += f"<!-- /wp:{name} -->"
            text += "x" * rng.randint(0, 3)
        docs.append((i, text))
    found = blocks.delimiters(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    by_doc = {}
    for r in found.collect():
        by_doc.setdefault(r["id"], []).append(r)
    expected = {(i, *map(str, x)) for i, rows in by_doc.items() for x in stack_walk(sorted(rows, key=lambda r: r["ord"]))}
    got = {(r["id"], str(r["ord"]), str(r["depth"]), str(list(r["breadcrumbs"])), str(r["error"] is not None)) for r in blocks.nesting(found, "id").collect()}
    assert got == expected and any(x[4] == "True" for x in got)


def test_many_blocks_and_deep_ones_in_one_text(spark):
    flat = "<!-- wp:g -->" + "<!-- wp:p -->x<!-- /wp:p -->" * 50_000 + "<!-- /wp:g -->"
    deep = "".join(f"<!-- wp:d{k} -->" for k in range(300)) + "".join(f"<!-- /wp:d{k} -->" for k in reversed(range(300)))
    began = time.time()
    nested = blocks.nesting(blocks.delimiters(spark.createDataFrame([(1, flat), (2, deep)], "id long, text string"), "id", "text"), "id")
    rows = nested.groupBy("id").agg({"depth": "max", "ord": "count", "error": "count"}).collect()
    assert {(r["id"], r["max(depth)"], r["count(ord)"], r["count(error)"]) for r in rows} == {(1, 2, 100_002, 0), (2, 300, 600, 0)}
    assert time.time() - began < 60


def test_a_comment_ends_at_its_first_end(spark):
    text = '<!-- wp:a {"x":1 --> text <!-- wp:b {"y":"}"} -->z<!-- /wp:b --><!-- wp:c {"t":"' + "long " * 20_000 + '"} /-->'
    found = blocks.delimiters(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")
    rows = sorted(found.collect(), key=lambda r: r["ord"])
    assert [(r["block"], r["is_closer"], r["void"]) for r in rows] == [("wp:b", False, False), ("wp:b", True, False), ("wp:c", False, True)]
    assert all(text[r["start"] : r["stop"]].startswith("<!--") and text[r["start"] : r["stop"]].endswith("-->") for r in rows)
    assert blocks.nesting(found, "id").filter("error IS NOT NULL").count() == 0
