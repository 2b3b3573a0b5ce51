"""Block attributes at any depth."""

import json

from sitemigrate.operators import blocks


def test_attributes_of_five_and_more_levels(spark):
    deep = {"end": 'a "quoted" }]'}
    for k in range(8):
        deep = {f"k{k}": deep} if k % 2 else [deep]
    attrs = [{"style": {"elements": {"link": {"color": {"text": "red"}}}}}, {"deep": deep}, {"flat": "{[{[{[{[{["}]
    rows = [(i, f"<!-- wp:group {json.dumps(a)} /-->") for i, a in enumerate(attrs)]
    found = blocks.delimiters(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    assert blocks._json_depth(found) == 10
    got = {(r["id"], r["path"]): (r["depth"], r["value"]) for r in blocks.attribute_paths(found, "id").collect()}
    assert got[(0, "style.elements.link.color.text")] == (5, "red")
    assert got[(1, "deep.k7.0.k5.0.k3.0.k1.0.end")] == (10, 'a "quoted" }]')
    assert len(got) == 5 + 10 + 1


def test_no_attributes_at_all(spark):
    found = blocks.delimiters(spark.createDataFrame([(1, "<!-- wp:group /-->")], "id int, text string"), "id", "text")
    assert blocks.attribute_paths(found, "id").count() == 0
