"""The pipeline against a plain version of its five stages on the small tables."""

import re

import numpy as np
import pytest

import corpus_pipeline
from sitemigrate.llm import quality, secret_scan
from test_bpe_packing import check_places
from test_quality_secrets import brute_base
from test_simhash_lines import brute_components, brute_fingerprint, brute_lines

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(spark, stage(spark, docs, SF), f"test_{i}")
        out.append(docs)
    return [df.collect() for df in out]


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_stages_keep_the_columns(stages):
    names = [list(rows[0].asDict()) for rows in stages[:-1]]
    assert all(n == names[0] for n in names) and len(corpus_pipeline.STAGES) == 5
    assert all(r["n_chars"] == len(r["text"]) for rows in stages[:-1] for r in rows)


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for i, t in texts(stages[0]).items():
        n, _, _, _, repeat = brute_base(t)
        if n >= 50 and 100 * repeat <= 50 * n and trees.score(np.array([quality.statistics(t)[1]]))[0] >= 0.5:
            want.add(i)
    assert set(texts(stages[1])) == want


def test_lines(stages):
    want = {}
    for (i, t), (_, removed, text) in brute_lines(list(texts(stages[1]).items())).items():
        if not removed or WORD.search(text):
            want[i] = text
    assert texts(stages[2]) == want


def test_near_duplicates(stages):
    rows = sorted(texts(stages[2]).items())
    labels = brute_components([brute_fingerprint(t) for _, t in rows])
    assert set(texts(stages[3])) == {rows[k][0] for k in set(labels)}


def test_secrets(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for i, t in before.items():
        hidden = any(len(x) >= 16 for x in re.findall("[0-9a-f]+", t))
        assert (after[i] != t) == hidden or "[SECRET]" in after[i]
        assert not any(len(x) >= 16 for x in re.findall("[0-9a-f]+", after[i]))


def test_packing(stages):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(corpus_pipeline.vocabulary())
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(stages[4]).items()}
    got = {}
    for r in sorted(stages[5], key=lambda r: (r["doc_id"], r["piece"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == want
    n = check_places(stages[5], 4096)
    assert n <= 1.01 * sum(map(len, want.values())) / 4096 + 1


def test_thresholds_are_the_operators_own():
    assert secret_scan.scan.__defaults__[-1] == secret_scan.redact.__defaults__[-1]
