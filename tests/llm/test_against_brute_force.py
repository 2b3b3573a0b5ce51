"""Passages and Markov spans of the small documents table against plain versions."""

import re
import types

import pytest

from sitemigrate.llm import chaining, common, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_every_long_common_run_lies_in_a_passage(spark, docs):
    """Each 30 words that an earlier document has too are covered; each span of a passage is 70 % alike its source."""
    words = {r["doc_id"]: chaining.words_of(r["text"]).split() for r in docs.collect()}
    passages = {}
    for r in chaining.passages(spark, docs).collect():
        passages.setdefault(r["doc_id"], []).append(r)
    seen, runs = set(), 0
    for i in sorted(words):
        w = words[i]
        own = [tuple(w[k : k + 30]) for k in range(len(w) - 29)]
        for k, run in enumerate(own):
            if run in seen:
                runs += 1
                assert any(p["start"] <= k and k + 30 <= p["stop"] for p in passages.get(i, [])), (i, k)
        seen.update(own)
    assert runs > 100
    for i, found in passages.items():
        for p in found:
            assert p["n_words"] == p["stop"] - p["start"] >= 30 and p["sources"] == sorted(p["sources"]) and max(p["sources"]) < i
            for s in p["spans"]:
                a, b = words[i][s["start"] : s["stop"]], words[s["other"]][s["other_start"] : s["other_stop"]]
                assert chaining.align(a, b) >= 0.7 * max(len(a), len(b)) - 1e-9


def test_markov_spans_against_plain_python(docs):
    ratios = secret_scan.train(docs)
    got = {r["doc_id"]: r for r in secret_scan.scan(docs, ratios).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        base = []
        for name, pattern, group, least in secret_scan.BASE:
            base += [(m.start(), m.end(), name) for m in re.finditer(pattern.replace("(?i:", "(?ai:"), text) if len(m[group]) >= least]
        more = []
        for m in re.finditer(secret_scan.CANDIDATE, text):
            if not any(a < m.end() and m.start() < b for a, b, _ in base):
                total = 0.0
                for x, y in zip(m[0], m[0][1:]):
                    total += float(f"{ratios[128 * ord(x) + ord(y)]:.5f}")
                if abs(total - 12.0) > 1e-6 and total >= 12.0:
                    more.append((m.start(), m.end(), "markov"))
        kinds = [k for k, *_ in secret_scan.BASE] + ["markov"]
        want = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(((a, k, b) for a, b, k in base + more), key=lambda s: (s[0], kinds.index(s[1]))))
        assert got[r["doc_id"]]["spans"] == want


def test_no_local_folder_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="share"):
        common.shared_dir(types.SimpleNamespace(sparkContext=context, conf=conf))
