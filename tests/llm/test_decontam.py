"""Benchmark decontamination (op8) against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    phrases = []
    for item, text in items:
        w = words(text)
        if w:
            phrases += [(item, w[i : i + window]) for i in range(max(1, len(w) - window + 1))]
    out = []
    for doc, text in docs:
        w, hit, got = words(text), set(), set()
        for item, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    got.add(item)
        names = ",".join(sorted(map(str, got)))
        out.append((doc, len(w), len(hit), len(got), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 3), min_size=1, max_size=4))
def test_index(s, phrase):
    s = np.array(s)
    index = decontam.FMIndex(s)
    lo, hi = index.search(np.array([phrase]), np.array([len(phrase)]))
    at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert at == [i for i in range(len(s) - len(phrase) + 1) if s[i : i + len(phrase)].tolist() == phrase]


def case():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(30)] + ["Été", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(100, None), (7, "v1, V2!"), (70, "v1 v2")]
    docs = [(0, None), (1, ""), (2, "-- !"), (3, "V1...v2")]
    for i in range(4, 60):
        parts = [rng.choices(vocabulary + ["zz"], k=rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            parts.append(words(rng.choice(items)[1])[rng.randint(0, 3) :])
            parts.append(rng.choices(["zz", "yy", "v1"], k=rng.randint(0, 3)))
        docs.append((i, " ".join(sum(parts, [])).upper()))
    return docs + [(4, docs[4][1])], items


@pytest.mark.parametrize("block_words,shard_words", [(1_000_000, 1 << 20), (40, 50), (1_000_000, 1)])
def test_documents(spark, block_words, shard_words):
    docs, items = case()
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.occurrences(d, b, block_words=block_words, shard_words=shard_words)
    got = []
    for r in found.collect():
        names = ",".join(sorted(map(str, r["items"])))
        n = sum(s["end"] - s["first"] for s in r.spans)
        got.append((r.doc_id, r.n_words, n, len(r["items"]), hashlib.sha256(names.encode()).hexdigest(), n > 0))
    assert sorted(got, key=repr) == brute(docs, items)
    assert sorted([tuple(r) for r in decontam.report(d, b).collect()], key=repr) == brute(docs, items)


def test_removal_and_empty(spark):
    d = spark.createDataFrame([(1, "Keep this, then A b-C and more.", 31), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = {r.doc_id: (r.text, r.n_chars) for r in decontam.remove_passages(d, b).collect()}
    assert rows == {1: ("Keep this, then  and more.", 26), 2: ("clean", 5), 3: (None, None)}
    clash = d.withColumnsRenamed({"doc_id": "spans"}).withColumn("items", d.n_chars).withColumn("n_words", d.n_chars)
    kept = decontam.remove_passages(clash, b)
    assert kept.columns == clash.columns and {r.spans: r["items"] for r in kept.collect()} == {1: 31, 2: 5, 3: None}
    assert decontam.report(d, b.where("false")).where("contaminated").count() == 0
    assert decontam.report(d, b.where("false")).where("n_words > 0").count() == 2
    assert decontam.report(d.where("false"), b).count() == 0
