"""Spelling variants (op11) against a plain version of every step, and defined cases."""

import random
import re
import zlib
from collections import Counter

from panelspark.llm import spelling


def plain_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    """word: (form, root, n, n_near, form_n) of {word: n}."""
    near = {w: [v for v in n if plain_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 5 * n[w] else None
    out = {}
    for w in n:
        end = w
        while form[end]:
            end = form[end]
        out[w] = (form[w], end, n[w], len(near[w]), n.get(form[w]))
    return out


def plain_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def some_words(rng, count):
    out = set()
    while len(out) < count:
        word = "".join(rng.choice("abqréÿ×") for _ in range(rng.randint(6, 9)))
        out.add(word)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word))
            out.add(word[:i] + rng.choice(["", "a", "ab", "q"]) + word[i + rng.randint(0, 1) :])
    return sorted(out)


def found(df):
    return {r.word: (r.form, r["root"], r.n, r.n_near, r.form_n) for r in df.collect()}


def test_groups_against_plain(spark, monkeypatch):
    rng = random.Random(11)
    n = {w: rng.choice([5, 6, 25, 30, 150, 700, 10**6]) for w in some_words(rng, 500)}
    # one letter count for a third of the words; a chain of forms; a very long word
    n |= {"".join(rng.sample("abcdefgh", 8)): rng.choice([5, 30]) for _ in range(250)} | {"zzzzzz" + "y" * k: 5 * 6**k for k in range(9)} | {"x" * 40 + "w": 5, "x" * 41: 25, "x" * 42: 5}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plain_groups(n)
    assert found(spelling.group_words(vocabulary)) == want
    assert want["zzzzzz"][1] == "zzzzzz" + "y" * 8
    # small blocks: cells over several tries; leaves matched by their deletions
    monkeypatch.setattr(spelling, "DENSE", 1)
    got = spelling.near_words(vocabulary, block=7)
    assert got.count() == sum(w[3] for w in want.values()) and got.distinct().count() == got.count()


def test_trie():
    rng = random.Random(2)
    words = some_words(rng, 300)
    trie = spelling.Trie(words, [1] * len(words))
    want = {(a, b) for a in words for b in words if a < b and plain_edit(a, b)}
    assert {(words[i], trie.words[j]) for i, j in trie.search(words, once=True)} == want
    assert len(list(trie.search(words, once=False))) == 2 * len(want)
    assert {(min(a, b), max(a, b)) for k, j in spelling._matched(words, words) for a, b in [(words[k], words[j])]} == want
    assert all(spelling.one_edit(a, b) == plain_edit(a, b) for a in words[:80] for b in words[:80])


def test_documents(spark):
    rng = random.Random(3)
    words = some_words(rng, 60)
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choice(words) if rng.random() < 0.5 else rng.choice(words).upper() for _ in range(rng.choice([0, 3, 60])))) for _ in range(200)]
    rows += [(7, None), (8, ""), (9, "12 -- ab"), (10, "Straße,straßen " * 4000), (rows[2])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    n = plain_counts(rows)
    got = found(spelling.group_documents(docs))
    assert got == plain_groups(n) and got
    assert spelling.group_documents(docs.where("false")).count() == 0
