"""SimHash (op7) against brute force."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import simhash
from panelspark.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=4):
    low = dict(zip(ids, ids, strict=True))
    pairs = [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids[:i]) if bin(fps[i] ^ fps[j]).count("1") <= radius]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\néÉ.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == [brute_fingerprint(text)]


def test_long_text_and_null():
    text = " ".join(str(random.Random(1).random()) for _ in range(20)) + " x" * 10_000
    assert simhash.fingerprint(text) == [brute_fingerprint(text)]
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == [0]


def test_counters_and_planes():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = a.copy()
    for i in range(200):
        for bit in rng.choice(64, i % 9, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    hit = simhash.close_lanes(simhash.planes(a), simhash.planes(b), 4)
    bits = np.unpackbits(hit.view(np.uint8), bitorder="little")[:200].astype(bool)
    assert bits.tolist() == [i % 9 <= 4 for i in range(200)]


def test_chains_copies_nulls_and_chunks(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # chains of close ones, some over the radius
        x = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << bit
        fps.append(x)
    distinct = sorted(set(fps))
    rng.shuffle(distinct)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(distinct)], "node long, fp long")
    want = brute_components(list(range(len(distinct))), distinct)
    for bands, chunk in ((None, 4096), (7, 4096), (6, 5)):
        found = {r.node: r.component for r in components(simhash.links(nodes, 4, bands, chunk)).collect()}
        assert {n: found.get(n, n) for n in want} == want


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (9, base), (2, base.replace("w7 ", "x7 ")), (11, None), (12, ""), (13, " \n"), (4, "one"), (4, "one"), (None, base), (20, "Other words here all of them new")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    low = brute_components([i for i, _ in rows if i], [f for f, (i, _) in zip(fps, rows, strict=True) if i])
    low[None] = low[5]
    assert got == sorted((str(i), f"{f:016x}", low[i]) for f, (i, _) in zip(fps, rows, strict=True))
    kept = sorted(str(r.doc_id) for r in simhash.keep_first(docs).collect())
    assert kept == ["11", "2", "20", "4", "None"]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_near_copies_are_verified(spark):
    """Texts at a similarity below 0.8 stay although fingerprints are close; all at 0.8 or more go."""
    rng = random.Random(9)
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(120)]
        rows.append((len(rows), " ".join(words)))
        for changed in (1, 2, 3, 4, 5, 6):  # 5 shingles each: similarity 0.92 down to about 0.6
            other = list(words)
            for at in rng.sample(range(4, 116, 5), changed):
                other[at] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(other)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    low = list(range(len(rows)))
    pairs = [(a, b) for b in range(len(rows)) for a in range(b // 7 * 7, b) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in range(7):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    want = {i for i, x in enumerate(low) if i == x}
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= kept  # nothing below 0.8 is dropped
    assert len(kept - want) <= 3  # near all at 0.8 or more is found


def test_groups_are_searched_whole(spark):
    """A dense group whose members are linked in part: every link that connects is found, whatever the chunks."""
    import pyarrow as pa

    from panelspark.llm.common import shingle_sets

    rng = random.Random(21)
    base = [f"b{i}" for i in range(240)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(4, 236, 6), rng.choice([1, 2, 3, 4, 5, 6, 7, 8])):
            words[at] = f"n{rng.random()}"
        texts.append(" ".join(words))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(236)} for t in texts]
    pairs = [(a, b) for b in range(40) for a in range(b) if 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b])]
    low = list(range(40))
    for _ in range(40):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert 3 < len(set(low)) < 35
    rows = []
    for i, t in enumerate(texts):
        hashes = shingle_sets(pa.array([t]), 5)[1].view(np.int64).tolist()
        rows.append((i, i if i else 0, 7, len(hashes), rng.getrandbits(62), hashes))
    members = spark.createDataFrame(rows, "node long, label long, group long, size long, fp0 long, grams array<long>")
    for size in (512, 6):
        links = simhash.in_groups(members, 1, 64, rows=size)
        found = {r.node: r.component for r in components(links).collect()}
        assert [found.get(i, i) for i in range(40)] == low
        assert {(min(r.u, r.v), max(r.u, r.v)) for r in links.collect()} <= set(pairs)


def test_tables_are_filled_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fps = rng.integers(-(1 << 63), 1 << 63, (60, 2))
    for i in range(20, 60):  # near one of the first twenty in one of the two
        fps[i, i % 2] = fps[i % 20, i % 2] ^ np.int64(sum(1 << int(b) for b in rng.choice(62, 1 + i % 12, replace=False)))
    rows = [(i, i, 100 + i % 3, int(a), int(b)) for i, (a, b) in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, label long, size long, fp0 long, fp1 long")
    wide, met = [], simhash._met
    monkeypatch.setattr(simhash, "_met", lambda rows, kept: wide.append(rows.count()) or met(rows, kept))
    bits = lambda x: bin(int(x) & ((1 << 64) - 1)).count("1")
    close = {(j, i) for i in range(60) for j in range(i) if min(bits(fps[i, k] ^ fps[j, k]) for k in (0, 1)) <= 8}
    for bands, tables in ((9, 18), (10, 90)):
        wide.clear()
        got = {(r.u, r.v) for r in simhash.candidates(nodes, 2, 8, bands=bands).collect()}
        assert got <= close and len(got) > 10
        pairs = spark.createDataFrame(sorted(got), "u long, v long")
        every = spark.createDataFrame(sorted(close), "u long, v long")
        assert sorted(components(pairs).collect()) == sorted(components(every).collect())
        assert sum(wide) == 60 * 2 * tables
        assert max(wide) <= 60 * 2 * 72  # rows in one shuffle
