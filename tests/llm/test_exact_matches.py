"""Repeated strings (op5) and vector links (op9) against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from panelspark.llm import substrings, vectors


def brute_strings(rows, length=50):
    """doc_id, n_bytes, n_removed, n_spans, sha256 of what is kept."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if i is not None and first[b[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    line, passage = say(14), say(60)
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 200), (None, passage), (5, passage), (5, say(20) + passage), (5, passage)]
    for i in range(6, 90):
        parts = [say(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            a, b = sorted(rng.sample(range(len(passage)), 2))
            parts += [rng.choice([line, passage[a:b], line[: rng.randint(20, len(line))], line + "\n" + line]), say(rng.randint(0, 6))]
        rows.append((rng.choice([i, i * 1000, i]), "\n".join(parts)))
    return [*rows, (7, rows[20][1]), (500, rows[20][1]), (501, rows[20][1][1:])]


@pytest.mark.parametrize("round_keys", [6_000_000, 40])
def test_strings(spark, round_keys):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, code string")
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.deduplicate(docs.repartition(7), round_keys).collect()], key=repr)
    assert got == brute_strings(rows)


def test_no_strings(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.deduplicate(docs).collect()) == [0, 0]
    assert substrings.deduplicate(docs.where("false")).count() == 0


def brute_links(rows, cosine=0.93):
    ok = [(i, v, l) for i, v, l in rows if i is not None and v and l is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    pairs = [(a, b) for k, a in enumerate(ok) for b in ok[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= cosine]
    low, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}
    for a, b in pairs:
        links[a[0]] += 1
        links[b[0]] += 1
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(low[a[0]], low[b[0]])
            moved |= low[a[0]] != m or low[b[0]] != m
            low[a[0]] = low[b[0]] = m
    return sorted([(i, links[i], low[i], i is not None and low[i] == i) for i, _, _ in rows], key=repr)


@pytest.mark.parametrize("cell,block", [(4096, 1024), (20, 7)])
def test_links(spark, cell, block):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8))
    rows = []
    for i in range(150):
        v = centers[i % 12] + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.25])
        rows.append((1000 - i, [float(np.float32(x)) for x in v * rng.choice([1.0, 3.0])], int(i % 3)))
    one = rows[0][1]
    rows += [(5000 + i, one, 0) for i in range(40)] + [(1, None, 0), (2, [0.0] * 8, 0), (3, [math.nan] + one[1:], 0), (4, [None, *one[1:]], 0), (5, one, None), (6, [math.inf] + one[1:], 0), (7, one[:7], 0), (8, [], 1), (None, one, 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, cell=cell, block=block).collect()], key=repr)
    assert got == brute_links(rows)
    assert vectors.near_duplicates(df.where("false")).count() == 0


def vector_rows(spark, v, labels):
    rows = [(i, [float(y) for y in x], int(label)) for i, (x, label) in enumerate(zip(v, labels, strict=True))]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_vectors_in_cells_and_rounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(8, 16))
    v = [centers[i % 8] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4]) for i in range(240)]
    rows, df = vector_rows(spark, v, [i % 8 > 6 for i in range(240)])
    wanted = brute_links(rows)
    assert sum(r[1] for r in wanted) > 500
    grouped = []
    monkeypatch.setattr(vectors, "COPY_COST", 0)
    for moved, pairs in ((3, 1 << 20), (1, 16)):
        monkeypatch.setattr(vectors, "MOVED", moved)
        monkeypatch.setattr(vectors, "PAIRS", pairs)
        grouped.append(sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, cell=12, block=9).collect()], key=repr))
    assert grouped == [wanted, wanted]


def test_vectors_near_all_planes_are_not_copied(spark):
    """Pivots that part nothing make no copies: each vector went to nearly all cells of its label."""
    v = np.random.default_rng(2).normal(size=(2000, 64))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    reps = spark.createDataFrame([(i, 1, "a", x.tobytes()) for i, x in enumerate(v)], "node long, n long, label string, v binary")
    assert vectors.range_links(reps, cell=50).count() == 0
    rows = vectors._cells(reps, math.sqrt(0.14), 50, 2048)(["node"])
    sizes = [r.n for r in rows.groupBy("node").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 2000 and sum(sizes) < 3 * 2000


def test_tasks_without_equal_strings(spark):
    # no key stands in several documents of its task, or all do: either failed
    apart = "".join(chr(97 + i * i * 7 % 26) + str(i) for i in range(60))
    for texts, removed in (([apart, "x" * 10], [0, 0]), (["ab" * 40, "ab" * 40], [0, 80])):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        assert [r.n_removed for r in substrings.deduplicate(docs).orderBy("doc_id").collect()] == removed


def test_memory_of_a_task_that_samples():
    """Keys of 8 MB of text: the peak was 106 MB with calls of 1 MB, and is 40 MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Captured:
        tasks = []

        def mapInArrow(self, task, schema):  # noqa: N802
            self.tasks.append(task)
            return self

        def __getattr__(self, name):
            return lambda *a: self

    substrings.shared_keys(Captured(), 8)
    letters = np.random.default_rng(5).integers(97, 123, (8000, 1000), dtype=np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array([x.tobytes().decode() for x in letters])], names=["doc_id", "text"])
    substrings.prefix_sums(np.zeros(1, np.uint8))  # the tables of powers
    tracemalloc.start()
    found = sum(b.num_rows for b in Captured.tasks[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 50e6
