"""The pipeline against a plain version of its stages, and its defined cases."""

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, path, docs, benchmark, labels, schema=SCHEMA):
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return str(path)


def documents():
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta rho tau phi chi psi omega".split()) + str(rng.randrange(400))
    docs = []
    for g in range(25):
        words = [word() for _ in range(90)]
        docs.append(" ".join(words))
        for changed in (1, 2, 7):
            other = list(words)
            for at in rng.sample(range(5, 85, 6), changed):
                other[at] = word()
            docs.append(" ".join(other))
    item = [f"bench{i}" for i in range(14)]
    docs[8] += " " + " ".join(item) + " password=abcdefgh12 tail"
    docs[40] += " AKIA" + "A1B2" * 5
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(docs)]
    rows += [rows[3], rows[3], (None, docs[3], "en", "s1", len(docs[3])), (900, None, "en", None, None), (901, "", "en", "s1", 0), (902, docs[2].upper(), "en", "s2", 5)]
    return rows, [(1, " ".join(item)), (2, None)]


def plain(rows, benchmark):
    """Texts by doc_id after near-duplicates, benchmark passages and secrets are gone."""
    words = lambda t: tuple((t or "").lower().split())
    grams = lambda w: {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set()
    firsts = {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: (x[0], str(x[1]))):
        firsts.setdefault(words(t), (i, t))
    nodes = sorted(firsts.values(), key=lambda x: x[0])
    sets, low = [grams(words(t)) for _, t in nodes], list(range(len(nodes)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for b in range(len(nodes)):
        for a in range(b):
            if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    kept = [n for k, n in enumerate(nodes) if root(k) == k] + [(None, r[1]) for r in rows if r[0] is None]
    item = benchmark[0][1]
    out = []
    for i, t in kept:
        if t is not None:
            t = t.replace(item, "")
            t = re.sub(r"password=[A-Za-z0-9]+|AKIA[A-Z0-9]{12,}", "[SECRET]", t)
        out.append((i, t))
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    rows, benchmark = documents()
    path = written(spark, tmp_path, rows, benchmark, [(0, 1, 0), (1, 1, 0)])
    want = plain(rows, benchmark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.doc_id in (8, 40))
    mixed = pipeline.run(spark, path).collect()
    texts = dict(want)
    size = lambda t: len((t or "").split())
    total = {}
    for r in mixed:
        assert r.text == texts[r.doc_id] and 1 <= r.copies <= 3 and r.taken == r.copies * size(r.text)
        total[r.source] = total.get(r.source, 0) + r.taken
    targets = {r.source: r.target for r in mixed}
    assert all(abs(total[s] - targets[s]) <= 60 for s in total)
    assert sum(total.values()) == pytest.approx(sum(size(t) for _, t in want), rel=0.1)


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    rows, benchmark = documents()
    names = ("gone", "spans", "blob", "copies", "label", "node", "items", "n_words", "score", "bucket", "size", "u", "v")
    docs = spark.createDataFrame(rows[:12], SCHEMA).selectExpr("*", *(f"doc_id AS {n}" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r.gone == r.doc_id == r.spans == r.blob for r in out.collect())
    assert set(docs.columns) <= set(pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
