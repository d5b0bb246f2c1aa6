"""Kneser-Ney quality (op1) and cross-entropy difference (op10) against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import common, lmscore, quality


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices("a B c dd Eé f g".split(), weights=[9, 5, 3, 2, 2, 1, 1], k=rng.randint(0, 30))) for _ in range(n)]


def low(t):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").split()]


class Plain:
    """Interpolated modified Kneser-Ney, one n-gram at a time."""

    def __init__(self, docs):
        three = Counter()
        for t in docs:
            w = ["<", "<", *low(t)]
            three.update(zip(w, w[1:], w[2:], strict=False))
        two = Counter((b, c) for _, b, c in three)
        one = Counter((c,) for _, c in two)
        self.orders = [one, two, three]
        self.d = [self.discount(c) for c in self.orders]
        self.words = len(one)

    @staticmethod
    def discount(c):
        n = [0, *(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]

    def p(self, gram):
        k = len(gram) - 1
        if k < 0:
            return 1 / (self.words + 1)
        c, d = self.orders[k], self.d[k]
        after = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return self.p(gram[1:])
        left = sum(min(d[min(v, 3)], v) for v in after.values())
        v = c[gram]
        return (v - min(d[min(v, 3)], v)) / total + left / total * self.p(gram[1:])


def test_kneser_ney(spark):
    docs = [*texts(40, 1), None, "one"]
    model = quality.fit(spark.createDataFrame([(t,) for t in docs], "text string"))
    plain = Plain(docs)
    other = [*texts(15, 2), "zz a zz B", "", None]
    logs, row = model.log_probabilities(pa.array(other))
    at = 0
    for r, t in enumerate(other):
        w = ["<", "<", *low(t)]
        for g in zip(w, w[1:], w[2:], strict=False):
            assert row[at] == r
            assert math.isclose(logs[at], math.log(plain.p(g)), rel_tol=1e-5, abs_tol=1e-5)
            at += 1
    assert at == len(logs)
    assert sum(math.exp(x) for x in [math.log(plain.p(("a", "b", w))) for w in ["a", "b", "c", "dd", "eé", "f", "g", "one", "zz"]]) == pytest.approx(1.0)


def test_classify(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choices(["sun", "moon", "sky", "sea"], k=40)), "en" if i % 2 else None, "x") for i in range(200)]
    junk = [(1000 + i, " ".join(f"q{rng.random()}" for _ in range(40)), "en", "x") for i in range(10)]
    docs = spark.createDataFrame([*good, *junk, (2000, None, "fr", "x"), (2001, "sun sky", "fr", "x"), good[0]], "doc_id long, text string, lang string, threshold string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(1000, 0, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 213
    kept = {r.doc_id for r in rows if r.kept}
    assert not kept & set(range(1000, 1010)) and 2000 not in kept
    assert len(kept & set(range(200))) > 190
    assert quality.classify(docs, labels.where("false")).where("kept").count() == 212
    assert quality.classify(docs.where("false"), labels).count() == 0
    few, trusted = quality.trusted_folds(docs, labels, 1500)
    assert 0 < few.count() < 75 and few.count() + trusted.count() >= 100


def test_cross_entropy_difference(spark):
    a, b = texts(30, 5), [t.replace("a", "g") for t in texts(30, 6)]
    rows = [(i, t, i < 30) for i, t in enumerate([*a, *b])] + [(90, None, False), (91, "  ", True), (92, "zz zz a", False), (92, "zz zz a", False)]
    docs = spark.createDataFrame([(i, t, k, "clash") for i, t, k in rows], "doc_id long, text string, is_target boolean, score string")
    ids = spark.createDataFrame([(i,) for i, _, k in rows if k], "target_id long")
    got = sorted(((r.doc_id, r.n_tokens, r.background_loss, r.target_loss, r.score) for r in lmscore.score(docs, ids, 5).collect()), key=repr)
    words = Counter(w for _, t, _ in rows for w in low(t))
    names = sorted(words, key=lambda w: (-words[w], int(lmscore.word_hashes(pa.array([w]))[0].view(np.int64)[0])))[:5]
    numbers = lambda t: [0] + [names.index(w) + 2 if w in names else 1 for w in low(t)]

    def losses(docs):
        after, total, uni = defaultdict(Counter), Counter(), Counter()
        for t in docs:
            x = numbers(t)
            for h, w in zip(x, x[1:], strict=False):
                after[h][w] += 1
                total[h] += 1
                uni[w] += 1
        kinds, n = max(1, len(uni)), sum(uni.values())

        def loss(h, w):
            one = (uni[w] + kinds / 7) / (n + kinds)
            k = max(1, len(after[h]))
            return -math.log((after[h][w] + k * one) / (total[h] + k))

        return loss

    background, target = losses([t for _, t, _ in rows]), losses([t for _, t, k in rows if k])
    want = []
    for i, t, _ in rows:
        pairs = list(zip(numbers(t), numbers(t)[1:], strict=False))
        if pairs:
            m = [sum(f(*p) for p in pairs) / len(pairs) for f in (background, target)]
            want.append((i, len(pairs), *m, m[0] - m[1]))
        else:
            want.append((i, 0, None, None, None))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:2] == w[:2]
        assert all(x == y or x == pytest.approx(y, abs=3e-3) for x, y in zip(g[2:], w[2:], strict=True))
    mean = lambda lo, hi: np.mean([g[4] for g in got if g[4] is not None and lo <= g[0] < hi])
    assert mean(0, 30) > mean(30, 60)
    assert lmscore.score(docs.where("false"), ids, 5).count() == 0


@pytest.mark.parametrize("most", [0, 12, 1 << 20])
def test_whole_vocabulary(spark, monkeypatch, most):
    """5,000 words, more than any fixed table held: each has counts of its own, by look-up or by join."""
    monkeypatch.setattr(lmscore, "FREQUENT_WORDS", most)
    monkeypatch.setattr(lmscore, "FREQUENT_PAIRS", most)
    rng = random.Random(8)
    rows = [(i, " ".join(["a b", *(f"w{i}x{j}" for j in range(50)), *rng.choices(["a", "b", "c"], k=8)])) for i in range(100)]
    rows += [(i, rows[i][1]) for i in (3, 7)] + [(200, None)]
    wanted = {i for i in range(20)}
    got = sorted(lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in wanted], "target_id long")).collect(), key=repr)
    size = len({w for _, t in rows for w in low(t)}) + 2

    def model(docs):
        pairs = Counter(p for t in docs for p in zip(["<", *low(t)], low(t), strict=False))
        uni, total, kinds = Counter(), Counter(), Counter()
        for (h, w), n in pairs.items():
            uni[w] += n
            total[h] += n
            kinds[h] += 1
        one = lambda w: (uni[w] + max(1, len(uni)) / size) / (sum(uni.values()) + max(1, len(uni)))
        return lambda h, w: -math.log((pairs[h, w] + max(1, kinds[h]) * one(w)) / (total[h] + max(1, kinds[h])))

    models = model([t for _, t in rows]), model([t for i, t in rows if i in wanted])
    want = []
    for i, t in rows:
        pairs = list(zip(["<", *low(t)], low(t), strict=False))
        means = [sum(f(*p) for p in pairs) / len(pairs) if pairs else None for f in models]
        want.append((i, len(pairs), *means, means[0] - means[1] if pairs else None))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: r.doc_id), sorted(want), strict=True):
        assert tuple(g)[:2] == w[:2]
        assert all(x == y or x == pytest.approx(y, abs=1e-5) for x, y in zip(tuple(g)[2:], w[2:], strict=True))


def test_kernels():
    column = pa.array(["Ab cd", None, "", " x\ty ", "ab"])
    data, offsets = common.text_bytes(column.slice(0))
    data = common.lowered(data)
    starts, ends, row = common.word_bounds(data, offsets)
    assert [(bytes(data[a:b]), r) for a, b, r in zip(starts, ends, row, strict=True)] == [(b"ab", 0), (b"cd", 0), (b"x", 3), (b"y", 3), (b"ab", 4)]
    h = common.range_hashes(common.prefix_sums(data), starts, ends)
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    index = common.HashIndex(keys)
    assert (index.find(keys) == np.arange(1000)).all() and (index.find(keys + np.uint64(1)) == -1).all()
    assert [b.num_rows for b in common.pieces(pa.RecordBatch.from_arrays([column], names=["text"]), limit=5)] == [3, 1, 1]


def test_frequent_from(spark):
    """Never more rows than asked for, whatever the counts."""
    rows = [(n,) for n in [1] * 50 + [2] * 20 + [7] * 5 + [70_000] * 30 + [10**6] * 3 + [1 << 40]]
    counts = spark.createDataFrame(rows, "n long")
    for most, reached in ((0, 0), (1, 1), (3, 1), (4, 4), (33, 4), (34, 34), (38, 34), (58, 39), (59, 59), (10**6, 109)):
        low = lmscore.frequent_from(counts, F.col("n"), most)
        assert counts.where(F.col("n") >= low).count() == reached


def test_packed_pairs(spark):
    """Each pair once with its sums, in less than half the bytes of rows; equal keys of different pairs are told apart."""
    rng = np.random.default_rng(4)
    words = common.mixed(np.arange(1, 3001, dtype=np.uint64))
    before, word = words[rng.zipf(1.3, 60_000) % 3000], words[rng.zipf(1.3, 60_000) % 3000]
    target = rng.integers(0, 2, 60_000)
    got = lmscore.merged([(before[i::3], word[i::3], np.ones(20_000, np.uint8), target[i::3]) for i in range(3)])
    want = Counter(zip(before.tolist(), word.tolist(), strict=True))
    assert {(b, w): n for b, w, n, _ in zip(*(c.tolist() for c in got), strict=True)} == dict(want) and got[3].sum() == target.sum()
    raw = lmscore.packed(*got)
    names, first, last, *counts = lmscore.unpacked(*raw)
    assert sorted(zip(*(c.tolist() for c in (names[first], names[last], *counts)), strict=True)) == sorted(zip(*(c.tolist() for c in got), strict=True))
    assert sum(map(len, raw[1:])) < len(got[0]) * 10
    a, b = np.uint64(5), np.uint64(9)
    w = np.uint64(77)
    other = (lmscore.pair_keys(np.array([a]), np.array([w])) - common.mixed(np.array([b])))[0]  # with b, it has the key of (a, w)
    pair = lmscore.merged([(np.array([a, b, a, b]), np.array([w, other, w, other]), np.array([1, 2, 3, 4]))])
    assert sorted(pair[2].tolist()) == [4, 6]
    docs = spark.createDataFrame([("x y x y", True), ("y x", False), (None, False)], "text string, is_target boolean")
    shared = spark.sparkContext.broadcast(lmscore.Vocabulary(None))
    pairs = lmscore.count_pairs(docs.repartition(3), shared).persist()
    rows = lmscore.pair_rows(pairs).collect()
    assert sorted((r.background, r.target) for r in rows) == [(1, 0), (1, 1), (2, 1), (2, 2)]
    key = lambda rows: lmscore.pair_keys(*(np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in (0, 1)))
    assert lmscore.Flags(pairs).maybe(key(rows)).tolist() == [r.background > 1 for r in rows]
    assert sorted(r.background for r in lmscore.pair_rows(pairs, 2).collect()) == [2, 2]
    assert lmscore.count_pairs(docs.where("text is null"), shared).count() == 0


def test_an_index_travels_as_its_keys():
    import pickle

    keys = np.sort(common.mixed(np.arange(1, 100_001, dtype=np.uint64)))
    for k in (keys, keys[::-1].copy(), keys[:0]):
        again = pickle.loads(pickle.dumps(common.HashIndex(k), 5))
        assert (again.find(keys) == common.HashIndex(k).find(keys)).all() and (again.find(keys + np.uint64(1)) == -1).all()
    assert len(pickle.dumps(common.HashIndex(keys), 5)) < 100_000 * 9  # about 26 bytes each before


def test_word_parts_travel_packed(spark):
    """A word's sums over all ranges; what travels is a row for each range of words and task, not one for each word."""
    rng = np.random.default_rng(6)
    texts = [(" ".join(f"w{k}" for k in rng.zipf(1.2, 300) % 5000), bool(i % 3)) for i in range(60)]
    shared = spark.sparkContext.broadcast(lmscore.Vocabulary(None))
    pairs = lmscore.count_pairs(spark.createDataFrame(texts, "text string, is_target boolean").repartition(3), shared).persist()
    rows = lmscore.pair_rows(pairs).collect()
    want = defaultdict(lambda: [0] * 6)
    for before, word, b, t in rows:
        for i, x in enumerate((b, b > 0, t, t > 0)):
            want[before][i] += x
        for i, x in enumerate((b, t)):
            want[word][4 + i] += x
    parts = lmscore.word_parts(pairs)
    assert {r[0]: list(r[1:]) for r in parts.collect()} == dict(want)
    assert "HashAggregate" not in parts._jdf.queryExecution().toString()  # 20 million rows of 0.5 GB stood there
    seen = Counter(r.background for r in rows if r.background > 1)
    assert {r.n: r.rows for r in lmscore.count_rows(pairs, 2).groupBy("n").agg(F.sum("rows").alias("rows")).collect()} == dict(seen)
    for most in (0, 100, 10**6):
        low = lmscore.frequent_from(lmscore.count_rows(pairs, 2), F.col("n"), most, F.col("rows"))
        assert low == lmscore.frequent_from(lmscore.pair_rows(pairs, 2), F.col("background"), most)
    assert lmscore.word_parts(pairs.where("false")).count() == 0
    x = np.array([0, 3, 70_000, 1 << 40], np.uint64)
    assert (lmscore.unstepped(lmscore.stepped(x)) == x).all() and (lmscore.widened(lmscore.narrow(x), 4) == x).all()


def test_tables_go_when_they_were_read(spark, monkeypatch):
    """Of the pairs and what is joined to texts nothing is left on disk once the scores are known; other files stay."""
    from pathlib import Path

    from panelspark.sources import shared

    monkeypatch.setattr(lmscore, "FREQUENT_WORDS", 2)
    monkeypatch.setattr(lmscore, "FREQUENT_PAIRS", 2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(20, 3))], "doc_id long, text string")
    folder = Path(shared.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = lmscore.score(docs, spark.createDataFrame([(1,)], "target_id long"))
    assert out.count() == 20
    columns = [set(spark.read.parquet(str(p)).columns) for p in set(folder.iterdir()) - before]
    assert columns and not any({"shard", "pair"} & c for c in columns)
    foreign = str(folder / "of-others")
    docs.write.parquet(foreign)
    shared.discard(spark.read.parquet(foreign))
    assert spark.read.parquet(foreign).count() == 20


@pytest.mark.parametrize(("parts", "most"), [(1, 10**6), (3, 10**6), (3, 20), (2, 0)])
def test_kneser_ney_in_parts(spark, monkeypatch, parts, most):
    """The whole model, by look-up or by join, in one part or several, has the plain probabilities."""
    monkeypatch.setattr(quality, "PARTS", parts)
    monkeypatch.setattr(quality, "PART_BYTES", 10)
    monkeypatch.setattr(quality, "FREQUENT", most)
    train = [*texts(40, 1), None, "one"]
    other = [*texts(15, 2), train[0], train[3], "zz a zz B", "", None]
    frame = spark.createDataFrame(list(enumerate(other)), "of long, text string")
    got = {r.of: r for r in quality.text_sums(frame, spark.createDataFrame([(t,) for t in train], "text string")).collect()}
    plain = Plain(train)
    for i, t in enumerate(other):
        w = ["<", "<", *low(t)]
        want = [math.log(plain.p(g)) for g in zip(w, w[1:], w[2:], strict=False)]
        assert got[i].n == len(want) and got[i].s == pytest.approx(sum(want), abs=1e-8)


def test_all_trusted_text_trains(spark):
    """Nothing but the held-out quarter is left out, however much text there is."""
    docs = spark.createDataFrame([(i, "w " * 20_000 + f"v{i}") for i in range(200)], "doc_id long, text string")
    train, apart = quality.trusted_folds(docs, spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int"))
    assert train.count() + apart.count() == 200 and train.count() > 120  # 4 million words; 1,500,000 were the bound
