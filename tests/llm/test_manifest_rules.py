"""Host rules (op12) and the Merkle manifest (op13) against plain versions, and defined cases."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from panelspark.llm import hostrules, hotkeys, merkle


def plain_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for places in windows.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_rates(failures, n, rule_count):
    """The largest shrunk rate of each host, from {host: [failures by rule]} and {host: documents}."""
    total, m, out = sum(n.values()), len(n), {}
    for h in n:
        rates = []
        for r in range(rule_count):
            p = sum(failures[x][r] for x in n) / total
            spread = sum(n[x] * (failures[x][r] / n[x] - p) ** 2 for x in n)
            room = p * (1 - p) * (total - sum(v * v for v in n.values()) / total - (m - 1))
            if room <= 1e-9:
                rates.append(p)
                continue
            g = min(1.0, max(0.0, (spread - p * (1 - p) * (m - 1)) / room))
            rates.append(p if g == 0 else (failures[h][r] + (1 - g) / g * p) / (n[h] + (1 - g) / g))
        out[h] = max(rates)
    return out


def some_texts(rng, n):
    vocabulary = ["a", "bb", "çé", "the", "#", "x<y>", "1,5", " nbsp", "long" * 4]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary[: rng.randint(1, 9)]) for _ in range(rng.choice([0, 1, 2, 3, 40, 60, 200]))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\n\n", "\x0b"]) for w in words))
    return out


def test_rules_against_plain(spark):
    rng = random.Random(12)
    texts = [*some_texts(rng, 150), None, "", " \n\t", "a b c a b c", "a a a a", "l\nl\n l\nl ", "w " * 30000, "\n".join(f"line {i}" for i in range(5000))]
    hosts = ["bad" if i % 3 == 0 else rng.choice(["x", "y", None]) for i in range(len(texts))]
    rows = [(i if i % 7 else None, t, h, 1) for i, (t, h) in enumerate(zip(texts, hosts, strict=True))]
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, source string, n_words int")
    got = sorted(tuple(r) for r in hostrules.judge(docs).select(F.coalesce("doc_id", F.lit(-1)), *hostrules.COUNTS[:5], "base_failed", "kept", "host_rate").collect())
    want, failures, n = [], {}, {}
    for i, t, h, _ in [*rows, rows[1]]:
        c = plain_counts(t)
        n_lines = len([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        failed = [c[0] < 50 or 2 * c[4] > c[0], 10 * c[2] > c[0], 10 * c[3] > 3 * n_lines, c[1] < 3 * c[0] or c[1] > 10 * c[0]]
        n[h] = n.get(h, 0) + 1
        failures[h] = [a + b for a, b in zip(failures.get(h, [0] * 4), failed, strict=True)]
        want.append((-1 if i is None else i, *c, failed[0], h))
    rates = plain_rates(failures, n, 4)
    want = sorted((*w[:-1], not w[6] and rates[w[-1]] <= hostrules.LIMIT, round(rates[w[-1]], 9)) for w in want)
    assert [g[:8] for g in got] == [w[:8] for w in want]
    assert all(abs(g[8] - w[8]) < 2e-9 for g, w in zip(got, want, strict=True))


def test_bad_host(spark):
    """A good document goes with its host; other columns stay; empty and one-host tables are defined."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "short" if i % 10 else good, "spam") for i in range(50)] + [(100 + i, good, f"h{i % 5}") for i in range(50)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, source string, host string")
    kept = hostrules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(100, 150))
    assert {r.kept for r in hostrules.judge(docs.where("source = 'spam'")).collect()} == {False}
    assert {r.kept for r in hostrules.judge(docs.where("source = 'h1'")).collect()} == {True}
    assert hostrules.judge(docs.where("false")).count() == 0 and hostrules.keep_good(docs.where("false")).count() == 0


def test_join_said(spark):
    """Hot and other keys, null among them, find their one row."""
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else f"k{i % 5}") for i in range(40)], "i int, key string")
    said = spark.createDataFrame([(None, 1, True), ("k1", 2, True), ("k2", 3, False), ("k3", 4, False)], "key string, value int, hot boolean")
    got = {(r.i, r.value) for r in hotkeys.join_said(rows, said, ["key"], "hot").collect()}
    known = {None: 1, "k1": 2, "k2": 3, "k3": 4}
    assert got == {(i, known[k]) for i in range(40) for k in [None if i % 4 == 0 else f"k{i % 5}"] if k in known}


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([digest(*x[i : i + 2]) for i in range(0, len(x), 2)])
    return levels


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {t: plain_tree([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    top = plain_tree([levels[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            proof, at = [], plain_leaf(row, int(row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0))
            for tree, place in ((levels[t], i), (top, k)):
                for level in tree[:-1]:
                    other = level[place ^ 1] if place ^ 1 < len(level) else ""
                    proof.append(other)
                    at = digest(other, at) if place & 1 else digest(at, other)
                    place >>= 1
            out.append((row["doc_id"], leaf, levels[t][-1][0], top[-1][0], digest(*proof), at, at == top[-1][0]))
    return out


def key(row):
    return tuple("" if x is None else str(x) for x in row)


def check_manifest(spark, rows, monkeypatch=None):
    docs = spark.createDataFrame([tuple(r[f] for f in merkle.FIELDS) + ("x",) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string")
    got = sorted((tuple(r) for r in merkle.verify(docs.repartition(3)).collect()), key=key)
    assert got == sorted(plain_manifest(rows), key=key)


def made(rng, i, lang):
    return {"doc_id": i, "source": rng.choice(["s", None]), "lang": lang, "n_chars": rng.choice([None, 5]), "text": rng.choice([None, "", "é" * 3, "long " * 2000])}


def test_manifest_against_plain(spark, monkeypatch):
    rng = random.Random(13)
    sizes = {"de": 1, "en": 37, None: 3, "": 2, "éo": 5, "zz": 8}
    rows = [made(rng, rng.choice([None, *range(30)]), lang) for lang, n in sizes.items() for _ in range(n)]
    check_manifest(spark, rows + rows[5:9])
    # several segments on a path, and equal segments in the store
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "WIDTH", 4)
    check_manifest(spark, rows + rows[5:9] + [rows[0]] * 21)


def test_manifest_small(spark):
    rng = random.Random(1)
    check_manifest(spark, [made(rng, 7, "en")])
    check_manifest(spark, [made(rng, i, None) for i in range(5)])
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.verify(docs).count() == 0


def test_manifest_requests(spark):
    """A few requests of one tree: paths lead from their leaves to the root."""
    leaves = spark.range(700).select(F.lit("t").alias("tree"), F.col("id").alias("rank"), F.lit(700).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    forest = merkle.build(leaves)
    tops = forest.roots.select("*", F.array().cast(f"array<{merkle.STEP}>").alias("path"), F.lit(1).alias("told"))
    asked = leaves.where("rank in (0, 255, 256, 699)").select("tree", "rank", F.col("digest").alias("asked"))
    got = merkle.descend(forest, tops, asked).withColumn("end", merkle.fold(F.col("asked"), F.col("path"))).collect()
    root = plain_tree([digest(str(i)) for i in range(700)])[-1][0]
    assert len(got) == 4 and all(r.asked == r.digest and r.end == root and len(r.path) == 10 for r in got)
