"""Chat formatting (op3), secret scans (op4) and mixing (op6): defined cases."""

import hashlib
import random

from pyspark.sql import functions as F

from panelspark.llm import chat, mixing, secrets


def test_chat(spark):
    rows = [(1, 0, "user", "a\\<|end|>", "x"), (1, 1, "assistant", None, "x"), (1, 2, "assistant", "</s>", "x"), (1, 3, None, "tail", "x"), (None, 0, "user", "only", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, last string")
    got = {r.conv_id: r for r in chat.digest_examples(chat.format_conversations(turns)).collect()}
    whole = "user\na\\<|end|>\nassistant\n\nassistant\n</s>\n\ntail\n"
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[1].n_turns == 4
    assert got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256(b"</s>").hexdigest()
    assert got[None].loss_chars == 0 and chat.format_conversations(turns.where("false")).count() == 0


def test_secrets(spark):
    rows = [(1, "é Password: 'abcdefgh1' x"), (2, None), (3, ""), (1, "é Password: 'abcdefgh1' x"), (4, "token=short AKIAABCDEFGHIJKL " + "0f" * 16)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.scan_documents(docs).collect())
    assert got == [(1, 1, 0, 0, "assign:2:22")] * 2 + [(2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (4, 0, 1, 1, "access:12:28,hex:29:61")]
    assert {r.text for r in secrets.redact_documents(docs).where("doc_id = 1").collect()} == {"é [SECRET]' x"}
    clash = docs.withColumnsRenamed({"spans": "found_blob"}).withColumn("blob", docs.doc_id)
    assert secrets.redact_documents(clash).columns == clash.columns and secrets.redact_documents(clash).count() == 5


def test_ledger(spark, tmp_path):
    """A second scan scans nothing and finds the same; a new rule version scans that rule alone."""
    docs = spark.createDataFrame([(1, "password=abcdefgh1"), (2, "password=abcdefgh1"), (3, "nothing"), (4, None)], "path long, text string")
    first = secrets.scan(docs)
    first.write.parquet(str(tmp_path / "a"))
    ledger = spark.read.parquet(str(tmp_path / "a"))
    assert ledger.count() == 3
    planted = ledger.withColumn("found", F.transform("found", lambda e: e.withField("spans", F.array(F.struct(F.lit(7).alias("start"), F.lit(9).alias("end"))))))
    again = secrets.findings_by_path(docs, secrets.scan(docs, planted.unionAll(planted)))  # what is known comes from the ledger
    assert {tuple((s.start, s.end) for s in r.spans) for r in again.collect()} == {((7, 9),) * len(secrets.RULES)} and again.count() == 4
    rules = (secrets.RULES[0]._replace(version=2), *secrets.RULES[1:])
    newer = {r.path: r.spans for r in secrets.findings_by_path(docs, secrets.scan(docs, planted, rules), rules).collect()}
    assert [(s.start, s.kind, s.end) for s in newer[2]] == [(0, 0, 18), *((7, k, 9) for k in range(1, len(rules)))]
    more = docs.unionByName(spark.createDataFrame([(5, "token: 12345678")], docs.schema))
    fresh = {r.path: len(r.spans) for r in secrets.findings_by_path(more, secrets.scan(more, ledger)).collect()}
    assert fresh == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    assert secrets.scan(docs.where("false"), ledger).count() == 0 and secrets.scan(docs, ledger.where("false")).count() == 3


def test_many_hits(spark):
    text = "token=12345678 " * 700
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.scan_documents(docs).first()
    assert row.n_assign == 700 and row.spans.split(",")[-1] == f"assign:{699 * 15}:{699 * 15 + 14}"


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), "a" if i % 3 else None) for i in range(90)] + [(5, None, "b"), (5, None, "b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = sorted(tuple(r) for r in mixing.mix_sources(docs, fan_in=8).select("doc_id", "size", "target", "copies", "taken").collect())
    assert len(got) == 92 and all(t == c * s and c <= 3 for _, s, _, c, t in got)
    assert got == sorted(tuple(r) for r in mixing.mix_sources(docs.repartition(3), fan_in=8).select("doc_id", "size", "target", "copies", "taken").collect())
    assert mixing.mix_sources(docs.where("false")).count() == 0
    whole = mixing.mix_documents(docs)
    assert whole.columns == ["doc_id", "text", "source", "copies", "taken", "size", "source_size", "target"]
    again = mixing.mix_documents(docs.repartition(5, "size").sortWithinPartitions(F.desc("doc_id")))
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))  # whatever the layout
    assert whole.groupBy().sum("taken").first()[0] > 0
    assert mixing.mix_documents(docs.where("false")).count() == 0


def plain_targets(sizes):
    """Targets source by source, the excess dealt out again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, shut = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(target[s] for s in shut)
        level = rest / max(1, sum(weight[s] for s in names if s not in shut))
        over = [s for s in names if s not in shut and weight[s] * level > 3 * sizes[s]]
        for s in names:
            if s not in shut:
                target[s] = 3 * sizes[s] if s in over else weight[s] * level
        if not over:
            return target
        shut |= set(over)


def test_mixing_against_plain(spark):
    """Targets as dealt out one by one; each source within half of one document of its own."""
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.paretovariate(0.8) * 5), rng.choice(["a", "b", "é", "zz", None, "c"])) for i in range(900)]
    rows += [(1000 + i, "w " * 3, "tiny") for i in range(3)] + [(2000, None, "void"), (2001, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, fan_in=16).collect()
    words = {i: len((t or "").split()) for i, t, _ in rows}
    sizes, most = {}, {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words[i]
        most[s] = max(most.get(s, 0), words[i])
    target, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == words[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-3 for s in sizes)
    # each document keeps its mean over the draws
    few = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i < 40 else "b") for i in range(60)], "doc_id long, text string, source string")
    due = {r.source: r.target / r.source_size for r in mixing.mix_sources(few).collect()}
    mean = {}
    for seed in range(12):
        for r in mixing.mix_sources(few, seed=seed).collect():
            mean[r.source] = mean.get(r.source, 0) + r.copies / 12
    assert abs(mean["a"] / 40 - due["a"]) < 0.1 and abs(mean["b"] / 20 - due["b"]) < 0.15
