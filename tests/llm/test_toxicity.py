"""Toxicity (op2): held-out accuracy and defined cases."""

import random
import zlib

from panelspark.llm import toxicity


def test_features():
    lexicon = toxicity.Lexicon({b"fool": 3.0, b"lowei*": 4.0, b"here": 1.5})
    plain = dict(zip(toxicity.FEATURES, toxicity.features("You FOOL! And loweixyz here", lexicon), strict=True))
    assert plain["lexicon"] == 2 / 5 and plain["near_second"] == 2 / 5 and plain["shouting"] == 1 / 5 and plain["weight"] == 8.5
    assert dict(zip(toxicity.FEATURES, toxicity.features("what a f00l and f.o-ol", lexicon), strict=True))["hidden"] > 0
    assert len(toxicity.features(None, lexicon)) == len(toxicity.FEATURES)


def test_fold(spark):
    ids = [0, 1, 2, 17, 123456789, -5]
    got = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", toxicity.held_out(toxicity.F.col("i")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    clean, bad = [f"w{i}" for i in range(300)], ["grob", "snark", "vile"]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(clean, k=rng.randint(5, 60))
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "clash"))
        if i % 4 != 1:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, rows[3], (5000, None, ""), (5001, "", "")], "doc_id long, text string, score string")
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) > 0.97 * len(held)
    kept = toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and 700 < kept.count() < 820


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(docs.where("false"), none).count() == 0
