"""Toxicity: boosted trees over dense features, with isotonic calibration.

Features of a text are densities: words of a learned lexicon, the same words
behind obfuscation (digits and signs for letters, marks inside words, spaced
letters), their nearness to a second-person word, capitals, punctuation, and
obfuscated words of any kind. The lexicon is learned from the training labels:
whole words, and beginnings of words for languages that inflect or compound,
that stand in toxic texts far oftener than in others.

The lexicon, the trees and the calibration are fitted on at most ``fit_rows``
labelled rows, chosen by a hash of their ids; everything else reads all rows.
Labels, language, source and doc_id are no inputs of a score.

Defined cases: a null or empty text has all features 0 and a score like any
other; labels that are null, or of unknown documents, are ignored; repeated
rows are scored each; with one class only among the labels the score is that
class's share; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import saved

FIT_ROWS = 12_000
LEXICON = 600
PREFIXES = (4, 5, 6, 7, 8)
#: Log odds from which a term counts as a lexicon word; below it, terms only add weight.
STRONG = 2.5

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ya tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer sie ihnen usted ustedes ti tuyo tus vosotros su sus".encode().split())
#: Signs and digits that stand for letters.
_LOOKS = dict(zip(b"013457@$!", b"oieastasi", strict=True))

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LEET = bytes(_LOOKS.get(b, _PLAIN[b]) for b in range(256))
_MARKS = b"*.-_~^'+|"

FEATURES = ("lexicon", "lexicon_any", "lexicon_count", "weight", "weight_density", "hidden", "near_second", "second", "capitals", "shouting", "punctuation", "exclamation", "obfuscated", "spaced", "length")


def terms(words: list[bytes]) -> set[bytes]:
    """Words, and the beginnings of longer words (with a star)."""
    out = set(words)
    for w in set(words):
        out.update(w[:k] + b"*" for k in PREFIXES if len(w) > k)
    return out


class Lexicon:
    """Terms and their log odds."""

    def __init__(self, terms: dict[bytes, float]):
        self.terms = terms
        self.known: dict[bytes, float] = {}

    def odds(self, w: bytes) -> float:
        """The highest log odds of a word or its beginnings; 0 if unlisted."""
        found = self.known.get(w)
        if found is None:
            get = self.terms.get
            found = max(get(w, 0.0), *(get(w[:k] + b"*", 0.0) for k in PREFIXES if len(w) > k), 0.0)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w] = found
        return found


def features(text: str | None, lexicon: Lexicon) -> tuple[float, ...]:
    data = (text or "").encode()
    words = data.translate(_PLAIN).split()
    n = max(1, len(words))
    odds = {w: x for w in set(words) if (x := lexicon.odds(w))}
    hits = [i for i, w in enumerate(words) if odds.get(w, 0.0) >= STRONG] if odds else []
    weight = sum(odds.values())
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near, k = 0, 0
    for i in hits:
        while k < len(second) and second[k] < i - 5:
            k += 1
        near += k < len(second) and second[k] <= i + 5
    raw = data.split()
    odd = [w for w in raw if len(w) > 2 and not w.isalpha() and w[:1].isalnum() and w[-1:].isalnum()]
    hidden = 0
    for w, times in Counter(odd).items():
        plain = w.translate(_LEET, _MARKS).replace(b" ", b"")
        hidden += times * (lexicon.odds(plain) >= STRONG > lexicon.odds(w.lower()))
    singles = sum(len(a) == len(b) == len(c) == 1 for a, b, c in zip(words, words[1:], words[2:], strict=False))
    chars = max(1, len(data))
    upper = sum(map(data.count, _UPPER))
    shouting = sum(len(w) > 2 and w.isupper() for w in raw)
    marks = sum(map(data.count, _PUNCTUATION))
    return (
        len(hits) / n, float(bool(hits)), float(min(len(hits), 10)), weight, weight / n, hidden / n, near / n, len(second) / n, upper / chars, shouting / n,
        marks / chars, (data.count(b"!") + data.count(b"?")) / chars, len(odd) / n, singles / n, float(np.log1p(n)),
    )


_UPPER = [bytes([b]) for b in range(65, 91)]
_PUNCTUATION = [bytes([b]) for b in b".,;:!?*#$%&@|~^_-+=<>/\\()[]{}'\""]

def held_out(doc_id: Column) -> Column:
    """Rows of the fold that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``text, toxic, fold`` of at most about ``fit_rows`` labelled rows outside
    the held-out fold; one row for each labelled document."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, fit_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    some = known.where(draw < share).groupBy(F.col("doc_id").alias("known_id")).agg(F.max("toxic").alias("toxic"))
    # at most about fit_rows short rows: bounded by that parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("known_id"))
    return rows.select("text", F.col("toxic").cast("double").alias("label"), F.pmod(F.xxhash64("known_id", F.lit("fold")), F.lit(4)).alias("fold"))


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> Lexicon:
    """Terms whose share of toxic texts is far above their share of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
                (toxic if label else other).update(terms((text.as_py() or "").encode().translate(_PLAIN).split()))
        kept = list(toxic)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array([toxic[t] for t in kept], pa.int64()), pa.array([other[t] for t in kept], pa.int64())], names=["term", "toxic", "other"])
        kept = [t for t in other if t not in toxic]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array([0] * len(kept), pa.int64()), pa.array([other[t] for t in kept], pa.int64())], names=["term", "toxic", "other"])

    counts = rows.mapInArrow(run, "term binary, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    classes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    yes, no = classes.get(1.0, 0) + 1.0, classes.get(0.0, 0) + 1.0
    odds = F.log((F.col("toxic") + 0.5) / yes) - F.log((F.col("other") + 0.5) / no)
    best = counts.where(F.col("toxic") >= 4).withColumn("odds", odds).where("odds > 1.2").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(size)
    return Lexicon({bytes(r.term): r.odds for r in best.select("term", "odds").collect()})


def with_features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with a column for each feature in the place of ``text``."""
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{f} double" for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([features(t.as_py(), lexicon) for t in b.column("text")], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names=[*kept, *FEATURES])

    return rows.mapInArrow(run, schema)


class Model:
    """The fitted lexicon, trees and calibration."""

    def __init__(self, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, trees: int = 12, depth: int = 3):
        rows = saved(training_rows(docs, labels, fit_rows))
        self.share = float(rows.agg(F.avg("label")).first()[0] or 0.0)
        self.trees = self.calibration = None
        # the lexicon comes from half of the rows, so that its words are no better in training than elsewhere
        self.lexicon = learn_lexicon(rows.where("fold < 2"))
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        if not 0.0 < self.share < 1.0:
            return
        ready = self.assembler.transform(saved(with_features(rows, self.lexicon).coalesce(4)))
        fit, rest = ready.where("fold <> 3"), ready.where("fold = 3")
        if fit.select("label").distinct().count() < 2:
            return
        self.trees = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=2, maxMemoryInMB=64).fit(fit.select("features", "label"))
        if rest.count():
            self.calibration = IsotonicRegression(featuresCol="raw").fit(self._raw(rest).select("raw", "label"))

    def _raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``score`` in the place of ``text``."""
        kept = [c for c in rows.columns if c != "text"]
        if self.trees is None:
            return rows.select(*kept, F.lit(self.share).alias("score"))
        out = self._raw(self.assembler.transform(with_features(rows, self.lexicon)))
        if self.calibration is None:
            return out.select(*kept, F.col("raw").alias("score"))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        # isotonic steps are flat: a little of the trees' own order is left within them
        return self.calibration.transform(out).select(*kept, (score * 0.98 + F.col("raw") * 0.02).alias("score"))


THRESHOLD = 0.3


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    model = Model(docs, labels, fit_rows)
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    model = Model(docs, labels, fit_rows)
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text"))
    scored = model.score(held).where(F.col("score") < THRESHOLD)
    return scored.select(*[F.col(n).alias(c) for c, n in names.items()])
