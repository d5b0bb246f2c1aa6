"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Counts of trigrams are summed by key in shuffles, and joins between these
sharded count tables give everything else: continuation counts of the lower
orders, totals and follower classes of each context, the three discounts of
each order from the counts of counts. Trusted documents outside the training
fold set the thresholds: for each language, a quantile of their perplexity.

The model is of all trusted text outside the quarter that only sets thresholds;
it stays in Spark. A token's log probability is a sum of what its trigram, its
bigram, its context and its two words add, each zero where training did not see
it, so a text's is a sum of look-ups. They are done in parts, by the word in the
middle: a part has all that an n-gram's smoothing needs. A bounded number of the
most frequent n-grams of a part goes to the tasks, the others are joined. Which
way one takes changes no result.

Defined cases: a null or empty text has no tokens, a null perplexity and is not
kept; a null language is a language of its own; a language without trusted
documents takes the quantile over all languages; without any trusted document
nothing is rejected but empty texts; repeated rows are scored each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import HashIndex, discard, giving_back, mixed, pieces, saved
from panelspark.llm.lmscore import FLAG_BITS, frequent_from, word_hashes

#: Parts of a model of more than ``PART_BYTES`` of text, and n-grams of a part that go to the tasks.
PARTS, PART_BYTES, FREQUENT = 8, 1 << 25, 500_000
QUANTILE = 0.98
_BEGIN = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xDA942042E4DD58B5)
#: Log perplexities are compared in steps of this size.
STEP = 0.001


def ngram_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: hashes of its trigram, its bigram, the two words before
    it as a bigram, and the word; and its row. Begin marks stand before a text."""
    w1, row = word_hashes(column)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[: len(w1)]
    before = np.r_[_BEGIN, w1[:-1]][: len(w1)]
    before[first] = _BEGIN
    w2 = mixed(before * _STEP + w1)
    context = np.r_[_BEGIN, w2[:-1]][: len(w1)]
    context[first] = mixed(np.array([_BEGIN]) * _STEP + _BEGIN)[0]
    return mixed(context * _STEP + w1 + np.uint64(1)), w2, context, w1, row


def previous_words(w1: np.ndarray, row: np.ndarray) -> np.ndarray:
    before = np.r_[_BEGIN, w1[:-1]][: len(w1)]
    before[np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[: len(w1)]] = _BEGIN
    return before


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return (words >> np.uint64(40)) % np.uint64(parts)


def count_trigrams(docs: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """``context, before, word, n`` of each distinct trigram of ``docs`` of which
    ``before``, the word before the last, is in a part of all words."""
    names = ["context", "before", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=1 << 23):
                key, _, context, word, row = ngram_keys(piece.column("text"))
                before = previous_words(word, row)
                on = np.flatnonzero(part_of(before, parts) == part)
                _, at, n = np.unique(key[on], return_index=True, return_counts=True)
                columns = [x[on[at]] for x in (context, before, word)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)], names=[*names, "n"])

    counts = docs.select("text").mapInArrow(giving_back(run), ", ".join(f"{c} long" for c in [*names, "n"]))
    return counts.groupBy(*names).agg(F.sum("n").alias("n"))


def with_key(rows: DataFrame, name: str, first: str, plus: int) -> DataFrame:
    """``rows`` (of whole and other numbers) with the key ``name`` of ``first`` and ``word``, as :func:`ngram_keys` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in (first, "word"))
            key = mixed(a * _STEP + b + np.uint64(plus)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {name} long")


def discounts(counts: DataFrame) -> Column:
    """The modified Kneser-Ney discount of a count ``n``, from the counts of counts."""
    n1, n2, n3, n4 = (float(x or 0) for x in counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first())
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5

    def d(k: int, this: float, following: float) -> float:
        return min(max(k - (k + 1) * y * following / this, 0.05), k - 0.05) if this and following else 0.5 * k

    values = d(1, n1, n2), d(2, n2, n3), d(3, n3, n4)
    return F.when(F.col("n") == 1, values[0]).when(F.col("n") == 2, values[1]).otherwise(values[2])


def order_tables(counts: DataFrame, context: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Of one order: ``key, alpha`` (the discounted share of each n-gram) and
    ``context, gamma`` (the share left to the lower order)."""
    less = discounts(counts)
    by = counts.withColumn("less", F.least(less, F.col("n").cast("double"))).groupBy(F.col(context).alias("of")).agg(F.sum("n").alias("total"), F.sum("less").alias("left"))
    by = saved(by)
    alpha = counts.join(by, F.col(context) == F.col("of")).select(F.col(key).alias("key"), ((F.col("n") - F.least(less, F.col("n").cast("double"))) / F.col("total")).alias("alpha"))
    return alpha, by.select(F.col("of").alias("key"), (F.col("left") / F.col("total")).alias("gamma"))


class Model:
    """Arrays of a fitted model, each order behind a hash index."""

    def __init__(self, tri: pa.Table, bi: pa.Table, uni: pa.Table, base: float):
        get = lambda t, c: t.column(c).to_numpy()
        self.tri, self.a3 = HashIndex(get(tri, "key").view(np.uint64)), get(tri, "alpha").astype(np.float32)
        self.bi, self.a2, self.g3 = HashIndex(get(bi, "key").view(np.uint64)), get(bi, "alpha").astype(np.float32), get(bi, "gamma").astype(np.float32)
        self.uni, self.a1, self.g2 = HashIndex(get(uni, "key").view(np.uint64)), get(uni, "alpha").astype(np.float32), get(uni, "gamma").astype(np.float32)
        self.base = base

    def log_probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each token's probability, and its row."""
        key, low, context, word, row = ngram_keys(column)

        def value(index: HashIndex, wanted: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
            at = index.find(wanted)
            return np.where(at >= 0, values[at], other).astype(np.float64) if len(values) else np.full(len(wanted), other)

        p = value(self.uni, word, self.a1, 0.0) + self.base
        p = value(self.bi, low, self.a2, 0.0) + value(self.uni, previous_words(word, row), self.g2, 1.0) * p
        p = value(self.tri, key, self.a3, 0.0) + value(self.bi, context, self.g3, 1.0) * p
        return np.log(p), row


def fit(docs: DataFrame) -> Model:
    """A model of all texts of ``docs`` in memory, for few texts; :func:`text_sums` has no such bound."""
    three = saved(with_key(with_key(count_trigrams(docs), "key", "context", 1), "low", "before", 0))
    two = saved(three.groupBy("low", "before", "word").agg(F.count(F.lit(1)).alias("n")))
    one = saved(two.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    a3, g3 = order_tables(three, "context", "key")
    a2, g2 = order_tables(two, "before", "low")
    a1, g1 = order_tables(one.withColumn("all", F.lit(0).cast("long")), "all", "word")
    join = lambda a, g: a.join(g, "key", "full").select("key", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
    words = one.count()
    rest = g1.first()
    return Model(a3.toArrow(), join(a2, g3).toArrow(), join(a1, g2).toArrow(), (rest.gamma if rest else 1.0) / (words + 1))


#: Told apart from trigrams, whose keys are as they are: bigrams, contexts, words before, words.
_KINDS = {k: (0x3C6EF372FE94F82B * (2 * i + 1)) % (1 << 63) for i, k in enumerate(("bigram", "context", "before", "word"))}


def shares(counts: DataFrame, less: Column, context: str) -> DataFrame:
    """``counts`` with ``kept``, ``total`` and ``left``: an n-gram has ``kept / total`` of its context, the lower order ``left / total``."""
    less = F.least(less, F.col("n").cast("double"))
    by = counts.groupBy(F.col(context).alias("of")).agg(F.sum("n").alias("total"), F.sum(less).alias("left"))
    return counts.withColumn("kept", F.col("n") - less).join(by, F.col(context) == F.col("of")).drop("of")


def model_values(three: DataFrame, two: DataFrame, less: tuple[Column, Column], words: DataFrame) -> DataFrame:
    """``key, value, n`` of a part: what an n-gram adds to a token's log probability."""
    kind = lambda c, k: F.col(c).bitwiseXOR(F.lit(_KINDS[k])).alias("key")
    share = F.col("left") / F.col("total")
    two = shares(two, less[0], "before").join(words, "word")
    two = two.withColumn("lower", share * F.col("p")).withColumn("p2", F.col("kept") / F.col("total") + F.col("lower"))
    two = saved(with_key(two.select("before", "word", "n", "total", "left", "lower", "p2"), "low", "before", 0))
    three = saved(with_key(shares(three, less[1], "context"), "key", "context", 1))
    one = lambda rows, k: rows.select(kind(k, k), F.log(share).alias("value"), F.col("total").alias("n")).distinct()
    tri = three.join(two.select("before", "word", "p2"), ["before", "word"])
    values = tri.select("key", F.log1p(F.col("kept") / (F.col("left") * F.col("p2"))).alias("value"), "n")
    values = values.unionAll(two.select(kind("low", "bigram"), (F.log("p2") - F.log("lower")).alias("value"), "n"))
    values = saved(values.unionAll(one(three, "context")).unionAll(one(two, "before")))
    discard(two)
    discard(three)
    return values


def key_flags(values: DataFrame) -> np.ndarray:
    """A flag for each value of the leading bits of a key, in bytes from the lowest bit on."""
    at = F.shiftrightunsigned("key", 64 - FLAG_BITS) + 1  # bitmaps count from 1
    rows = values.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toArrow()
    flags = np.zeros((1 << (FLAG_BITS - 15), 1 << 12), np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        flags[bucket - 1] = np.frombuffer(bits, np.uint8)
    return flags.ravel()


def part_sums(docs: DataFrame, values: DataFrame, part: int, parts: int, base: float) -> list[DataFrame]:
    """``of, n, s`` in parts that add up: tokens (from the first part) and their log probability, by ``of`` of ``docs``."""
    low = frequent_from(values, F.col("n"), FREQUENT)
    some = values.where(F.col("n") >= low).select("key", "value").toArrow()
    keys = some.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    rare = values.where(F.col("n") < low)
    joined = not rare.isEmpty()
    shared = docs.sparkSession.sparkContext.broadcast((HashIndex(keys[order]), np.r_[some.column("value").to_numpy()[order], 0.0], key_flags(rare) if joined else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, flags = shared.value
        for batch in batches:
            for piece in pieces(batch):
                key, low, context, word, row = ngram_keys(piece.column("text"))
                before, rows = previous_words(word, row), piece.num_rows
                here, own = (np.flatnonzero(part_of(x, parts) == part) for x in (before, word))
                kinds = {k: np.uint64(v) for k, v in _KINDS.items()}
                wanted = np.concatenate([key[here], low[here] ^ kinds["bigram"], context[here] ^ kinds["context"], before[here] ^ kinds["before"], word[own] ^ kinds["word"]])
                at_row = np.concatenate([*[row[here]] * 4, row[own]])
                at = index.find(wanted)
                n = np.bincount(row, minlength=rows) * (part == 0)
                s = np.bincount(at_row, known[at], minlength=rows) + n * np.log(base)
                off = np.flatnonzero(at < 0) if joined else at[:0]
                if joined:
                    bit = (wanted[off] >> np.uint64(64 - FLAG_BITS)).astype(np.int64)
                    off = off[(flags[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)]
                off = off[np.argsort(at_row[off], kind="stable")]
                ends = np.r_[0, np.cumsum(np.bincount(at_row[off], minlength=rows))].astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends), pa.array(wanted[off].view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("of"), pa.array(n), pa.array(s), others], names=["of", "n", "s", "others"])

    found = saved(docs.select("of", "text").mapInArrow(giving_back(run), "of long, n long, s double, others array<long>"))
    shared.destroy()
    out = [found.select("of", "n", "s")]
    if joined:
        tokens = found.select("of", F.explode("others").alias("other")).hint("merge")
        more = tokens.join(rare.select("key", "value"), F.col("other") == F.col("key")).groupBy("of").agg(F.sum("value").alias("s"))
        out = [saved(out[0]), saved(more.select("of", F.lit(0).cast("long").alias("n"), "s"))]
        discard(found)
    return out


def text_sums(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``of, n, s``: tokens of the texts of each ``of`` (``docs`` has ``of, text``)
    and their log probability, by the model of all texts of ``train``."""
    train = train.select("text")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = PARTS if size > PART_BYTES else 1
    train = saved(train)
    threes = [saved(count_trigrams(train, k, parts)) for k in range(parts)]
    discard(train)
    twos = [saved(three.groupBy("before", "word").agg(F.count(F.lit(1)).alias("n"))) for three in threes]
    every = lambda tables: reduce(DataFrame.unionAll, tables)
    one = saved(every(twos).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    less = discounts(every(twos)), discounts(every(threes))
    own = F.least(discounts(one), F.col("n").cast("double"))
    words, total, left = one.agg(F.count(F.lit(1)), F.sum("n"), F.sum(own)).first()
    base = (left / total if words else 1.0) / (words + 1)
    one = saved(one.select("word", "n", ((F.col("n") - own) / F.lit(float(total or 1)) + F.lit(base)).alias("p")))
    sums = []
    for k, (three, two) in enumerate(zip(threes, twos, strict=True)):
        values = model_values(three, two, less, one.select("word", "p"))
        discard(three)
        discard(two)
        here = F.pmod(F.shiftrightunsigned("word", 40), F.lit(parts)) == k
        of_words = one.where(here).select(F.col("word").bitwiseXOR(F.lit(_KINDS["word"])).alias("key"), (F.log("p") - F.lit(float(np.log(base)))).alias("value"), "n")
        sums += part_sums(docs, values.unionAll(of_words), k, parts, base)
        discard(values)
    return every(sums).groupBy("of").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def trusted_folds(docs: DataFrame, labels: DataFrame, train_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The training rows (``text``), and the ids of trusted documents that set the thresholds.

    A quarter of the trusted documents never trains; all others do. With
    ``train_words``, only as many of them train as hold so many words, judged by a
    count of words over hash buckets, and the rest also sets thresholds."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    bucket = F.pmod(F.xxhash64("good_id", F.lit("trust")), F.lit(1 << 20))
    good = saved(good.withColumn("bucket", bucket))
    apart = F.pmod(F.xxhash64("good_id", F.lit("apart")), F.lit(4)) == 0
    if train_words is None:
        ids = good.where(~apart).select("good_id")
        return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("good_id"), "left_semi").select("text"), good.where(apart).select("good_id")
    # lengths only: no text moves for this
    sizes = docs.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) / 4).alias("w")).join(good.where(~apart), F.col("doc_id") == F.col("good_id"))
    by = sizes.select((F.col("bucket") / 256).cast("int").alias("b"), "w").groupBy("b").agg(F.sum("w").alias("w"))  # w is above the mean number of words
    upto = by.withColumn("upto", F.sum("w").over(Window.orderBy("b"))).agg(F.max(F.when(F.col("upto") <= train_words, F.col("b"))), F.sum("w")).first()
    if upto[1] is None:
        limit = 0
    elif upto[1] <= train_words:
        limit = 1 << 20
    elif upto[0] is not None:
        limit = (upto[0] + 1) * 256
    else:  # even the first of 4,096 parts is too large
        limit = int((1 << 20) * train_words / upto[1])
    trains = ~apart & (F.col("bucket") < limit)
    ids = saved(good.where(trains).select("good_id"))
    # train_words bounds these rows unless nearly all are empty: so they are counted first
    ids = F.broadcast(ids) if ids.count() <= train_words else ids
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("good_id"), "left_semi").select("text")
    return rows, good.where(~trains).select("good_id")


def perplexities(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``doc_id, lang, n_tokens, log_ppl`` of each row; rows of one id and text have one of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("of"), "text")
    sums = text_sums(rows.select("of", "text"), train).withColumnRenamed("of", "of_text")
    copies = rows.groupBy("of").agg(F.count(F.lit(1)).alias("copies")).withColumnRenamed("of", "of_copies")
    both = rows.drop("text").join(sums, F.col("of") == F.col("of_text")).join(copies, F.col("of") == F.col("of_copies"))
    # the order of a sum may change its last digits, no more
    ppl = F.when(F.col("n") > 0, F.round(-F.col("s") / F.col("n"), 9))
    return both.select("doc_id", "lang", (F.col("n") / F.col("copies")).cast("long").alias("n_tokens"), ppl.alias("log_ppl"))


def language_thresholds(scored: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``of_lang, threshold``: the quantile of log perplexity over trusted rows of
    each language, exact to ``STEP``; the row with ``every`` is over all languages.
    Counts per step are summed first, so no task gets a language's rows."""
    rows = scored.where("log_ppl is not null").join(trusted, F.col("doc_id") == F.col("good_id"), "left_semi")
    bins = rows.groupBy("lang", F.ceil(F.col("log_ppl") / STEP).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.select(F.lit(False).alias("every"), "lang", "bin", "n").unionAll(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang"), "bin", "n"))
    part = Window.partitionBy("every", "lang")
    upto = bins.withColumn("upto", F.sum("n").over(part.orderBy("bin"))).withColumn("all", F.sum("n").over(part))
    return upto.where(F.col("upto") >= F.col("all") * quantile).groupBy("every", F.col("lang").alias("of_lang")).agg((F.min("bin") * STEP).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, train_words: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity, threshold, kept`` for each row."""
    train, trusted = trusted_folds(docs, labels, train_words)
    scored = saved(perplexities(docs, train))
    limits = saved(language_thresholds(scored, trusted, quantile))
    every = limits.where("every").agg(F.max("threshold")).first()[0]
    every = float("inf") if every is None else every
    # one row for each language: counted before it is broadcast
    own = limits.where("not every").drop("every")
    own = F.broadcast(own) if own.count() <= 10_000 else own
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("of_lang")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(every)))
    return out.select("doc_id", "lang", "n_tokens", F.exp("log_ppl").alias("perplexity"), F.exp("threshold").alias("threshold"), F.coalesce(F.col("log_ppl") <= F.col("threshold"), F.lit(False)).alias("kept"))
