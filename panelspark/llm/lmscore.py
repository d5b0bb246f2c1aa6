"""LM scoring by cross-entropy difference.

A target and a background bigram model of the same form share one vocabulary:
every word of the corpus (with one unknown word that has no counts, and a
begin-of-text mark). Both models count all of their documents. Each token has a
loss under either model, smoothed with Witten-Bell interpolation down to the
uniform distribution; the score of a document is the mean of background loss
minus target loss per token, so the higher it is, the more the text is like the
target. A ``vocabulary`` can be given: then only so many of the most frequent
words are known, and all others are the unknown word.

All tables follow the corpus and stay in Spark: the pairs of words with their
counts, and what each word adds to the losses of its pairs. A bounded number of
the most frequent words and pairs goes to the tasks, which look them up. A pair
that is not among them counts as seen once, here, so that its loss follows from
its two words; a sort-merge join then brings the difference for the pairs that
were seen more often, and the whole loss where a word is rarer than those in
the tasks. Which way a word or pair takes changes no result. Words are known by
64-bit hashes, and so are pairs in the last join.

Defined cases: a null or empty text has no tokens and null losses and score;
repeated rows count and are scored each; with no target documents the target
model is uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import HashIndex, discard, giving_back, lowered, mixed, pieces, prefix_sums, range_hashes, saved, text_bytes, tidy, word_bounds

#: Words and pairs that go to the tasks; all others are joined.
FREQUENT_WORDS, FREQUENT_PAIRS = 1_000_000, 2_000_000
#: Counts below this are told apart one by one, higher ones by their five leading bits.
EXACT = 1 << 16
#: What a word adds to the losses of the pairs that it begins (tokens and kinds of
#: words after it) and that it ends (its tokens), for the background and the target.
PARTS = ("after_b", "kinds_b", "after_t", "kinds_t", "own_b", "own_t")


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every lower-case word."""
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, row = word_bounds(data, offsets)
    return range_hashes(prefix_sums(data), starts, ends), row


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``n``: occurrences in all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in pieces(batch):
                words, n = np.unique(word_hashes(part.column("text"))[0], return_counts=True)
                held.append((words, n))
                rows += len(words)
                if rows > 1 << 20:
                    yield from summed(held)
                    held, rows = [], 0
        yield from summed(held)

    def summed(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            words, inverse = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Hashes of words: 0 begins a text, 1 is any unknown word."""

    def __init__(self, words: list[int] | None):
        self.index = None if words is None else HashIndex(np.array(words, np.int64).view(np.uint64))

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word before, word, and row of every token."""
        word, row = word_hashes(column)
        if self.index:
            word = np.where(self.index.find(word) < 0, np.uint64(1), word)
        before = np.r_[np.uint64(0), word[:-1]][: len(word)]
        before[np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[: len(word)]] = 0
        return before, word, row


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before) + word


def planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on: high bytes are mostly zero and pack well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(raw: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"u{width}").ravel()


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return planes(x.astype(np.min_scalar_type(int(x.max(initial=0)))))


def widened(raw: bytes, n: int) -> np.ndarray:
    return unplaned(raw, len(raw) // n)


def stepped(words: np.ndarray) -> bytes:
    """Ascending hashes as steps, which have fewer bytes that are not zero."""
    return planes(np.diff(words, prepend=np.uint64(0)))


def unstepped(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw, 8), dtype=np.uint64)


def merged(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Each pair (word before, word, counts) of the parts once, by its key, with the sums of its counts. Empties ``held``."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    held.clear()

    def ordered(order: np.ndarray) -> np.ndarray:
        """Puts the columns in order; whether each pair but the first is another than the one before."""
        for i, c in enumerate(columns):
            columns[i] = c[order]  # one at a time: the tasks are small
        return (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])

    key = pair_keys(*columns[:2])
    order = np.argsort(key)
    key, differ = key[order], ordered(order)
    if (differ & (key[1:] == key[:-1])).any():  # different pairs of one key could lie between each other
        differ = ordered(np.lexsort((columns[1], columns[0], key)))
    new = np.flatnonzero(np.r_[True, differ])
    return [columns[0][new], columns[1][new], *(np.add.reduceat(c, new, dtype=np.int64) for c in columns[2:])]


#: Some pairs: their words, then for each pair the step to the place of the word before it, the place of the word, and the counts.
_PACKED = "shard long, n long, words binary, steps binary, places binary, background binary, target binary"
_COUNTED = ("before", "word", "background", "target")
#: Unpacked pairs that leave a task at once.
SLICE = 1 << 16
#: Leading bits of a pair's key that tell whether it may have been seen twice: a flag for each value goes to the tasks.
FLAG_BITS = 26


def packed(before: np.ndarray, word: np.ndarray, background: np.ndarray, target: np.ndarray) -> tuple:
    """The columns of :data:`_PACKED` from ``n`` on."""
    words, place = np.unique(np.r_[before, word], return_inverse=True)
    first, last = place[: len(before)], place[len(before) :]
    order = np.argsort(first, kind="stable")
    return len(before), stepped(words), narrow(np.diff(first[order], prepend=0)), narrow(last[order]), narrow(background[order]), narrow(target[order])


def unpacked(n: int, words: bytes, steps: bytes, places: bytes, background: bytes, target: bytes) -> tuple[np.ndarray, ...]:
    """Words, places of the word before and of the word, and the counts (unsigned, of any width)."""
    return unstepped(words), np.cumsum(widened(steps, n), dtype=np.int64), widened(places, n), widened(background, n), widened(target, n)


def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """What is in each row of packed pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield unpacked(*(batch.column(c)[i].as_py() for c in ("n", "words", "steps", "places", "background", "target")))


def counted(batches: Iterator[pa.RecordBatch], least: int = 1, below: int = 1 << 62) -> Iterator[tuple[np.ndarray, ...]]:
    """``before, word, background, target`` of packed pairs seen from ``least`` to ``below`` - 1 times."""
    for words, first, last, background, target in blobs(batches):
        some = np.flatnonzero((background >= least) & (background < below))
        for lo in range(0, len(some), SLICE):
            on = some[lo : lo + SLICE]
            yield words[first[on]], words[last[on]], background[on].astype(np.int64), target[on].astype(np.int64)


def pair_rows(pairs: DataFrame, least: int = 1) -> DataFrame:
    """A row for each of the packed ``pairs`` seen ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in counted(batches, least):
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=_COUNTED)

    return pairs.mapInArrow(giving_back(run), ", ".join(f"{c} long" for c in _COUNTED))


def count_rows(pairs: DataFrame, least: int = 1) -> DataFrame:
    """``n, rows``: how many of the packed ``pairs`` were seen ``n`` times, ``least`` or more (in parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, background in zip(batch.column("n"), batch.column("background"), strict=True):
                seen, rows = np.unique(widened(background.as_py(), n.as_py()), return_counts=True)
                on = seen >= least
                yield pa.RecordBatch.from_arrays([pa.array(seen[on].astype(np.int64)), pa.array(rows[on])], names=["n", "rows"])

    return pairs.select("n", "background").mapInArrow(giving_back(run), "n long, rows long")


class Flags:
    """Whether pairs of the leading bits of a key were seen twice: no for sure, or maybe."""

    def __init__(self, pairs: DataFrame):
        self.flags = np.zeros(1 << (FLAG_BITS - 3), np.uint8)
        for row in pairs.where("twice is not null").select("shard", "twice").toArrow().to_pylist():
            at = row["shard"] * len(row["twice"])
            self.flags[at : at + len(row["twice"])] = np.frombuffer(row["twice"], np.uint8)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - FLAG_BITS)).astype(np.int64)
        return (self.flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def count_pairs(docs: DataFrame, vocabulary) -> DataFrame:  # noqa: ANN001
    """The packed pairs of ``docs`` (``text``, ``is_target``) with their counts:
    all documents are background. They stand by ranges of their keys of about
    2**24 bytes of text; the first row of a range has ``twice``, a flag for each
    value of the keys' leading bits."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(20, max(5, (total >> 24).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in batches:
            for part in pieces(batch, limit=1 << 18):
                before, word, row = vocabulary.value.tokens(part.column("text"))
                wanted = part.column("is_target").to_numpy(zero_copy_only=False).astype(np.uint8)[row]
                held.append((before, word, np.ones(len(word), np.uint8), wanted))
                tokens += len(word)
                if tokens > 1 << 21:
                    yield summed(held)
                    tokens = 0
        if tokens:
            yield summed(held)

    def summed(held: list) -> pa.RecordBatch:
        columns = merged(held)
        shard = (pair_keys(*columns[:2]) >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        out = [(int(shard[a]), *packed(*(c[a:b] for c in columns))) for a, b in zip(cut, np.r_[cut[1:], len(shard)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

    def columns_of(*row) -> tuple[np.ndarray, ...]:  # noqa: ANN002
        words, first, last, *counts = unpacked(*row)
        return words[first], words[last], *counts

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in by_shard(batches, columns_of):
            yield from rows(shard, held)

    def rows(shard: int, held: list) -> Iterator[pa.RecordBatch]:
        columns = merged(held)
        twice = np.zeros(1 << (FLAG_BITS - bits), bool)
        twice[(pair_keys(*columns[:2])[columns[2] > 1] >> np.uint64(64 - FLAG_BITS)).astype(np.int64) - (shard << (FLAG_BITS - bits))] = True
        for lo in range(0, len(columns[0]), 1 << 19):
            row = (shard, *packed(*(c[lo : lo + (1 << 19)] for c in columns)), None if lo else np.packbits(twice).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 6), strict=True)], names=[c.split()[0] for c in kept.split(", ")])

    kept = f"{_PACKED}, twice binary"
    return docs.mapInArrow(giving_back(run), _PACKED).repartition("shard").sortWithinPartitions("shard").mapInArrow(giving_back(join), kept)


def by_shard(batches: Iterator[pa.RecordBatch], columns_of: Callable[..., tuple]) -> Iterator[tuple[int, list]]:
    """Each shard of ``batches`` (sorted by it) with the columns of its rows."""
    shard, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            s, *row = (c[i].as_py() for c in batch.columns)
            if s != shard and held:
                yield shard, held
                held = []
            shard = s
            held.append(columns_of(*row))
    if held:
        yield shard, held


_PARTED = "shard long, n long, words binary, " + ", ".join(f"{p} binary" for p in PARTS)


def word_parts(pairs: DataFrame) -> DataFrame:
    """``id`` and its :data:`PARTS`, for each word and the begin-of-text mark of
    packed ``pairs``. What a task knows of a range of words travels as one row."""
    total = pairs.agg(F.sum("n")).first()[0] or 0
    bits = min(20, max(5, (total >> 20).bit_length()))

    def summed(held: list) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        order = np.argsort(columns[0])
        words = columns[0][order]
        new = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        return [words[new], *(np.add.reduceat(c[order], new, dtype=np.int64) for c in columns[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for words, first, last, background, target in blobs(batches):
            sums = [np.bincount(at, of, len(words)) for at, of in ((first, background), (first, background > 0), (first, target), (first, target > 0), (last, background), (last, target))]
            held.append((words, *(x.astype(np.int64) for x in sums)))
            rows += len(words)
            if rows > 1 << 19:
                yield from dealt(summed(held))
                rows = 0
        if held:
            yield from dealt(summed(held))

    def dealt(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shard = (columns[0] >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        out = [(int(shard[a]), int(b - a), stepped(columns[0][a:b]), *(narrow(c[a:b]) for c in columns[1:])) for a, b in zip(cut, np.r_[cut[1:], len(shard)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[c.split()[0] for c in _PARTED.split(", ")])

    def columns_of(n: int, words: bytes, *parts: bytes) -> tuple[np.ndarray, ...]:
        return unstepped(words), *(widened(x, n) for x in parts)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_shard(batches, columns_of):
            columns = summed(held)
            for lo in range(0, len(columns[0]), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + SLICE].view(np.int64)) for c in columns], names=["id", *PARTS])

    parts = pairs.mapInArrow(giving_back(run), _PARTED).repartition("shard").sortWithinPartitions("shard")
    return parts.mapInArrow(giving_back(join), ", ".join(f"{c} long" for c in ("id", *PARTS)))


def frequent_from(table: DataFrame, count: Column, most: int, rows: Column | None = None) -> int:
    """A count that at most ``most`` rows reach: the smallest, or from :data:`EXACT` on
    the smallest with five leading bits. Where a single one of these has more rows,
    it is one that none reaches. A row of ``table`` may stand for several (``rows``)."""
    shift = F.greatest(F.length(F.bin(count)) - 5, F.lit(0))
    coarse = F.call_function("shiftleft", F.call_function("shiftright", count, shift), shift)
    sizes = {r.n: r.rows for r in table.groupBy(F.when(count < EXACT, count).otherwise(coarse).alias("n")).agg(F.sum(F.lit(1) if rows is None else rows).alias("rows")).collect()}
    total, low = 0, 1 << 62
    for n in sorted(sizes, reverse=True):
        total += sizes[n]
        if total > most:
            break
        low = n
    return low


class Smoothing:
    """Witten-Bell losses of the background (0) and the target (1)."""

    def __init__(self, size: int, tokens: tuple[int, int], kinds: tuple[int, int]):
        self.size, self.tokens, self.kinds = size, tokens, [max(k, 1) for k in kinds]

    def loss(self, k: int, n, after, kinds, own, log, at_least_1):  # noqa: ANN001, ANN201
        """-log of the probability of a word after a word: of arrays or of columns."""
        single = (own + self.kinds[k] / self.size) / (self.tokens[k] + self.kinds[k])
        kinds = at_least_1(kinds)
        return log(after + kinds) - log(n + kinds * single)

    def of(self, k: int, n: np.ndarray | int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Losses from the parts of the words before and the words."""
        return self.loss(k, n, first[:, 2 * k], first[:, 2 * k + 1], last[:, 4 + k], np.log, lambda x: np.maximum(x, 1))


def rare_losses(pairs: DataFrame, words: DataFrame, frequent, smoothing: Smoothing, least: int) -> DataFrame:  # noqa: ANN001
    """``pair, b, t0, t1``: what tasks do not know of the losses of ``pairs``: the
    difference to a pair seen once (in a text that is no target, or is one) for
    pairs of frequent words seen from 2 to ``least`` - 1 times; the whole losses
    for pairs with another word. ``frequent`` has the index and the parts of
    frequent words."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, parts = frequent.value
        for before, word, *counts in counted(batches, 2, least):
            i, j = index.find(before), index.find(word)
            on = (i >= 0) & (j >= 0)
            n, first, last = [c[on] for c in counts], parts[i[on]], parts[j[on]]
            b = smoothing.of(0, n[0], first, last) - smoothing.of(0, 1, first, last)
            t = [smoothing.of(1, n[1], first, last) - smoothing.of(1, once, first, last) for once in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(before, word)[on].view(np.int64)), *(pa.array(x.astype(np.float32)) for x in (b, *t))], names=["pair", "b", "t0", "t1"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, parts = frequent.value
        for before, word, *counts in counted(batches, 1, least):
            i, j = index.find(before), index.find(word)
            on = np.flatnonzero((i < 0) | (j < 0))
            key, i, j = pair_keys(before, word)[on], i[on], j[on]
            # a word that is known here joins under the pair's key: no frequent word is a key of the joins
            left, right = np.where(i < 0, before[on], key), np.where(j < 0, word[on], key)
            values = [pa.array(parts[at, c].astype(np.int64), mask=at < 0) for c, at in zip(range(6), (i, i, i, i, j, j), strict=True)]
            keys = [pa.array(x.view(np.int64)) for x in (key, left, right)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c[on]) for c in counts), *values], names=["pair", "left", "right", "n_b", "n_t", *PARTS])

    rows = pairs.mapInArrow(giving_back(rest), "pair long, left long, right long, n_b long, n_t long, " + ", ".join(f"{p} long" for p in PARTS))
    for key, names in (("left", PARTS[:4]), ("right", PARTS[4:])):
        other = words.select(F.col("id"), *(F.col(p).alias(f"joined_{p}") for p in names)).hint("merge")
        rows = rows.join(other, F.col(key) == F.col("id"), "left").drop("id")
        rows = rows.withColumns({p: F.coalesce(p, f"joined_{p}") for p in names}).drop(*(f"joined_{p}" for p in names))
    b, t = (smoothing.loss(k, F.col(f"n_{x}"), F.col(f"after_{x}"), F.col(f"kinds_{x}"), F.col(f"own_{x}"), F.log, lambda c: F.greatest(c, F.lit(1))) for k, x in enumerate("bt"))
    whole = rows.select("pair", *(x.cast("float").alias(name) for x, name in ((b, "b"), (t, "t0"), (t, "t1"))))
    if least <= 2:
        return whole
    return pairs.mapInArrow(giving_back(known), "pair long, b float, t0 float, t1 float").unionAll(whole)


def frequent_losses(pairs: DataFrame, words: DataFrame, smoothing: Smoothing) -> DataFrame:
    """``before, word, b, t``: whole losses of ``pairs`` (a row for each)."""
    both = pairs
    for key, names in (("before", PARTS[:4]), ("word", PARTS[4:])):
        other = words.select(F.col("id").alias(f"id_{key}"), *names)
        both = both.join(other, F.col(key) == F.col(f"id_{key}"), "left")
    b, t = (smoothing.loss(k, F.col(n), F.col(f"after_{x}"), F.col(f"kinds_{x}"), F.col(f"own_{x}"), F.log, lambda c: F.greatest(c, F.lit(1))) for k, (n, x) in enumerate((("background", "b"), ("target", "t"))))
    return both.select("before", "word", b.alias("b"), t.alias("t"))


def score(docs: DataFrame, target_ids: DataFrame, vocabulary: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, background_loss, target_loss, score`` of each row of
    ``docs`` (``doc_id, text``); ``target_ids`` (``target_id``) name the target documents."""
    context = docs.sparkSession.sparkContext
    known = None
    if vocabulary is not None:
        known = [r.word for r in count_words(docs).orderBy(F.desc("n"), "word").limit(vocabulary).select("word").collect()]
    shared = context.broadcast(Vocabulary(known))
    flagged = with_targets(docs, target_ids)
    with tidy(docs.sparkSession, maxBytesPerBatch="4m"):  # rows of packed pairs are large
        pairs = saved(count_pairs(flagged.select("text", "is_target"), shared))
        words = saved(word_parts(pairs))
    own = [F.col("own_b"), F.col("own_t")]
    sums = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in own), *(F.count(F.when(c > 0, 1)) for c in own)).first()
    smoothing = Smoothing((sums[2] if known is None else len(known)) + 2, sums[:2], sums[2:])
    often = F.col("after_b") + F.col("own_b")
    some = words.where(often >= frequent_from(words, often, FREQUENT_WORDS)).toArrow()
    parts = np.stack([np.r_[some.column(p).to_numpy(), 0] for p in PARTS], axis=1)  # the last row is for words that are not there
    if parts.max() < 1 << 31:
        parts = parts.astype(np.int32)
    ids = some.column("id").to_numpy().view(np.uint64)
    order = np.argsort(ids)
    frequent = context.broadcast((HashIndex(ids[order]), parts[np.r_[order, len(order)]]))
    least = max(2, frequent_from(count_rows(pairs, 2), F.col("n"), FREQUENT_PAIRS, F.col("rows")))
    twice = context.broadcast(Flags(pairs) if least > 2 else None)
    with tidy(docs.sparkSession):
        some = frequent_losses(pair_rows(pairs, least), words, smoothing).toArrow()
    keys = pair_keys(*(some.column(c).to_numpy().view(np.uint64) for c in ("before", "word")))
    order = np.argsort(keys)
    table = context.broadcast((HashIndex(keys[order]), np.stack([some.column(c).to_numpy().astype(np.float32)[order] for c in "bt"], axis=1)))
    del some, parts, keys, ids, order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (index, losses), (word_index, parts) = table.value, frequent.value
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch):
                before, word, row = shared.value.tokens(part.column("text"))
                flag = part.column("is_target").to_numpy(zero_copy_only=False).astype(np.int64)
                pair, rows = pair_keys(before, word), part.num_rows
                at = index.find(pair)
                on, off = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                i, j = word_index.find(before[off]), word_index.find(word[off])
                here = (i >= 0) & (j >= 0)
                first, last, single = parts[i[here]], parts[j[here]], row[off][here]
                once = [smoothing.of(k, n, first, last) for k, n in enumerate((1, flag[single]))]
                found = [(np.bincount(row[on], losses[at[on], k].astype(np.float64), minlength=rows) + np.bincount(single, once[k], minlength=rows)).astype(np.float64) for k in (0, 1)]
                # of the others, those of two frequent words that were seen once are done
                off = off[~here if least <= 2 else ~here | twice.value.maybe(pair[off])]
                ends = np.r_[0, np.cumsum(np.bincount(row[off], minlength=rows))].astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(ends), pa.array(pair[off].view(np.int64)))
                ids = (np.arange(number, number + rows) << 1) | flag
                columns = [pa.array(ids), part.column("doc_id"), pa.array(np.bincount(row, minlength=rows)), *map(pa.array, found), others]
                number += rows
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "b", "t", "others"])

    texts = flagged.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "is_target")
    found = saved(texts.mapInArrow(giving_back(run), "row long, doc_id long, n_tokens long, b double, t double, others array<long>"))
    # one table after the other, and no longer on any disk than it is read
    table.destroy()
    twice.destroy()
    rare = saved(rare_losses(pairs, words, frequent, smoothing, least))
    frequent.destroy()
    discard(pairs)
    tokens = found.select("row", F.explode("others").alias("other")).hint("merge")
    t = F.when(F.col("row") % 2 == 1, F.col("t1")).otherwise(F.col("t0"))
    rest = saved(tokens.join(rare, F.col("other") == F.col("pair")).groupBy(F.col("row").alias("of")).agg(F.sum("b").alias("more_b"), F.sum(t).alias("more_t")))
    discard(rare)
    both = found.drop("others").join(rest, F.col("row") == F.col("of"), "left")
    means = [F.when(F.col("n_tokens") > 0, (F.col(k) + F.coalesce(f"more_{k}", F.lit(0.0))) / F.col("n_tokens")) for k in "bt"]
    return both.select("doc_id", "n_tokens", means[0].alias("background_loss"), means[1].alias("target_loss"), (means[0] - means[1]).alias("score"))


#: Target ids that go to all tasks; more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000


def with_targets(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``doc_id, text, is_target`` of each row."""
    ids = saved(target_ids.select(F.col("target_id").cast("long").alias("target_id")).where("target_id is not null").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("target_id"), "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("is_target"))


def good_ids(labels: DataFrame) -> DataFrame:
    """``target_id`` of documents labelled as of good quality and not toxic."""
    return labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("target_id"))
