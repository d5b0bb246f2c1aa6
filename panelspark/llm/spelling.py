"""Spelling variants, by a trie over frequency vectors.

A word's frequency vector counts its letters in :data:`GROUPS` groups. Words that
differ by one inserted, deleted or replaced letter have vectors with a surplus
of one at most and a deficit of one at most. A trie arranges the words by
successive counts; a depth-first search takes many words down at once, spends
their two budgets, and leaves a branch when no word has any left. The words at
the leaves that are reached are verified letter by letter.

The first :data:`SHARED` levels are cells, by which Spark deals the words: each
word lies in one cell and is looked up in the cells that its budgets reach.
The levels below are a trie in the task that has the cell. A cell of more than
``block`` words is dealt in blocks, each with its own trie, and its look-ups
likewise, so no task holds more than one block of words; look-ups stream past.

Counts of words are aggregates over all texts. A word's ``form`` has at least
five times its count, so forms form no circle and no chain of longs has more
than 27 words: five rounds of doubling find all roots.

Defined cases: a null or empty text has no words; a null doc_id changes no
word; repeated rows count each for itself; an empty table gives an empty
result; other columns are ignored. Letters are those of Latin-1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import saved
from panelspark.llm.hotkeys import HOT_SHARE, join_said

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LETTERS, MIN_COUNT, TIMES, ALTERED = 6, 5, 5, 199
GROUPS = 16
#: Letters share a group by code point modulo 16; the groups of frequent letters come first.
ORDER = (5, 9, 1, 4, 3, 14, 2, 15, 12, 13, 0, 6, 7, 8, 10, 11)
SHARED = 5
#: Counts in a cell's name go up to this (a higher one is this: a cell more is looked up, none is missed).
MOST = 15
#: Words of a task's trie, and look-ups of a block.
BLOCK = 20_000
#: Words under a node that are compared at once; pairs from which the words of a leaf are matched by their deletions.
LEAF, DENSE = 16, 4096
PAIRS = "word string, other string, other_n long"


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of ``docs`` (``doc_id, text``). One run in :data:`ALTERED`, by the checksum
    of document and run, loses a letter."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(f"{LETTERS}{{{MIN_LETTERS},}}"), 0)
    tokens = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(runs).alias("run"))
    sums = tokens.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = sums.select(F.when(F.col("h") % ALTERED == 0, less).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.length("word") >= MIN_LETTERS) & (F.col("n") >= MIN_COUNT))


def _counts(word: Column) -> list[Column]:
    """A word's counts in the groups of the cells."""
    out = []
    for group in ORDER[:SHARED]:
        letters = "".join(chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)) if c % GROUPS == group)
        out.append(F.least(F.length(word) - F.length(F.translate(word, letters, "")), F.lit(MOST)))
    return out


def _cell(counts: list[Column]) -> Column:
    return sum((c * (MOST + 1) ** i for i, c in enumerate(counts)), F.lit(0)).cast("long")


def _reached(counts: list[Column], cell: Column) -> Column:
    """The cells of higher number that a surplus and a deficit of one can reach: of
    two words in different cells the one of the lower cell looks for the other."""
    moves = []
    for up in range(SHARED):
        for down in range(-1, up):
            allowed = (counts[up] < MOST) & (counts[down] > 0 if down >= 0 else F.lit(True))
            moves.append(F.when(allowed, cell + (MOST + 1) ** up - ((MOST + 1) ** down if down >= 0 else 0)))
    return F.filter(F.array(*moves), lambda c: c.isNotNull())


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes ``a`` to ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _matched(left: list[str], right: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of :func:`one_edit` in two lists, by the words less one letter: in time
    that grows with the letters, not with the pairs."""
    whole, less = {}, {}
    for j, w in enumerate(right):
        whole.setdefault(w, []).append(j)
        for i in range(len(w)):
            less.setdefault(w[:i] + w[i + 1 :], []).append((j, i))
    for k, w in enumerate(left):
        found = {j for j, _ in less.get(w, ())}
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            found.update(whole.get(short, ()))
            found.update(j for j, at in less.get(short, ()) if at == i and right[j] != w)
        yield from ((k, j) for j in found)


def vectors(words: list[str]) -> np.ndarray:
    """The counts of words in all groups, in the trie's order."""
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * GROUPS + data % GROUPS, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
    return counts[:, list(ORDER)].astype(np.int32)


class Trie:
    """Words by their vectors: the words below a node are a range of the sorted ones."""

    def __init__(self, words: list[str], n: list[int]):
        v = vectors(words)
        order = np.lexsort(v.T[::-1])
        self.v, self.words, self.n = v[order], [words[i] for i in order], [n[i] for i in order]

    def search(self, words: list[str], once: bool) -> Iterator[tuple[int, int]]:
        """(place in ``words``, place in the trie) of all pairs one edit apart; ``once``:
        where the first is the smaller word."""
        if self.words and words:
            v, none = vectors(words), np.zeros(len(words), np.int32)
            for lo, hi, at, level, surplus, deficit in self._below(0, len(self.words), 0, v, np.arange(len(words)), none, none):
                for i, j in self._verified(words, v, lo, hi, at, level, surplus, deficit):
                    if not once or words[i] < self.words[j]:
                        yield i, j

    def _below(self, lo: int, hi: int, level: int, v: np.ndarray, at: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple]:
        if level == GROUPS or hi - lo <= LEAF:
            yield lo, hi, at, level, surplus, deficit
            return
        counts = self.v[lo:hi, level]
        first = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), hi - lo], strict=True):
            more = v[at, level] - counts[a]
            s, d = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
            on = np.flatnonzero((s <= 1) & (d <= 1))
            if len(on):
                yield from self._below(lo + a, lo + b, level + 1, v, at[on], s[on], d[on])

    def _verified(self, words: list[str], v: np.ndarray, lo: int, hi: int, at: np.ndarray, level: int, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[int, int]]:
        if level == GROUPS and len(at) * (hi - lo) > DENSE:
            yield from ((int(at[k]), lo + j) for k, j in _matched([words[i] for i in at.tolist()], self.words[lo:hi]))
            return
        step = max(1, DENSE * 4 // (hi - lo))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            more = v[part, None, level:] - self.v[None, lo:hi, level:]
            s = surplus[a : a + step, None] + np.maximum(more, 0).sum(axis=2)
            d = deficit[a : a + step, None] + np.maximum(-more, 0).sum(axis=2)
            for k, j in zip(*(x.tolist() for x in np.nonzero((s <= 1) & (d <= 1))), strict=True):
                i = int(part[k])
                if one_edit(words[i], self.words[lo + j]):
                    yield i, lo + j


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks one after the other: the words of each (``asks`` 0), then the look-ups of its own words (1) and of others (2)."""
    block, words, n, trie = None, [], [], None
    for batch in batches:
        out = ([], [], [])
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "i", "j")], axis=1)
        asks = batch.column("asks").to_numpy()
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1])][: len(keys)])
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(keys)], strict=True):
            key = tuple(keys[a])
            if key != block:
                block, words, n, trie = key, [], [], None
            these, counts = batch.column("word").slice(a, b - a).to_pylist(), batch.column("n").slice(a, b - a).to_pylist()
            if not asks[a]:
                words, n, trie = words + these, n + counts, None
                continue
            trie = trie or Trie(words, n)
            for i, j in trie.search(these, once=asks[a] == 1):
                for column, both in zip(out, ((these[i], trie.words[j]), (trie.words[j], these[i]), (trie.n[j], counts[i])), strict=True):
                    column.extend(both)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "other", "other_n"])


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, other, other_n``, both ways, for all pairs of different words of
    ``vocabulary`` (``word, n``, each word once, a written table) that are one edit apart."""
    counts = _counts(F.col("word"))
    own = vocabulary.select(_cell(counts).alias("cell"), "word", "n")
    above = vocabulary.select(F.explode(_reached(counts, _cell(counts))).alias("cell"), "word", "n", F.lit(2).alias("asks"))
    asking = above.unionAll(own.select("cell", "word", "n", F.lit(1).alias("asks")))
    held = own.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    sizes = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(held, "cell")
    total = sizes.agg(F.sum("asked").alias("total"))
    cells = saved(sizes.crossJoin(F.broadcast(total)).select("cell", F.ceil(F.col("held") / block).alias("is"), F.ceil(F.col("asked") / (8 * block)).alias("js"), (F.col("asked") >= HOT_SHARE * F.col("total")).alias("hot")))

    def dealt(rows: DataFrame, mine: str, every: str) -> DataFrame:
        rows = join_said(rows, cells, ["cell"], "hot")
        pick = F.pmod(F.xxhash64("word"), F.col(f"{mine}s")).alias(mine)
        return rows.select("cell", pick, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{every}s") - 1)).alias(every), "asks", "word", "n").select("cell", "i", "j", "asks", "word", "n")

    rows = dealt(own.withColumn("asks", F.lit(0)), "i", "j").unionAll(dealt(asking, "j", "i"))
    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "asks").mapInArrow(_search, PAIRS)


def roots(forms: DataFrame, rounds: int = 5) -> DataFrame:
    """``word, root`` of ``forms`` (``word, form``, no circles): where the forms of forms
    end, through chains of up to 2 to the power of ``rounds`` forms."""
    known = saved(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = saved(known.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return known


def group_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``vocabulary`` (``word, n``, a written table)."""
    pairs = near_words(vocabulary, block).join(vocabulary, "word")
    best = F.min(F.when(F.col("other_n") >= TIMES * F.col("n"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))))
    found = saved(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"))
    rows = vocabulary.join(found, "word", "left").join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def group_documents(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (``doc_id, text``) with their forms."""
    return group_words(saved(word_counts(docs)))
