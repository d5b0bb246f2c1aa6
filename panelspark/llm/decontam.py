"""Benchmark decontamination with an FM-index per training shard.

A task reads its documents as word numbers: words of the benchmark keep their
number, all others are one number that no phrase holds. Runs of benchmark words
shorter than the shortest phrase cannot hold an occurrence and go with them, so
the shard that is indexed is what can match at all, and nothing that can is
left out. Over it stand a suffix array, its Burrows-Wheeler transform in a
wavelet tree, and every ``SAMPLE``-th suffix position. All phrases (windows of
``window`` item words) are searched backward together; the rows of a hit walk
to a sampled suffix for their place, and overlapping occurrences are merged
into removal spans. A document lies in one shard, so nothing is shuffled.

The phrases of up to ``BLOCK_WORDS`` benchmark words go to the tasks at once;
a larger benchmark goes in blocks of whole items, one pass each.

Defined cases: a null or empty text has no words; an item with no words never
occurs, one with fewer than ``window`` words is one phrase; equal items are
each reported; repeated documents each get their row; empty tables give no
rows, or no hits; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import saved

WINDOW = 10
SAMPLE = 8
BLOCK_WORDS = 1_000_000
SHARD_WORDS = 1 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(_FOLD).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s`` by doubling the length compared."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    step = 1
    while True:
        second = np.full(n, -1)
        second[: n - step] = rank[step:] if step < n else rank[:0]
        key = (rank.astype(np.int64) << 32) + (second + 1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, one bit plane per level (the wavelet matrix layout)."""

    def __init__(self, s: np.ndarray):
        self.levels = max(1, int(s.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.levels - 1, -1, -1):
            bit = (s >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        lo, hi = np.zeros_like(upto), upto
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit == 1, zeros + lo1, lo - lo1)
            hi = np.where(bit == 1, zeros + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    """Index of a sequence of numbers from 0 up; a sentinel below all is added."""

    def __init__(self, s: np.ndarray):
        s = np.r_[s + 1, 0]
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.tree = WaveletTree(self.bwt)
        self.before = np.r_[0, np.cumsum(np.bincount(s))]
        self.marked = sa % SAMPLE == 0
        self.mark_rank = np.r_[0, np.cumsum(self.marked)]
        self.samples = sa[self.marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase (a row of
        ``phrases``, filled from the left), stepping backward through all at once."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.bwt), np.int64)
        for back in range(phrases.shape[1]):
            on = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(on):
                break
            c = phrases[on, lengths[on] - 1 - back] + 1
            known = c < len(self.before) - 1
            lo[on[~known]] = hi[on[~known]] = 0
            on, c = on[known], c[known]
            lo[on] = self.before[c] + self.tree.rank(c, lo[on])
            hi[on] = self.before[c] + self.tree.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: walk back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.marked[at]
            out[left[done]] = self.samples[self.mark_rank[at[done]]] + steps
            left, at = left[~done], at[~done]
            c = self.bwt[at]
            at = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The phrases of some benchmark items, as word numbers."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        rows, owner = [], []
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of((text or "").encode())]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.append(ids[i : i + window])
                owner.append(item)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for i, r in enumerate(rows):
            self.rows[i, : len(r)] = r
        self.owner = np.array(owner, np.int64)
        self.shortest = int(self.lengths.min(initial=window))

    def find(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, word after the last, and item of every occurrence in the
        shard ``ids``, whose documents begin at ``starts``."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.rows) or not len(ids):
            return none
        known = ids > 0
        new = known.copy()
        new[1:] &= ~known[:-1]
        new[starts[starts < len(ids)]] = known[starts[starts < len(ids)]]
        begin = np.flatnonzero(new)
        stop = known.copy()
        stop[:-1] &= ~known[1:]
        stop[starts[(starts > 0) & (starts <= len(ids))] - 1] = known[starts[(starts > 0) & (starts <= len(ids))] - 1]
        size = np.flatnonzero(stop) + 1 - begin
        begin, size = begin[size >= self.shortest], size[size >= self.shortest]
        if not len(begin):
            return none
        # the runs one after the other, a 0 after each
        place = np.cumsum(size + 1) - (size + 1)
        shard = np.zeros(int(place[-1] + size[-1] + 1), np.int64)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        shard[np.repeat(place, size) + inner] = ids[np.repeat(begin, size) + inner]
        index = FMIndex(shard)
        lo, hi = index.search(self.rows, self.lengths)
        hits = hi - lo
        which = np.repeat(np.arange(len(hits)), hits)
        rows = np.repeat(lo, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        at = index.locate(rows)
        run = np.searchsorted(place, at, side="right") - 1
        first = begin[run] + at - place[run]
        return first, first + self.lengths[which], self.owner[which]


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The items with words, in blocks of about ``block_words`` words."""
    sized = benchmark.select("item_id", "text", (F.length(F.coalesce("text", F.lit(""))) / 2 + 1).cast("long").alias("most"))
    total = sized.agg(F.sum("most")).first()[0] or 0
    n = -(-total // block_words)
    return [sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).select("item_id", "text") for i in range(n)]


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, cut: bool = False) -> DataFrame:
    """``docs`` (with ``text``) and the columns ``n_words``, ``spans`` (merged
    [first, end) word ranges that occurrences cover, in order) and ``items``
    (ids that occur, distinct). With ``cut``, ``docs`` without the spans' words
    instead, by the task that finds them."""
    spark = docs.sparkSession
    added = ["n_words", "spans", "items"]
    docs = docs.drop(*added)
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"), F.array().cast("array<bigint>").alias("items"))
    schema, blocks = out.schema, _blocks(benchmark, block_words)
    for number, block in enumerate(blocks):
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in block.collect()], window))
        last = number + 1 == len(blocks)
        out = out.mapInArrow(_scan(phrases, shard_words, cut and last), docs.schema if cut and last else schema)
        if not last:
            out = saved(out)
    if cut and not blocks:
        return docs
    if not blocks:
        out = out.withColumn("n_words", F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long"))
    return out


def _scan(phrases, shard_words: int, cut: bool = False):  # noqa: ANN001, ANN202
    """Adds what one block of phrases finds to what stands in the rows; with
    ``cut``, takes the spans from the texts in their place."""

    def shard(rows: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
        starts = np.cumsum([0] + [len(x) for x in ids])
        first, end, item = phrases.value.find(np.concatenate(ids), starts)
        doc = np.searchsorted(starts, first, side="right") - 1
        spans, items = rows.column("spans").to_pylist(), rows.column("items").to_pylist()
        order = np.lexsort((first, doc))
        for d in np.unique(doc):
            lo, hi = np.searchsorted(doc[order], [d, d + 1])
            own = order[lo:hi]
            items[d] = sorted({*items[d], *item[own].tolist()})
            pairs = sorted([(s["first"], s["end"]) for s in spans[d]] + list(zip((first[own] - starts[d]).tolist(), (end[own] - starts[d]).tolist(), strict=True)))
            merged: list[list[int]] = []
            for a, b in pairs:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            spans[d] = [{"first": a, "end": b} for a, b in merged]
        if cut:
            return without_spans(rows.select([n for n in rows.schema.names if n not in ("n_words", "spans", "items")]), spans)
        new = {"n_words": pa.array(np.diff(starts)), "spans": pa.array(spans, rows.schema.field("spans").type), "items": pa.array(items, rows.schema.field("items").type)}
        return pa.RecordBatch.from_arrays([new.get(n, rows.column(n)) for n in rows.schema.names], names=rows.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = phrases.value.number.get
        for batch in batches:
            ids, begun, held = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                words = words_of((text.as_py() or "").encode())
                ids.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
                held += len(words)
                if held >= shard_words:
                    yield shard(batch.slice(begun, i + 1 - begun), ids)
                    ids, begun, held = [], i + 1, 0
            if ids:
                yield shard(batch.slice(begun), ids)

    return run


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row."""
    found = occurrences(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given ranges of words (and what stands between those words)."""
    data = text.encode()
    inside = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    end = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, data[at:]]).decode()


def without_spans(rows: pa.RecordBatch, spans: list[list[dict]]) -> pa.RecordBatch:
    """``rows`` with the spans of each cut from its text; ``n_chars`` follows."""
    names, touched = rows.schema.names, [i for i, s in enumerate(spans) if s]
    if not touched:
        return rows
    texts = rows.column("text").to_pylist()
    for i in touched:
        texts[i] = cut_words(texts[i], [(x["first"], x["end"]) for x in spans[i]])
    new = {"text": pa.array(texts, rows.schema.field("text").type)}
    if "n_chars" in names:
        chars = rows.column("n_chars").to_pylist()
        for i in touched:
            chars[i] = len(texts[i])
        new["n_chars"] = pa.array(chars, rows.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in names], names=names)


def remove_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every removal span cut from its text; ``n_chars`` follows.
    All other columns stay, whatever their names."""
    names = [c if c in ("text", "n_chars") else f"__{i}" for i, c in enumerate(docs.columns)]
    return occurrences(docs.toDF(*names), benchmark, cut=True).toDF(*docs.columns)
