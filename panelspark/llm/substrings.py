"""Removal of byte strings that an earlier document holds, over a sampled suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id. Induced sorting sorts a sample of the suffixes
and derives the others from it; the sample here is by content: in every window
of ``LENGTH`` bytes the place whose next ``GRAM`` bytes hash lowest, the leftmost
of equals. Equal windows have their sample place at the same offset, so all
equal strings meet at equal sampled suffixes, and it is exact.

1. The tasks list the sampled suffixes by the hash of their first ``GRAM``
   bytes; a shuffle by hash range tells which stand in several documents.
2. Around each such place, the windows that have it as their sample are taken
   in groups of ``GROUP`` neighbours. What is common to a group's windows is
   hashed as its key; the few bytes before and behind, in which they differ,
   go along. The shuffle sorts by key, on disk where it must, so that equal
   prefixes stand together, and the bytes behind and before extend the common
   part window by window: each window gets the smallest doc_id that holds it.
3. The windows found are joined to their documents, marked, and cut.

Equal groups of a task are one row for the smallest doc_id; for the others the
answer is known there and then and goes to a part by their doc_id, so a string
that is in a third of all documents loads no task. The keys of step 1 that go
to all tasks are at most ``ROUND_KEYS``; more keys take more rounds.

Defined cases: a null or empty text has no bytes; rows with a null doc_id
neither lose bytes nor cause a loss; rows with the same doc_id do not cause
losses to each other, and each loses its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import mixed, pieces, prefix_sums, range_hashes, saved, text_bytes

LENGTH = 50
GRAM = 20
GROUP = 9
EDGE = GROUP - 1
ROUND_KEYS = 6_000_000
#: Text bytes of one kernel call: its arrays take about 65 bytes for each of them, and smaller ones stay in the cache.
CALL_BYTES = 1 << 18
_KEY_BYTES = 5
_HELD_ROWS = 1 << 20


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside rows, their rows, their sampled places, the
    64-bit hashes of the places' grams, and the prefix sums of ``data``."""
    none = np.zeros(0, np.int64)
    count = len(data) - LENGTH + 1
    if count <= 0:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    sums = prefix_sums(data)
    places = np.arange(len(data) - GRAM + 1)
    grams = range_hashes(sums, places, places + GRAM)
    bits = np.uint64(len(data).bit_length())
    low = (grams >> bits << bits) | places.astype(np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:count], low[width - span : width - span + count])
    sizes = np.diff(offsets)
    fits = np.repeat(offsets[1:], sizes)[:count] - np.arange(count) >= LENGTH
    starts = np.flatnonzero(fits)
    place = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)[starts]
    return starts, row, place, grams[place], sums


def _shards(docs: DataFrame) -> int:
    """Bits of the hash ranges of step 1: about 2**25 bytes of text to a range, 256 ranges at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, (total >> 25).bit_length())


def shared_keys(docs: DataFrame, bits: int) -> DataFrame:
    """``shard, keys, n``: the keys (bytes below the shard bits, sorted) of sampled
    suffixes that stand in several documents (``doc_id, text``)."""
    shift = np.uint64(64 - bits - 8 * _KEY_BYTES)

    def blobs(alone: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        out = []
        for keys, flag in ((alone, False), (many, True)):
            shard = (keys >> np.uint64(8 * _KEY_BYTES)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])[: len(keys)]
            raw = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES])
            out += [(int(shard[a]), raw[a:b].tobytes(), flag) for a, b in zip(cut, np.r_[cut[1:], len(keys)][: len(cut)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.bool_()))], names=["shard", "keys", "many"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch, limit=CALL_BYTES):
                _, row, place, grams, _ = sampled(*text_bytes(part.column("text")))
                new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])[: len(place)]
                doc = part.column("doc_id").to_numpy()[row[new]]
                held.append((grams[new] >> shift, doc))
                n += len(new)
                if n > _HELD_ROWS:
                    yield blobs(*summed(held))
                    held, n = [], 0
        if n:
            yield blobs(*summed(held))

    def summed(held: list) -> tuple[np.ndarray, np.ndarray]:
        keys, doc = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.lexsort((doc, keys))
        keys, doc = keys[order], doc[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        last = np.r_[first[1:], len(keys)] - 1
        many = doc[first] != doc[last]
        return keys[first[~many]], keys[first[many]]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> pa.RecordBatch:
            keys = np.zeros((sum(len(k) for k, _ in held) // _KEY_BYTES, 8), np.uint8)
            keys[:, :_KEY_BYTES] = np.frombuffer(b"".join(k for k, _ in held), np.uint8).reshape(-1, _KEY_BYTES)
            weight = np.concatenate([np.full(len(k) // _KEY_BYTES, 1 + m, np.int64) for k, m in held])
            keys = keys.view(np.uint64)[:, 0]
            order = np.argsort(keys, kind="stable")
            keys, weight = keys[order], weight[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys = keys[first[np.add.reduceat(weight, first) > 1]]
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([keys.view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].tobytes()], pa.binary()), pa.array([len(keys)])], names=["shard", "keys", "n"])

        for batch in batches:
            for s, k, m in zip(batch.column("shard").to_pylist(), batch.column("keys").to_pylist(), batch.column("many").to_pylist(), strict=True):
                if s != shard and held:
                    yield done()
                    held = []
                shard = s
                held.append((k, m))
        if held:
            yield done()

    seen = docs.select("doc_id", "text").mapInArrow(collect, "shard long, keys binary, many boolean")
    return seen.repartition("shard").sortWithinPartitions("shard").mapInArrow(decide, "shard long, keys binary, n long").where("n > 0")


def _rounds(keys: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of shards with about ``most`` keys each."""
    sizes = sorted(tuple(r) for r in keys.select("shard", "n").collect())  # a row per shard
    out, held, begun = [], 0, None
    for shard, n in sizes:
        if held and held + n > most:
            out.append((begun, shard))
            held, begun = 0, None
        begun = shard if begun is None else begun
        held += n
    return [*out, (begun, sizes[-1][0] + 1)] if sizes else []


def _load(keys: DataFrame, lo: int, hi: int) -> np.ndarray:
    """The sorted keys of the shards lo to hi - 1, with their shard bits."""
    rows = keys.where((F.col("shard") >= lo) & (F.col("shard") < hi)).toArrow().to_pylist()
    parts = []
    for r in sorted(rows, key=lambda r: r["shard"]):
        raw = np.zeros((r["n"], 8), np.uint8)
        raw[:, :_KEY_BYTES] = np.frombuffer(r["keys"], np.uint8).reshape(-1, _KEY_BYTES)
        parts.append(raw.view(np.uint64)[:, 0] | np.uint64(r["shard"] << (8 * _KEY_BYTES)))
    return np.concatenate(parts)


class KeySet:
    """Membership in sorted keys, by a directory over their leading bits."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.shift = keys, np.uint64(max(0, 8 * _KEY_BYTES + bits - 20))
        self.begin = np.searchsorted(keys >> self.shift, np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int64)

    def has(self, wanted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(wanted), bool)
        head = (wanted >> self.shift).astype(np.int64)
        lo, hi = self.begin[head], self.begin[head + 1]
        left = np.flatnonzero(lo < hi)
        lo, hi = lo[left], hi[left]
        while len(left):
            mid = (lo + hi) >> 1
            key, want = self.keys[mid], wanted[left]
            out[left[key == want]] = True
            lo, hi = np.where(key < want, mid + 1, lo), np.where(key < want, hi, mid)
            on = (lo < hi) & (key != want)
            left, lo, hi = left[on], lo[on], hi[on]
        return out


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number (any byte where there is none)."""
    index = np.clip(at[:, None] + np.arange(EDGE), 0, len(data) - 1)
    return np.ascontiguousarray(data[index]).view(">u8")[:, 0].astype(np.uint64)


def _low_bytes(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n >= 8, x, x & ((np.uint64(1) << (np.minimum(n, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)))


def _high_bytes(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``x`` with its first n bytes kept."""
    return x ^ _low_bytes(x, 8 - n)


def window_groups(data: np.ndarray, offsets: np.ndarray, wanted, shift: np.uint64) -> tuple[np.ndarray, ...]:  # noqa: ANN001
    """Groups of neighbouring windows at wanted sample places: row, base (start of
    the group's window 0), first and last window there, key, bytes before, bytes behind."""
    starts, row, place, grams, sums = sampled(data, offsets)
    new = np.r_[True, place[1:] != place[:-1]][: len(place)]
    at = np.flatnonzero(new)
    use = wanted(grams[at] >> shift)[np.cumsum(new) - 1] if len(at) else np.zeros(0, bool)
    starts, row, place, grams = starts[use], row[use], place[use], grams[use]
    back = place - starts
    number = back // GROUP
    base = place - number * GROUP - EDGE
    window = starts - base
    # a group is a run: windows of one place and number follow each other
    first = np.flatnonzero(np.r_[True, (base[1:] != base[:-1]) | (place[1:] != place[:-1]) | (row[1:] != row[:-1])][: len(base)])
    last = np.r_[first[1:], len(base)] - 1
    base, lo, hi, number = base[first], window[first], window[last[: len(first)]], number[first]
    key = mixed(range_hashes(sums, base + EDGE, base + LENGTH) + number.astype(np.uint64))
    before = _low_bytes(_eight(data, base), EDGE - lo) if len(base) else np.zeros(0, np.uint64)
    behind = _high_bytes(_eight(data, base + LENGTH), hi) if len(base) else np.zeros(0, np.uint64)
    return row[first], base, lo, hi, key, before, behind


_COLUMNS = ("key", "before", "behind", "doc_id", "code", "known")
_ROWS = "key long, before long, behind long, doc_id long, code long, known boolean"


def _codes(base: np.ndarray, bits: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Base, windows (a bit each) and text tag in one number."""
    return (((base + 64) << GROUP | bits) << 16) | tag


def _merge_equal(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Equal groups of one task: those of the smallest doc_id stay open; of the
    others it is known that all their windows go, and they travel by doc_id."""
    key, before, behind, doc, code = columns
    bits = (code >> 16) & ((1 << GROUP) - 1)
    h = mixed(mixed(mixed(key + before) + behind) + bits.astype(np.uint64))
    order = np.lexsort((doc, h))
    h, d = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    low = np.repeat(d[first], np.diff(np.r_[first, len(h)]))
    known = np.zeros(len(h), bool)
    known[order] = d > low
    key = np.where(known, mixed(doc.astype(np.uint64)), key)
    zero = np.uint64(0)
    return [key, np.where(known, zero, before), np.where(known, zero, behind), doc, code, known]


def _resolve(key: np.ndarray, before: np.ndarray, behind: np.ndarray, doc: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of each group the windows that a smaller doc_id holds, as bits."""
    out = np.zeros(len(key), np.int64)
    for j in range(GROUP):
        on = np.flatnonzero(bits >> j & 1)
        if not len(on):
            continue
        n = np.full(len(on), j)
        h = mixed(mixed(key[on] + _low_bytes(before[on], EDGE - n) * np.uint64(0xD1342543DE82EF95)) + _high_bytes(behind[on], n))
        order = np.argsort(h, kind="stable")
        h, d = h[order], doc[on[order]]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        low = np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(h)]))
        out[on[order[d > low]]] |= 1 << j
    return out


def removed_windows(docs: DataFrame, round_keys: int = ROUND_KEYS) -> DataFrame:
    """``doc_id, code``: groups of windows that go (see ``_codes``)."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null")
    bits = _shards(docs)
    shift = np.uint64(64 - bits - 8 * _KEY_BYTES)
    keys = saved(shared_keys(docs, bits))

    def groups(shared):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, wanted = [], 0, KeySet(shared.value, bits)
            for batch in batches:
                for part in pieces(batch, limit=CALL_BYTES):
                    data, offsets = text_bytes(part.column("text"))
                    row, base, lo, hi, key, before, behind = window_groups(data, offsets, wanted.has, shift)
                    if not len(row):
                        continue
                    windows = (np.int64(1) << (hi + 1)) - (np.int64(1) << lo)
                    tags = {r: zlib.crc32(data[offsets[r] : offsets[r + 1]]) & 0xFFFF for r in np.unique(row).tolist()}
                    tag = np.array([tags[r] for r in row.tolist()], np.int64)
                    held.append([key, before, behind, part.column("doc_id").to_numpy()[row], _codes(base - offsets[row], windows, tag)])
                    n += len(row)
                    if n > _HELD_ROWS:
                        yield table(held)
                        held, n = [], 0
            if held:
                yield table(held)

        return run

    def table(held: list) -> pa.RecordBatch:
        columns = _merge_equal([np.concatenate(c) for c in zip(*held, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=_COLUMNS)

    def answer(t: pa.Table) -> pa.RecordBatch:
        key, before, behind = (t.column(c).to_numpy().view(np.uint64) for c in _COLUMNS[:3])
        doc, code, known = (t.column(c).to_numpy() for c in _COLUMNS[3:])
        windows = (code >> 16) & ((1 << GROUP) - 1)
        open_rows = np.flatnonzero(~known)
        gone = windows.copy()
        gone[open_rows] = _resolve(key[open_rows], before[open_rows], behind[open_rows], doc[open_rows], windows[open_rows])
        code = (code >> (16 + GROUP) << GROUP | gone) << 16 | (code & 0xFFFF)
        on = gone > 0
        return pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(code[on])], names=["doc_id", "code"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole keys of the sorted rows, about 2**17 rows at a time."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 1 << 17:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            k = t.column("key").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[-1])
            if cut:
                yield answer(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield answer(pa.Table.from_batches(held))

    out = []
    for lo, hi in _rounds(keys, round_keys):
        shared = spark.sparkContext.broadcast(_load(keys, lo, hi))
        rows = docs.select("doc_id", "text").mapInArrow(groups(shared), _ROWS)
        out.append(rows.repartition("key").sortWithinPartitions("key").mapInArrow(resolve, "doc_id long, code long"))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], "doc_id long, code long")


def removed_spans(text: bytes, codes: list[int] | None) -> list[tuple[int, int]]:
    """Maximal removed [start, end) byte runs of one text."""
    tag = zlib.crc32(text) & 0xFFFF
    code = np.array([c for c in codes or () if c & 0xFFFF == tag], np.int64)
    if not len(code):
        return []
    bits, base = (code >> 16) & ((1 << GROUP) - 1), (code >> (16 + GROUP)) - 64
    starts = np.unique(np.concatenate([base[bits >> j & 1 == 1] + j for j in range(GROUP)]))
    cut = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + LENGTH])
    return list(zip(starts[cut].tolist(), (starts[np.r_[cut[1:], len(starts)] - 1] + LENGTH).tolist(), strict=True))


def deduplicate(docs: DataFrame, round_keys: int = ROUND_KEYS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` of each row;
    ``kept`` are the remaining bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    codes = saved(removed_windows(docs, round_keys)).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("code").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):  # so that the kept bytes of a whole batch are never held besides it
                out = []
                for text, found in zip(b.column("text"), b.column("codes"), strict=True):
                    data = (text.as_py() or "").encode()
                    spans = removed_spans(data, found.as_py())
                    ends = [0, *(e for _, e in spans)]
                    kept = b"".join(data[a:z] for a, z in zip(ends, [*(s for s, _ in spans), len(data)], strict=True))
                    out.append((len(data), len(data) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = docs.join(codes, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "codes")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
