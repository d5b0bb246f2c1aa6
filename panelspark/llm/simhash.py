"""SimHash near-duplicates, compared in bit slices.

A fingerprint bit is set if it is set in over half of the XXH64 hashes of the
word shingles. Two fingerprints within ``radius`` differing bits agree on at
least ``bands - radius`` of ``bands`` bands of bits, so every such pair meets
in one of the tables keyed by a choice of that many bands: nothing is missed.
In a table, the members of a bucket are compared in slices: the 64 bits of all
rows are stored as 64 planes, 64 rows to a machine word; the planes are laid
over themselves shifted by d rows, the differing bits of all pairs (i, i + d)
are counted together by carry-save adders, and a block of pairs is given up as
soon as each of them is over the radius. A bucket with more than
``chunk`` members is cut into chunks that meet pairwise, so no task's memory
depends on a bucket's size.

Defined cases: a null or empty text, or one of white space, has fingerprint 0
and links like any other; a text of fewer words than a shingle is one shingle;
repeated rows and equal texts share a fingerprint and so a component; a null
doc_id gets a row, but does not name a component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import giving_back, mixed, pieces, saved, shingle_sets
from panelspark.llm.components import Forest, components

BITS = 64
SEED = 42
_STEP_WORDS = 2048


def fingerprint(text: str | None, width: int = 4, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """SimHashes of one text over its ``width``-word shingles, one for each seed."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return [0] * len(seeds)
    n = max(1, len(words) - width + 1)
    totals, digest = np.zeros((len(seeds), BITS), np.int64), xxhash.xxh64_digest
    for at in range(0, n, 4096):
        part = words[at : at + 4096 + width - 1]
        grams = [b" ".join(s) for s in zip(*(part[i : len(part) - width + 1 + i] for i in range(width)), strict=True)] if len(words) > width else [b" ".join(words)]
        for k, seed in enumerate(seeds):
            hashes = b"".join([digest(g, seed) for g in grams])
            totals[k] += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return [int.from_bytes(x.tobytes(), "big") for x in np.packbits(2 * totals > n, axis=1)]


def fingerprints(docs: DataFrame, width: int = 4, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """``doc_id, fp0, fp1, ...`` (a fingerprint per seed, as a signed long) for each row."""
    names = [f"fp{k}" for k in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width, seeds) for t in b.column("text")], np.uint64).view(np.int64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, np.ascontiguousarray(fps.T))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def planes(fps: np.ndarray) -> np.ndarray:
    """The 64 bit planes of ``fps``: row i is bit i % 64 of word i // 64 of each
    plane. Neighbouring planes hold distant bits, so that the bits on which a
    bucket agrees are not all among the first."""
    n = -(-len(fps) // 64) * 64
    rows = np.zeros((n, 8), np.uint8)
    rows[: len(fps)] = fps.astype(">u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(rows, axis=1)[:, np.arange(BITS).reshape(8, 8).T.ravel()].T
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(np.uint64)


def shifted(p: np.ndarray, d: int, words: int) -> np.ndarray:
    """``words`` words of the planes from row d on; ``p`` has enough of them."""
    whole, part = divmod(d, 64)
    a = p[:, whole : whole + words]
    return a if not part else (a >> np.uint64(part)) | (p[:, whole + 1 : whole + 1 + words] << np.uint64(64 - part))


def counters(bits: np.ndarray) -> list[np.ndarray]:
    """Sums over the rows of ``bits`` for each lane, as bit planes of the sums
    from the lowest: carry-save adders turn three planes into a sum and a carry."""
    out, level = [], bits
    while len(level):
        carries = []
        while len(level) > 1:
            k = len(level) // 3
            if k:
                a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
                u = a ^ b
                carries.append((a & b) | (u & c))
                level = np.concatenate([u ^ c, level[3 * k :]])
            else:
                carries.append(level[:1] & level[1:])
                level = level[:1] ^ level[1:]
        out.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    return out


def at_most(sums: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose sum is at most ``radius``."""
    less, equal = np.zeros_like(sums[0]), ~np.zeros_like(sums[0])
    for b in range(len(sums) - 1, -1, -1):
        if radius >> b & 1:
            less = less | (equal & ~sums[b])
            equal = equal & sums[b]
        else:
            equal = equal & ~sums[b]
    return less | equal


def first_planes(radius: int) -> int:
    """Planes after which few lanes of unlike rows are within ``radius``."""
    return min(BITS, 12 + 3 * radius)


def close_lanes(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray | None:
    """Lanes in which the planes ``a`` and ``b`` differ in ``radius`` bits at
    most; None as soon as there are none."""
    found = at_most(counters(a ^ b), radius)
    return found if found.any() else None


def linked_pairs(fps: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within ``radius``. Rows of one ``bucket`` stand together,
    larger buckets first; rows with side 1 are compared with those of side 2
    only, rows of side 0 with all. With a ``forest``, buckets all of whose rows
    are of one class by now are left out from then on."""
    rows, d, few = np.arange(len(fps)), 1, first_planes(radius)
    while True:
        b = bucket[rows]
        new = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])[: len(b)]
        sizes = np.diff(np.r_[new, len(b)])
        last = np.repeat(new + sizes, sizes)  # the end of each row's bucket
        ends = np.cumsum(sizes)
        p = planes(fps[rows])
        p = np.pad(p, ((0, 0), (0, 2 + int(sizes[0]) // 64 if len(sizes) else 0)))
        while len(sizes) and d < sizes[0]:
            live = int(ends[np.searchsorted(-sizes, -d, side="left") - 1])
            words = -(-live // 64)
            # many shifts of few words are one step
            shifts = np.arange(d, min(d + max(1, min(d, _STEP_WORDS // words)), sizes[0]))
            moved = np.stack([shifted(p[:few], int(x), words) for x in shifts], axis=1)
            hit = close_lanes(np.repeat(p[:few, None, :words], len(shifts), axis=1).reshape(few, -1), moved.reshape(few, -1), radius)
            if hit is not None:  # blocks of 64 lanes that are not given up: all planes
                blocks = np.flatnonzero(hit)
                at, d_of = blocks % words, shifts[blocks // words]
                whole, part = at + d_of // 64, (d_of % 64).astype(np.uint64)
                high = np.where(part > 0, p[:, whole + 1] << (np.uint64(64) - np.maximum(part, np.uint64(1))), np.uint64(0))
                found = close_lanes(p[:, at], (p[:, whole] >> part) | high, radius)
                hit = np.zeros_like(hit)
                hit[blocks] = 0 if found is None else found
            if hit is not None:
                by_shift = hit.reshape(len(shifts), words)
                for k in np.flatnonzero(by_shift.any(1)):
                    i = np.flatnonzero(np.unpackbits(by_shift[k].view(np.uint8), bitorder="little"))
                    i = i[i < live]
                    i = i[i + shifts[k] < last[i]]
                    one, other = rows[i], rows[i + shifts[k]]
                    on = (side[one] == 0) | (side[one] != side[other])
                    if on.any():
                        yield one[on], other[on]
            before, d = d, int(shifts[-1]) + 1
            if forest is not None and d.bit_length() > before.bit_length():
                label = forest.label[rows]
                more = np.minimum.reduceat(label, new) != np.maximum.reduceat(label, new)
                if sizes[more].sum() < 0.7 * len(rows):
                    rows = rows[np.repeat(more, sizes)]
                    break
        else:
            return


def _bands(bands: int) -> list[tuple[int, int]]:
    """(shift, width) of each band of bits, as even as can be."""
    cuts = [round(BITS * i / bands) for i in range(bands + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def bands_for(distinct: int, radius: int) -> int:
    """Bands so that a bucket holds some 64 of evenly spread fingerprints at most, within three more than the radius."""
    bands = radius + 2
    while BITS * (bands - radius) / bands < min(distinct, 1 << 36).bit_length() - 6 and bands < radius + 3:
        bands += 1
    return bands


def _whole_buckets(compare: Callable[[pa.Table], pa.RecordBatch], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``compare`` on whole buckets of the sorted rows, about ``rows`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < rows:
                continue
            t = pa.Table.from_batches(held)
            keys = t.column("bucket").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
            if cut:
                yield compare(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def _by_bucket(bucket: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The order of rows by bucket, larger ones first, then node."""
    _, inverse, counts = np.unique(bucket, return_inverse=True, return_counts=True)
    return np.lexsort((node, inverse, -counts[inverse]))


def links(nodes: DataFrame, radius: int = 4, bands: int | None = None, chunk: int = 4096) -> DataFrame:
    """``u, v``: edges between the ``node`` of fingerprints ``fp`` within
    ``radius`` that connect all that any chain of close pairs connects; ``v`` is
    the smallest node of what a task finds connected. ``nodes`` has each
    fingerprint once."""
    bands = bands or bands_for(nodes.count(), radius)
    keys = []
    for number, chosen in enumerate(combinations(_bands(bands), bands - radius)):
        parts = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1)) for lo, width in chosen]
        keys.append(F.xxhash64(F.lit(number), *parts))
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("bucket"))
    full = saved(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = rows.join(full, "bucket").withColumn("cuts", F.ceil(F.col("n") / chunk).cast("int"))

    def compare(batch: pa.Table) -> pa.RecordBatch:
        node, fp, bucket, side = (batch.column(c).to_numpy() for c in ("node", "fp", "bucket", "side"))
        order = _by_bucket(bucket, node)
        node, fp, bucket, side = node[order], fp[order], bucket[order], side[order]
        forest = Forest(len(node))
        for i, j in linked_pairs(fp.view(np.uint64), bucket, side, radius, forest):
            forest.join(i, j)
        on = np.flatnonzero(forest.label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[forest.label[on]])], names=["u", "v"])

    return _met(rows, ["node", "fp"]).mapInArrow(_whole_buckets(compare, 4 * chunk), "u long, v long")


def _met(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``rows`` (``bucket``, ``cuts``) by bucket: the chunks of a bucket that is
    cut meet pairwise, each pair as a bucket of its own."""
    # a chunk meets itself, and every other chunk of its bucket once
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", "node"), F.col("cuts")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least("own", j).alias("a"), F.greatest("own", j).alias("b")))
    rows = rows.withColumn("m", F.explode(meet))
    number = F.when(F.col("m.a") == F.col("m.b"), 0).when(F.col("own") == F.col("m.a"), 1).otherwise(2).cast("byte")
    bucket = F.when(F.col("cuts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", "m.a", "m.b"))
    rows = rows.select(*kept, bucket.alias("bucket"), number.alias("side"))
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``."""
    fps = saved(fingerprints(docs, width).withColumnRenamed("fp0", "fp"))
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes.where("node is not null"), radius)).withColumnRenamed("node", "member")
    classes = saved(nodes.join(found, F.col("node") == F.col("member"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "node").alias("component_id")))
    return fps.join(classes, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies of texts: candidates by fingerprints, decided by their shingles.

#: A pair at a similarity of 0.8 differs in 9.7 of 64 bits on average, so that one
#: fingerprint finds about two of five such pairs within 8 bits, and eight nearly all.
SEEDS = 8
_SALTS = [mixed(np.array([k + 1], np.uint64)) for k in range(64)]
#: Ids that go to all tasks in a join with texts; more are joined by shuffles.
BROADCAST_IDS = 1_000_000
#: Tables of candidates that are on disk at once: more bands make more tables of
#: each node (9, 45 or 165 for a fingerprint), these are filled and read in passes.
PASS_TABLES = 72
#: Rows in these tables that one task makes.
TASK_ROWS = 1_000_000


def set_fingerprints(row: np.ndarray, hashes: np.ndarray, rows: int, seeds: int) -> np.ndarray:
    """SimHashes of each row's set of hashes, one for each of ``seeds``."""
    out = np.zeros((rows, seeds), np.uint64)
    if not len(row):
        return out
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[first, len(row)])
    place = np.arange(len(row)) - np.repeat(first, sizes)
    parts = np.flatnonzero(place % 255 == 0)  # sums of bits that fit a byte
    sums = np.zeros((seeds, len(parts), BITS // 8), np.uint64)  # eight of them to a word
    for lo in range(0, len(parts), 512):
        at = parts[lo : lo + 512]
        x = hashes[at[0] : parts[lo + 512] if lo + 512 < len(parts) else len(row)]
        for k in range(seeds):
            bits = np.unpackbits(mixed(x + _SALTS[k]).view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
            sums[k, lo : lo + len(at)] = np.add.reduceat(bits, at - at[0], axis=0)
    begin = np.searchsorted(parts, first)
    for k in range(seeds):
        totals = np.add.reduceat(sums[k].view(np.uint8).astype(np.int32), begin, axis=0)
        out[row[first], k] = np.packbits(2 * totals > sizes[:, None], axis=1).view(np.uint64)[:, 0]
    return out


def word_digests(column: pa.Array) -> np.ndarray:
    """The two halves of the XXH128 of the words of each text."""
    import xxhash

    digests = b"".join([xxhash.xxh3_128_digest(b" ".join((t.as_py() or "").encode().lower().split())) for t in column])
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def signatures(docs: DataFrame, width: int, seeds: int) -> DataFrame:
    """``doc_id, node, more, size, fp0, ...`` of each row: digest of the words (in
    two halves), number of distinct shingles, and their fingerprints."""
    names = ["doc_id", "node", "more", "size", *(f"fp{k}" for k in range(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                row, hashes = shingle_sets(b.column("text"), width)
                fps = set_fingerprints(row, hashes, b.num_rows, seeds).view(np.int64)
                columns = [*word_digests(b.column("text")).T, np.bincount(row, minlength=b.num_rows), *fps.T]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(run), ", ".join(f"{n} long" for n in names))


def shingles(docs: DataFrame, width: int) -> DataFrame:
    """``node``, ``grams``: digest and distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                row, hashes = shingle_sets(b.column("text"), width)
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32)
                node = np.ascontiguousarray(word_digests(b.column("text"))[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], names=["node", "grams"])

    return docs.select("text").mapInArrow(giving_back(run), "node long, grams array<long>")


def _size_class(size: np.ndarray) -> np.ndarray:
    """Sets of a similarity of 0.8 or more are in one class or in neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(1.25) + 1e-9).astype(np.int64)


def candidates(nodes: DataFrame, seeds: int, radius: int, bands: int | None = None, chunk: int = 4096) -> DataFrame:
    """``u, v``: pairs of ``nodes`` (``node, label, size, fp0, ...``) of different
    labels that are within ``radius`` in one of the first ``seeds`` fingerprints,
    and whose sizes allow a similarity of 0.8. Not all of them come out, but as
    many as connect the same labels.

    Each node stands in the tables of its size class and as a visitor in those
    of the next one; visitors do not meet each other. At most ``PASS_TABLES`` of
    the tables are filled at a time, so a node has a bounded number of rows in a
    shuffle, whatever the number of bands."""
    fps = [f"fp{k}" for k in range(seeds)]
    size_class = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(1.25)).alias("class")
    most, total = (x or 0 for x in nodes.groupBy(size_class).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first())
    if not bands:
        bands = radius + 1
        while 2 * most > 512 << (BITS * (bands - radius) // bands) and bands < radius + 3:
            bands += 1
    tables = [[(lo, (1 << width) - 1) for lo, width in chosen] for chosen in combinations(_bands(bands), bands - radius)]
    filled = [(k, number) for k in range(seeds) for number in range(len(tables))]
    passes = np.array_split(np.array(filled), -(-len(filled) // PASS_TABLES))

    def keys(b: pa.RecordBatch, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Fingerprint, bucket and side for each table of ``some`` that the nodes stand in."""
        own = _size_class(b.column("size").to_numpy()).astype(np.uint64)
        for k, number in some.tolist():
            fp = b.column(fps[k]).to_numpy().view(np.uint64)
            part = np.full(len(fp), number * seeds + k + 1, np.uint64)
            for lo, mask in tables[number]:
                part = mixed(part) + ((fp >> np.uint64(lo)) & np.uint64(mask))
            for side in (0, 1):
                yield fp, mixed(mixed(part) + own + np.uint64(side)), side

    def dealt(some: np.ndarray) -> DataFrame:
        return compact.repartition(1 + total * 2 * len(some) // TASK_ROWS, "node")

    def counted(some: np.ndarray) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bucket, n = np.unique(np.concatenate([x for _, x, _ in keys(b, some)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(n)], names=["bucket", "n"])

        return dealt(some).mapInArrow(giving_back(count), "bucket long, n long")

    def expanded(some: np.ndarray) -> DataFrame:
        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                    found = list(keys(b, some))
                    fp, bucket = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
                    side = np.repeat(np.array([x[2] for x in found], np.int8), b.num_rows)
                    node, label = (np.tile(b.column(c).to_numpy(), len(found)) for c in ("node", "label"))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, label, fp, bucket, side)], names=["node", "label", "fp", "bucket", "visits"])

        return dealt(some).mapInArrow(giving_back(expand), "node long, label long, fp long, bucket long, visits byte")

    def compare(t: pa.Table) -> pa.RecordBatch:
        node, label, fp, bucket, side, visits = (t.column(c).to_numpy() for c in ("node", "label", "fp", "bucket", "side", "visits"))
        order = _by_bucket(bucket, node)
        node, label, fp, bucket, side, visits = (x[order] for x in (node, label, fp, bucket, side, visits))
        forest, u, v = Forest(len(node)), [node[:0]], [node[:0]]
        _, first, inverse = np.unique(mixed(bucket.view(np.uint64)) + label.view(np.uint64), return_index=True, return_inverse=True)
        forest.label = first[inverse]
        for i, j in linked_pairs(fp.view(np.uint64), bucket, side, radius, forest):
            on = (forest.label[i] != forest.label[j]) & ~((visits[i] == 1) & (visits[j] == 1))
            i, j = i[on], j[on]
            u.append(np.minimum(node[i], node[j]))
            v.append(np.maximum(node[i], node[j]))
            forest.join(i, j)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], names=["u", "v"])

    def met(some: np.ndarray) -> DataFrame:
        large = counted(some).groupBy("bucket").agg(F.sum("n").alias("n"))
        large = saved(large.where(F.col("n") > chunk).select(F.col("bucket").alias("of"), F.ceil(F.col("n") / chunk).cast("int").alias("of_cuts")))
        rows = expanded(some).join(large, F.col("bucket") == F.col("of"), "left").withColumn("cuts", F.coalesce("of_cuts", F.lit(1)))
        return _met(rows, ["node", "label", "fp", "visits"]).mapInArrow(giving_back(_whole_buckets(compare, 16 * chunk)), "u long, v long").distinct()

    compact = nodes.select("node", "label", "size", *fps)
    if len(passes) == 1:
        return met(passes[0])
    return reduce(DataFrame.unionAll, [saved(met(some)) for some in passes]).distinct()


def _within(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of texts by ``doc_id`` with a saved table ``id``."""
    ids = ids.select(F.col("id").alias("__id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, docs["doc_id"].cast("long") == F.col("__id"), how)


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int = 5, tenths: int = 8) -> DataFrame:
    """Those of ``pairs`` (``u, v``) whose texts in ``docs`` have an exact Jaccard
    similarity of shingles of at least ``tenths`` / 10. ``nodes`` (``node, doc_id``)
    has a document for each text."""
    ends = pairs.select(F.col("u").alias("end")).unionAll(pairs.select(F.col("v").alias("end"))).distinct()
    wanted = saved(nodes.join(ends, F.col("node") == F.col("end"), "left_semi").select(F.col("doc_id").alias("id")))
    sets = saved(shingles(_within(docs, wanted, "left_semi"), width))
    one, two = (sets.select(F.col("node").alias(f"node_{x}"), F.col("grams").alias(x)).hint("merge") for x in "ab")
    both = pairs.join(one, F.col("u") == F.col("node_a")).join(two, F.col("v") == F.col("node_b"))
    met = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("total"))
    return met.where(10 * F.col("common") >= tenths * (F.col("total") - F.col("common"))).select("u", "v")


def _labelled(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """``u, v`` of ``pairs`` of different classes, with the classes ``a, b``."""
    for end, name in (("u", "a"), ("v", "b")):
        of = linked.select(F.col("node").alias(f"of_{name}"), F.col("component").alias(f"class_{name}"))
        pairs = pairs.join(of, F.col(end) == F.col(f"of_{name}"), "left").withColumn(name, F.coalesce(f"class_{name}", end))
    return pairs.where("a <> b").select("u", "v", "a", "b")


def in_groups(members: DataFrame, seeds: int, radius: int, tenths: int = 8, rows: int = 512, grams: int = 1 << 17) -> DataFrame:
    """``u, v``: links that connect what any chain of links connects among the
    ``members`` (``node, label, group, size, fp0, ..., grams``) of each group.

    A group is cut into chunks that meet pairwise, each of ``rows`` texts and
    about ``grams`` shingles. A task compares the fingerprints of two chunks in
    bit slices, decides the pairs of different labels by their shingles on the
    spot, and gives only links: no pair of a large group leaves the task for
    being a candidate."""
    fps = [f"fp{k}" for k in range(seeds)]

    def compare(t: pa.Table) -> pa.RecordBatch:
        node, label, size, bucket, side = (t.column(c).to_numpy() for c in ("node", "label", "size", "bucket", "side"))
        order = _by_bucket(bucket, node)
        node, label, size, bucket, side = (x[order] for x in (node, label, size, bucket, side))
        sets = t.column("grams").combine_chunks()
        ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        own = [values[ends[i] : ends[i + 1]] for i in order.tolist()]
        forest, u, v = Forest(len(node)), [node[:0]], [node[:0]]
        _, first, inverse = np.unique(mixed(bucket.view(np.uint64)) + label.view(np.uint64), return_index=True, return_inverse=True)
        forest.label = first[inverse]
        for name in fps:
            fp = t.column(name).to_numpy().view(np.uint64)[order]
            for i, j in linked_pairs(fp, bucket, side, radius, forest):
                on = (forest.label[i] != forest.label[j]) & (10 * np.minimum(size[i], size[j]) >= tenths * np.maximum(size[i], size[j]))
                i, j = i[on], j[on]
                for a in np.unique(i):
                    other = j[i == a]
                    other = other[forest.label[other] != forest.label[a]]
                    if not len(other):
                        continue
                    counts = size[other]
                    found = np.isin(np.concatenate([own[x] for x in other]), own[a], assume_unique=False)
                    common = np.add.reduceat(found.astype(np.int64), np.cumsum(counts) - counts)
                    linked = other[10 * common >= tenths * (counts + size[a] - common)]
                    u.append(np.full(len(linked), node[a]))
                    v.append(node[linked])
                    forest.join(np.full(len(linked), a), linked)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], names=["u", "v"])

    sizes = members.groupBy(F.col("group").alias("of")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("size") / grams)).cast("int").alias("cuts"))
    placed = members.join(saved(sizes), F.col("group") == F.col("of")).withColumns({"bucket": F.col("group"), "fp": F.col("fp0")})
    return _met(placed, ["node", "label", "size", *fps, "grams"]).mapInArrow(giving_back(_whole_buckets(compare, 2 * rows)), "u long, v long").distinct()


def near_copies(docs: DataFrame, nodes: DataFrame, width: int = 5, radius: int = 8, seeds: int = SEEDS) -> DataFrame:
    """``node, component`` for all of ``nodes`` (``node, doc_id, size, fp0, ...``)
    that are linked. Two texts are linked if the fingerprints of any seed are
    within ``radius`` and the exact similarity of their shingles is at least 0.8.

    1. Candidates of one fingerprint that connect what is close are verified,
       so that the members of large groups are of one class from then on.
    2. Candidates of all fingerprints that connect what is close but not yet of
       one class are verified.
    3. Where a candidate failed, those that it connected may still be linked to
       each other: the groups that the candidates form are searched whole.
    """
    names = ["node", "size", *(f"fp{k}" for k in range(seeds))]
    active, good, tried = nodes.withColumn("label", F.col("node")), None, None
    for used in (1, seeds):
        found = candidates(active, used, radius)
        found = saved(found if tried is None else found.join(tried, ["u", "v"], "left_anti"))
        new = similar(found, docs, nodes, width)
        good = saved(new if good is None else good.unionAll(new))
        tried = found if tried is None else tried.unionAll(found)
        linked = saved(components(good))
        label = linked.select(F.col("node").alias("member"), "component")
        active = saved(nodes.join(label, F.col("node") == F.col("member"), "left").withColumn("label", F.coalesce("component", "node")).drop("member", "component"))
    failed = saved(_labelled(tried, linked))
    if not failed.count():
        return linked
    groups = saved(components(tried).select(F.col("node").alias("member"), F.col("component").alias("group")))
    still = groups.join(failed, F.col("member") == F.col("u"), "left_semi").select(F.col("group").alias("open")).distinct()
    members = groups.join(still, F.col("group") == F.col("open"), "left_semi")
    members = saved(active.join(members, F.col("node") == F.col("member")).select(*names, "label", "group", "doc_id"))
    sets = shingles(_within(docs, saved(members.select(F.col("doc_id").alias("id"))), "left_semi"), width).withColumnRenamed("node", "of_node")
    members = members.join(sets.dropDuplicates(["of_node"]).hint("merge"), F.col("node") == F.col("of_node")).select(*names, "label", "group", "grams")
    return saved(components(good.unionAll(saved(in_groups(members, seeds, radius)))))


def keep_first(docs: DataFrame, width: int = 5, radius: int = 8, seeds: int = SEEDS) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest
    doc_id. Texts of the same words are one text; others are linked by
    :func:`near_copies`.

    Rows with a null doc_id stay. Of rows that repeat a doc_id and a text, one
    stays; rows of one doc_id with different texts are documents of their own.
    """
    rows = saved(signatures(docs.where("doc_id is not null"), width, seeds))
    fps = [f"fp{k}" for k in range(seeds)]
    first = rows.groupBy("node", "more").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("size", *fps)))
    nodes = saved(first)
    linked = near_copies(docs, nodes.where("size > 0"), width, radius, seeds).select(F.col("node").alias("member"), "component")
    known = saved(nodes.select("node", "more", "doc_id").join(linked, F.col("node") == F.col("member"), "left").withColumn("class", F.coalesce("component", "node")))
    best = known.groupBy("class").agg(F.min(F.struct("doc_id", "node", "more")).alias("best")).select("best.doc_id", "best.node", "best.more")
    best = saved(best.select(F.col("doc_id").alias("best_id"), F.col("node").alias("best_node"), F.col("more").alias("best_more")))
    is_best = (F.col("doc_id") == F.col("best_id")) & (F.col("node") == F.col("best_node")) & (F.col("more") == F.col("best_more"))
    repeated = saved(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id")))
    gone = rows.join(best, is_best, "left_anti").select(F.col("doc_id").alias("id")).unionAll(repeated).distinct()
    out = _within(docs, saved(gone), "left_anti")
    if repeated.count():
        again = with_digests(_within(docs, repeated, "left_semi")).dropDuplicates(["__doc", "__node", "__more"])
        same = (F.col("__doc") == F.col("best_id")) & (F.col("__node") == F.col("best_node")) & (F.col("__more") == F.col("best_more"))
        out = out.unionAll(again.join(best, same, "left_semi").select(docs.columns))
    return out


def with_digests(docs: DataFrame) -> DataFrame:
    """``docs`` with the digests of their words (``__node, __more``) and ``__doc``, the id as a number."""
    docs = docs.withColumn("__doc", F.col("doc_id").cast("long"))
    schema = docs.withColumns({"__node": F.lit(0).cast("long"), "__more": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halves = word_digests(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(h)) for h in halves.T)], names=[*b.schema.names, "__node", "__more"])

    return docs.mapInArrow(run, schema)
