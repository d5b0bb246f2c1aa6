"""What the corpus operators share: tables, cuts of lineage and byte-level text kernels.

The kernels run inside ``mapInArrow`` tasks: they take the byte buffer of an
Arrow string column and work on all words of a few documents at once.
"""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from panelspark.sources.shared import discard, saved, shared_dir, tidy

#: Text bytes that one kernel call handles (a longer document is one call of its own).
PIECE_BYTES = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_shipped: set[str] = set()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application
    (as ``--py-files`` does): tasks import it by name."""
    import panelspark

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(panelspark.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "panelspark.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes in ``column`` (one row at least, ``rows`` at most)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + limit, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and the n + 1 offsets of the rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word. ``inside`` marks the bytes of words;
    without it, words are parted by ASCII white space."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    if inside is None:
        inside = ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every bit of ``h`` over the word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`range_hashes` gets the hash of any byte range."""
    up, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: equal ranges hash alike wherever they stand."""
    _, down = _power_tables(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 52-bit hash of the distinct ``width``-word shingles of at most 4096
    rows, by row, then hash. A text of fewer words is one shingle; only A-Z change
    case, only ASCII white space parts words."""
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, row = word_bounds(data, offsets)
    words = range_hashes(prefix_sums(data), starts, ends)
    at = np.arange(len(words))
    end = np.cumsum(np.bincount(row, minlength=len(column)))[row] if len(words) else at
    h = words * _BASE
    for j in range(1, min(width, len(words))):
        h[:-j] += np.where(at[j:] < end[:-j], words[j:], np.uint64(0)) * _up(j + 1)
    first = np.r_[True, row[1:] != row[:-1]][: len(row)]
    use = (end - at >= width) | first
    keys = np.sort((row[use].astype(np.uint64) << np.uint64(52)) | (mixed(h[use]) >> np.uint64(12)))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]
    return (keys >> np.uint64(52)).astype(np.int64), keys & np.uint64((1 << 52) - 1)


def _up(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``. At its end the worker, which Spark keeps for
    other tasks, gives the memory that it has freed back to the machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped


class HashIndex:
    """Places of 64-bit keys: a directory over the keys' leading bits, then the sorted keys."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self._put(keys[order], order)

    def __getstate__(self) -> tuple:
        """What the keys do not give again: all machines keep it on their disks."""
        return self.keys, self.order

    def __setstate__(self, state: tuple) -> None:
        self._put(*state)

    def _put(self, keys: np.ndarray, order: np.ndarray | None) -> None:
        self.keys, self.order = keys, None if order is None or (order == np.arange(len(order))).all() else order
        self.bits = max(4, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - self.bits)
        heads = (self.keys >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(heads, np.arange((1 << self.bits) + 1)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each wanted key among the keys given, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys) or not len(wanted):
            return out
        head = (wanted >> self.shift).astype(np.int64)
        at, end = self.begin[head], self.begin[head + 1]
        left = np.flatnonzero(at < end)
        at, end, key = at[left], end[left], wanted[left]
        while len(left):
            same = self.keys[at] == key
            out[left[same]] = at[same] if self.order is None else self.order[at[same]]
            at = at + 1
            on = ~same & (at < end)
            left, at, end, key = left[on], at[on], end[on], key[on]
        return out
