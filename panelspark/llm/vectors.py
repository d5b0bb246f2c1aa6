"""Exact range join of embeddings over pivots.

Unit vectors with a cosine of at least ``cosine`` are at most r apart. Pivots
part the vectors of each label into cells, a vector belonging to its nearest
pivot. What is nearer to another pivot lies beyond the plane between the two, so
a vector is also copied, as a visitor, to all later cells of which the plane is
within r; each cell then finds the links among its own vectors and with its
visitors, and every pair meets once. Cells are cut into blocks of at most
``BLOCK`` vectors and ``BLOCK_BYTES``, so no task's memory depends on a cell's
size. Where blocks meet many others, their pairs are compared in rounds, so that
at most about ``MOVED`` copies of a vector are on disk at a time.

Equal vectors are one row with a count, so a large group of copies costs one
row; the copies get their class's results back.

Each label has a pivot for ``CELL`` of its vectors at most, drawn by a hash; with
more than ``MAX_PIVOTS`` in all, every label's share shrinks, so what is broadcast
has a bound. In many dimensions, with a wide radius, most vectors are near every
plane, and more pivots make more copies and no fewer pairs: a second draw tells
how many copies a number of pivots makes, and the cheapest number is taken.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite
numbers, and those with a null label or vec_id, link with nothing and are
components of their own; vectors of different lengths do not link; rows that
repeat a vec_id are one node for components; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import discard, giving_back, saved
from panelspark.llm.components import Forest, components

COSINE = 0.93
CELL = 512
MAX_PIVOTS = 2048
BLOCK, BLOCK_BYTES = 1 << 15, 1 << 24
MOVED = 3
#: Pairs that are compared at once, and rows of one Arrow batch.
PAIRS, SLICE = 1 << 20, 1024
#: What a copy of a vector costs, in comparisons of a pair.
COPY_COST = 2000


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v``: unit vectors as bytes of doubles; null where a row links with nothing."""

    def units(column: pa.Array) -> pa.Array:
        flat = pc.fill_null(column.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, out = np.cumsum(length) - length, [None] * len(column)
        for n in np.unique(length[length > 0]).tolist():
            at = np.flatnonzero(length == n)
            v = flat[begin[at][:, None] + np.arange(n)]
            top = np.abs(v).max(1)
            ok = np.isfinite(v).all(1) & (top > 0)
            v = v[ok] / top[ok, None]  # so that no square is out of range
            v = v / np.sqrt((v * v).sum(1, keepdims=True))
            for i, x in zip(at[ok].tolist(), v, strict=True):
                out[i] = x.tobytes()
        return pa.array(out, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), units(b.column("embedding"))], names=["vec_id", "label", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").mapInArrow(giving_back(run), "vec_id long, label string, v binary")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.float64).reshape(len(column), -1)


def cells_of(v: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row of ``v``, and a matrix of the cells that it goes to:
    its own, and those after it with a vector that may be within ``radius``."""
    if len(pivots) < 2:
        return np.zeros(len(v), np.int64), np.ones((len(v), 1), bool)
    cosines, apart = v @ pivots.T, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * pivots @ pivots.T))
    home = cosines.argmax(1)
    # half the difference of the squared distances, by the distance of the pivots, is that to the plane
    near = cosines.max(1, keepdims=True) - cosines <= radius * apart[home] + 1e-6
    near &= np.arange(len(pivots)) > home[:, None]
    near[np.arange(len(v)), home] = True
    return home, near


def cheapest(drawn: np.ndarray, most: int, vectors: int, radius: float) -> np.ndarray:
    """The first rows of ``drawn`` as pivots, ``most`` at most: as many as cost
    least for ``vectors`` rows, judged by the rows of ``drawn`` that are left."""
    best, n, k = math.inf, 1, 1
    while k <= most and k < len(drawn):
        copies = cells_of(drawn[k : k + SLICE], drawn[:k], radius)[1].sum() / len(drawn[k : k + SLICE])
        cost = vectors / k * (copies - 0.5) + COPY_COST * copies
        if cost < best:
            best, n = cost, k
        k *= 2
    return drawn[:n]


def _cells(reps: DataFrame, radius: float, cell: int, max_pivots: int) -> Callable[[list[str]], DataFrame]:
    """A function that gives columns of ``reps`` with ``label, size, cell, own``: a row for each cell that a vector goes to."""
    spark = reps.sparkSession
    spaces = reps.groupBy("label", F.length("v").alias("bytes")).agg(F.count(F.lit(1)).alias("vectors"))
    spaces = saved(spaces.withColumn("wanted", F.greatest(F.lit(2), F.ceil(F.col("vectors") / cell))))
    share = min(1.0, max_pivots / max(1, spaces.agg(F.sum("wanted")).first()[0] or 0))
    known = spaces.select(F.col("label").alias("of"), F.col("bytes").alias("of_bytes"), F.col("vectors"), F.ceil(F.col("wanted") * share).alias("most"))
    # as many again judge the pivots; about twice as many as are wanted come from the draw, so that a label gets its number
    draw = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30)
    some = reps.join(known, (F.col("label") == F.col("of")) & (F.length("v") == F.col("of_bytes"))).withColumn("draw", draw)
    some = some.where(F.col("draw") * F.col("vectors") < 4 * F.col("most") + 8)
    place = F.row_number().over(Window.partitionBy("label", "of_bytes").orderBy("draw", "node"))
    chosen = some.withColumn("place", place).where(F.col("place") <= 2 * F.col("most")).limit(2 * max_pivots + 2)
    by_space: dict[tuple[str, int], list] = {}
    for r in sorted(chosen.select("label", "v", "vectors", "most", "place").collect(), key=lambda r: r.place):
        by_space.setdefault((r.label, len(r.v)), []).append(r)
    rows_of = lambda rs: np.frombuffer(b"".join(bytes(r.v) for r in rs), np.float64).reshape(len(rs), -1)
    pivots = spark.sparkContext.broadcast({k: cheapest(rows_of(rs), rs[0].most, rs[0].vectors, radius) for k, rs in by_space.items()})
    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}

    def placed(columns: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                    sizes = pc.binary_length(b.column("v")).cast(pa.int64())
                    spaces = list(zip(b.column("label").to_pylist(), sizes.to_pylist(), strict=True))
                    for space in sorted(set(spaces)):
                        at = np.array([i for i, s in enumerate(spaces) if s == space])
                        v = matrix(b.column("v").take(pa.array(at)))
                        home, near = cells_of(v, pivots.value.get(space, v[:0]), radius)
                        i, c = np.nonzero(near)
                        for lo in range(0, len(i), 4 * SLICE):
                            take, cells = at[i[lo : lo + 4 * SLICE]], c[lo : lo + 4 * SLICE]
                            rows = b.take(pa.array(take))
                            own = cells == home[i[lo : lo + 4 * SLICE]]
                            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in columns), rows.column("label"), sizes.take(pa.array(take)), pa.array(cells), pa.array(own)], names=[*columns, "label", "size", "cell", "own"])

        schema = ", ".join(f"{n} {kinds[n]}" for n in columns) + ", " * bool(columns) + "label string, size long, cell long, own boolean"
        return reps.select(*dict.fromkeys([*columns, "label", "v"])).mapInArrow(giving_back(run), schema)

    return placed


def _compare(cosine: float) -> Callable[[pa.Table], pa.Table]:
    """Links among the rows of a block, or between those of side 0 and those of
    side 1: for each row that has any, their sum and the smallest node that they lead to."""

    def run(t: pa.Table) -> pa.Table:
        side, node, n = (t.column(c).to_numpy() for c in ("side", "node", "n"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = t.column("a")[0].as_py() == t.column("b")[0].as_py()
        b = a if alone else b
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))
        if len(a) and len(b):
            v = matrix(t.column("v"))
            rough = v.astype(np.float32)
            slack = (v.shape[1] + 8) * 2.0**-22  # more than single precision can be off
            others = np.ascontiguousarray(rough[b].T)
            step = max(1, PAIRS // len(b))
            for lo in range(0, len(a), step):
                own = a[lo : lo + step]
                first = lo if alone else 0  # of a block with itself, each pair once
                near = rough[own] @ others[:, first:] >= np.float32(cosine - slack)
                i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                if 16 * len(i) > near.size:
                    i, j = np.nonzero(v[own] @ v[b[first:]].T >= cosine)
                    i, j = own[i], b[first:][j]
                else:
                    i, j = own[i], b[first:][j]
                    on = np.concatenate([(v[i[k : k + 65536]] * v[j[k : k + 65536]]).sum(1) >= cosine for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
                    i, j = i[on], j[on]
                if alone:
                    i, j = i[i < j], j[i < j]
                apart = node[i] != node[j]
                np.add.at(links, i[apart], n[j[apart]])
                np.add.at(links, j[apart], n[i[apart]])
                forest.join(i, j)
        root = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(root, forest.label, node)
        other = root[forest.label]
        on = np.flatnonzero((links > 0) | (other != node))
        return pa.table({"node": node[on], "links": links[on], "other": other[on]})

    return run


def range_links(reps: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """``node, links, other``: partial sums of the counts ``n`` of linked rows of
    ``reps`` (``node, n, label, v``), and edges that connect what links connect."""
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    placed = _cells(reps, radius, cell, max_pivots)
    space = ["label", "size", "cell"]
    held = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / F.col("size"))))
    sizes = placed([]).groupBy(*space).agg(F.sum(F.col("own").cast("int")).alias("owned"), F.sum((~F.col("own")).cast("int")).alias("visits")).where("owned > 0")
    sizes = saved(sizes.withColumn("na", F.ceil(F.col("owned") / held).cast("int")).withColumn("nb", F.ceil(F.col("visits") / held).cast("int")))
    moved, vectors = sizes.agg(F.sum(F.expr("owned * (na + nb) + visits * na")), F.sum("owned")).first()
    rounds = max(1, math.ceil((moved or 0) / (MOVED * (vectors or 1))))
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rows = placed(["node", "n", "v"]).join(sizes.drop("owned", "visits"), space)
    # a block of own vectors meets all blocks of its cell once, one of visitors those of own vectors
    rows = rows.withColumn("part", F.when(F.col("own"), at("na")).otherwise(F.col("na") + at("nb")))
    meets = F.sequence(F.lit(0), F.when(F.col("own"), F.col("na") + F.col("nb")).otherwise(F.col("na")) - 1)
    columns = [*space, "a", "b", "side", "node", "n", "v"]

    def found(k: int) -> DataFrame:
        some = rows.withColumn("meets", F.explode(F.filter(meets, lambda j: F.pmod(F.col("part") + j, F.lit(rounds)) == k)))
        some = some.withColumns({"a": F.least("part", "meets"), "b": F.greatest("part", "meets")}).withColumn("side", (F.col("part") != F.col("a")).cast("int"))
        return some.select(columns).groupBy(*space, "a", "b").applyInArrow(_compare(cosine), "node long, links long, other long")

    if rounds == 1:
        return found(0)
    return reduce(DataFrame.unionAll, [saved(found(k)) for k in range(rounds)])


def near_duplicates(rows: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row (``vec_id, embedding, label``)."""
    units = saved(unit_vectors(rows).withColumn("class", F.when(F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.sha2(F.concat(F.col("label").cast("binary"), F.lit(b"\0"), F.col("v")), 256))))
    reps = saved(units.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v")))
    classed = saved(units.select("vec_id", "class"))
    discard(units)
    found = saved(range_links(reps, cosine, cell, block))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    low = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    low = low.select(F.col("node").alias("member"), "component")
    classes = reps.select("class", "node", "n").join(links, "node", "left").join(low, F.col("node") == F.col("member"), "left")
    classes = saved(classes.select(F.col("class").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = classed.where("class is not null").join(classes, F.col("class") == F.col("of")).select("vec_id", "n_links", "component_id")
    alone = classed.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
