"""Merkle manifest of a dataset: a content-addressed store, and proofs by descent from the root.

Each language is a tree whose leaves are the digests of its rows by doc_id; in
each level two consecutive nodes become their digest. The subroots, by
language, are the leaves of one more tree. The store has records of digest to
children, where a record spans a segment of :data:`LEVELS` levels: the digest of
a segment's top and the digests at its foot (what lies between follows from
them). Equal segments are one record, wherever they stand.

Requests for leaves descend from the root, segment by segment: a request's rank
in binary digits says which child to take at each level, the child not taken
is collected, and the collected path is reversed at the end to go from the leaf
up. Requests that share nodes descend as one until they part, so a segment is
opened once and no row is asked of a node more often than it has children.

Ranks come from a sort by ranges, so a language may hold all rows: row numbers
in a range, and counts of the ranges before it.

Defined cases: a null field is ``-``; a null language is a tree of its own, before
all others; a null doc_id comes before others, rows of one doc_id are ordered
by their digest (equal rows are equal leaves); a language of one row is its
own subroot, one language its own root; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import saved
from panelspark.llm.hotkeys import HOT_SHARE, join_said

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels in a segment.
LEVELS = 8
WIDTH = 1 << LEVELS
STEP = "struct<left:boolean,digest:string>"


class Forest(NamedTuple):
    """Trees (``tree`` names them): ``roots`` has ``tree, n, digest``, with n leaves;
    ``records`` has the store of each segment, the lowest first: ``digest, depth,
    children, hot``."""

    roots: DataFrame
    records: list[DataFrame]


def leaf_digest(changed: dict[str, Column] | None = None) -> Column:
    """SHA-256 of the fields of a row, each with its length in bytes."""
    parts = []
    for name in FIELDS:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _pairs(nodes: Column) -> Column:
    """The level above."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256))


def _levels(foot: Column, depth: Column) -> Column:
    """All levels of a segment, from its foot to its top."""
    climbed = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.array(foot), lambda done, _: F.concat(done, F.array(_pairs(F.element_at(done, -1)))))
    return F.when(depth > 0, climbed).otherwise(F.array(foot))


def _bits(n: Column) -> Column:
    """Levels of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _nodes_at(n: Column, segment: int) -> Column:
    """Nodes at the foot of a segment in a tree of n leaves."""
    return F.ceil(n / F.lit(1 << (LEVELS * segment))).cast("long")


def _up(x: str | Column, segments: int) -> Column:
    return F.shiftright(x, LEVELS * segments)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``) and ``n`` in their ``tree``, as a table."""
    by = [F.col("tree"), *order, F.col("scan")]  # equal rows spread over ranges by where they were read
    ranges = rows.withColumn("scan", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranges = saved(ranges.drop("scan").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = ranges.groupBy("tree", part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    # as many rows as there are ranges and trees
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    placed = ranges.withColumn("part", part).join(starts, ["tree", "part"])
    return saved(placed.withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift"))


def build(leaves: DataFrame) -> Forest:
    """The trees over ``leaves`` (``tree, rank, n, digest``, a written table)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, records, roots, segment = leaves.select("tree", "rank", "digest", F.col("n").alias("leaves")), [], [], 0
    while True:
        here = _nodes_at(F.col("leaves"), segment)
        foot = F.array_sort(F.collect_list(F.struct("rank", "digest")))  # WIDTH nodes at most
        blocks = nodes.groupBy("tree", "leaves", _up("rank", 1).alias("rank")).agg(F.transform(foot, lambda x: x["digest"]).alias("children"))
        blocks = blocks.withColumn("depth", F.when(here <= WIDTH, _bits(here)).otherwise(LEVELS).cast("int"))
        blocks = saved(blocks.withColumn("digest", F.element_at(F.element_at(_levels(F.col("children"), F.col("depth")), -1), 1)))
        kinds = blocks.groupBy("digest", "depth").agg(F.first("children").alias("children"), F.count(F.lit(1)).alias("times"))
        records.append(saved(kinds.crossJoin(F.broadcast(blocks.agg(F.count(F.lit(1)).alias("blocks")))).select("digest", "depth", "children", (F.col("times") >= HOT_SHARE * F.col("blocks")).alias("hot"))))
        roots.append(blocks.where(here <= WIDTH).select("tree", F.col("leaves").alias("n"), "digest"))
        if most <= WIDTH:
            return Forest(saved(reduce(DataFrame.unionAll, roots)), records)
        nodes = blocks.where(here > WIDTH).select("tree", "rank", "digest", "leaves")
        most, segment = -(-most // WIDTH), segment + 1


def descend(forest: Forest, tops: DataFrame, requests: DataFrame) -> DataFrame:
    """``tree, asked, digest, path, told`` for each of ``requests`` (``tree, rank, asked``:
    any column). ``tops`` (``tree, n, digest, path, told``) says where each tree begins,
    the path that led there and what its leaves are told; ``path`` goes from the
    root down, a step at each level."""
    front = None
    for segment in reversed(range(len(forest.records))):
        here, below = _nodes_at(F.col("n"), segment), _nodes_at(F.col("n"), segment - 1) if segment else F.lit(WIDTH + 1)
        new = tops.where((here <= WIDTH) & (below > WIDTH)).select("tree", F.lit(0).cast("long").alias("block"), "n", "digest", "path", "told")
        front = new if front is None else front.select("tree", F.col("rank").alias("block"), "n", "digest", "path", "told").unionAll(new)
        front = front.withColumn("depth", F.when(here <= WIDTH, _bits(here)).otherwise(LEVELS).cast("int"))
        if segment:
            wanted = requests.select("tree", _up("rank", segment).alias("rank")).distinct().withColumn("asked", F.lit(None).cast("boolean"))
        else:
            wanted = requests.select("tree", "rank", "asked")
        wanted = wanted.groupBy("tree", _up("rank", 1).alias("block")).agg(F.collect_list(F.struct("rank", "asked")).alias("wanted"))
        opened = saved(front.join(wanted, ["tree", "block"]))
        opened = join_said(opened, forest.records[segment], ["digest", "depth"], "hot")
        opened = opened.withColumn("levels", _levels(F.col("children"), F.col("depth")))

        def step(at: Column, level: Column) -> Column:
            place = F.call_function("shiftright", at, level)
            other = F.get(F.element_at("levels", level + 1), place.bitwiseXOR(F.lit(1)))
            return F.struct((place.bitwiseAND(F.lit(1)) == 1).alias("left"), other.alias("digest"))

        def taken(w: Column) -> Column:
            at = w["rank"].bitwiseAND(F.lit(WIDTH - 1)).cast("int")
            down = F.when(F.col("depth") > 0, F.transform(F.sequence(F.col("depth") - 1, F.lit(0), F.lit(-1)), lambda level: step(at, level)))
            path = F.concat("path", F.coalesce(down, F.array().cast(f"array<{STEP}>")))
            return F.struct(w["rank"].alias("rank"), w["asked"].alias("asked"), F.get("children", at).alias("digest"), path.alias("path"))

        front = opened.select("tree", "n", "told", F.explode(F.transform("wanted", taken)).alias("t")).select("tree", "n", "told", "t.*")
        if segment:
            front = saved(front)
    return front.select("tree", "asked", "digest", "path", "told")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path from the root down."""

    def up(at: Column, step: Column) -> Column:
        other = F.coalesce(step["digest"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(other, at)).otherwise(F.concat(at, other)), 256)

    return F.aggregate(F.reverse(path), leaf, up)


def siblings(path: Column) -> Column:
    """The digests of a path, from the leaf up."""
    return F.filter(F.transform(F.reverse(path), lambda s: s["digest"]), lambda d: d.isNotNull())


def prove(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, other_leaf`` for each row of ``docs``.
    ``other_leaf`` is the digest of the row with the columns ``changed``, where it is to be changed."""
    other = F.when(F.lit(True) if where is None else where, leaf_digest(changed)) if changed else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # the order of languages, null first
    leaves = ranked(docs.select(tree.alias("tree"), "doc_id", leaf_digest().alias("digest"), other.alias("other")), [F.col("doc_id"), F.col("digest")])
    forest = build(leaves)
    trees = ranked(forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), "digest"), [F.col("name")])
    whole = build(trees)
    root = whole.roots.select("tree", "n", "digest", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("told"))
    tops = descend(whole, root, trees.select("tree", "rank", F.struct("name", "leaves").alias("asked")))
    told = F.struct(F.col("digest").alias("subroot"), F.col("told").alias("root"))
    tops = saved(tops.select(F.col("asked.name").alias("tree"), F.col("asked.leaves").alias("n"), "digest", "path", told.alias("told")))
    found = descend(forest, tops, leaves.select("tree", "rank", F.struct("doc_id", "other").alias("asked")))
    return found.select("asked.doc_id", F.col("digest").alias("leaf"), "told.subroot", "told.root", "path", F.col("asked.other").alias("other_leaf"))


def verify(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of
    ``docs``, one in seven of which is tampered with after its proof was made."""
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    proofs = prove(docs.select(*FIELDS), {"n_chars": F.col("n_chars") + 1}, changed)
    folded = fold(F.coalesce("other_leaf", "leaf"), F.col("path"))
    rows = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings(F.col("path")), ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
