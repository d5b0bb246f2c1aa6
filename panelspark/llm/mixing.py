"""Mixing of sources to target weights by pivotal dependent rounding (DataFrame functions only).

Each source gets a target number of words. Target over size is the number of
copies that each of its documents is due: the whole part is given, and the
fraction left is a probability. Pivotal rounding takes two documents with such
fractions, moves mass from one to the other at random until one of the two is
0 or 1, and goes on with the one that is still fractional. What moves is words:
one document's probability falls by as many expected words as the other's
rises, so each probability keeps its mean and the words due to a source stay
exactly its target until one document is left. That one is rounded to the
nearer side, so a source's words differ from its target by half of one
document at most. Blocks of ``fan_in`` documents do this independently and hand
one fractional document each to the next level, so a source of any size is a
reduction tree of a few levels.

Defined cases: a null or empty text has size 0, and takes 0 words; a null
source is a source of its own, after all others; repeated rows (also with the
same or a null doc_id) are mixed each for itself; of documents with equal sizes
and hashes any order gives the same words; a source without words has target 0;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, source_rows, target`` from rows of ``source, size``.

    The weights repeat over the sources by code point, null last. A target stops
    at ``max_copies`` times its source's size and the excess goes to the others
    by weight until none is above: with the sources in the order of the factor
    at which each reaches its stop, that is one level for all that are open.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = by_source.withColumn("place", F.row_number().over(named) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    w = w.withColumn("weight", weight).withColumn("stop", F.col("source_size") * float(max_copies))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "place")
    to_here = by_stop.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    w = (
        w.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("shut", F.sum("stop").over(to_here) - F.col("stop"))
        .withColumn("open_weight", F.sum("weight").over(every) - F.sum("weight").over(to_here) + F.col("weight"))
        # with all before this one at their stops, the level of the rest
        .withColumn("level", (F.col("total") - F.col("shut")) / F.col("open_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("stop"))
    )
    level = F.min(F.when(F.col("fits"), F.struct("place_by_stop", "level"))).over(every)["level"]
    w = w.withColumn("place_by_stop", F.row_number().over(by_stop)).withColumn("the_level", level)
    target = F.when(F.col("the_level").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("the_level") * F.col("weight")))
    return w.select("source", "source_size", "source_rows", target.alias("target"))


_ITEM = "struct<doc_id:bigint,size:bigint,p:double,tie:bigint>"
_STATE = f"struct<held:{_ITEM},done:array<struct<doc_id:bigint,size:bigint,extra:int>>>"


def _fold(items: Column, level: int, seed: int) -> Column:
    """Pivotal rounding along one block: what is decided, and the one still held."""

    def step(state: Column, new: Column) -> Column:
        held = state["held"]
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), held["tie"], new["tie"]), F.lit(1 << 53)) / float(1 << 53)
        # words that the held document can gain or lose, and those that the new one can
        gain, lose = (1.0 - held["p"]) * held["size"], held["p"] * held["size"]
        new_gain, new_lose = (1.0 - new["p"]) * new["size"], new["p"] * new["size"]
        up, down = F.least(gain, new_lose), F.least(lose, new_gain)
        rises = draw * (up + down) < down  # so that the means stay
        new_goes_on = F.when(rises, gain <= new_lose).otherwise(lose <= new_gain)
        goes = F.when(new_goes_on, new).otherwise(held)
        ends = F.when(new_goes_on, held).otherwise(new)
        extra = F.when(new_goes_on == rises, 1).otherwise(0)
        words = F.when(new_goes_on, F.when(rises, new_lose - up).otherwise(new_lose + down)).otherwise(F.when(rises, lose + up).otherwise(lose - down))
        rest = F.greatest(F.lit(0.0), F.least(F.lit(1.0), words / goes["size"]))
        moved = F.struct(goes["doc_id"].alias("doc_id"), goes["size"].alias("size"), rest.alias("p"), goes["tie"].alias("tie"))
        decided = F.struct(ends["doc_id"].alias("doc_id"), ends["size"].alias("size"), extra.cast("int").alias("extra"))
        first = F.struct(new.cast(_ITEM).alias("held"), state["done"].alias("done")).cast(_STATE)
        other = F.struct(moved.alias("held"), F.concat(state["done"], F.array(decided)).alias("done")).cast(_STATE)
        return F.when(held.isNull(), first).otherwise(other)

    start = F.struct(F.lit(None).cast(_ITEM).alias("held"), F.array().cast("array<struct<doc_id:bigint,size:bigint,extra:int>>").alias("done")).cast(_STATE)
    return F.aggregate(items, start, step)


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``, ``taken``, ``size``,
    ``source_size`` and ``target`` (which replace columns of these names). The
    draws depend on doc_id (a number) and text, not on the layout of the rows; rows
    that are equal in both are interchangeable, and share a block of the tree."""
    new = ("copies", "taken", "size", "source_size", "target")
    # rows get numbers that are written with them, so that each finds its own copies again
    kept = saved(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    plan = mix_sources(kept.select("doc.doc_id", "doc.text", "doc.source", "row"), weights, max_copies, key="row").where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("of"), *new)
    return kept.join(plan, F.col("row") == F.col("of")).select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in new], *new)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES, fan_in: int = 256, seed: int = 6, key: str = "doc_id") -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for each row of ``docs``
    (``doc_id, text, source``). The draws depend on ``seed`` and the rows alone.
    With another ``key``, a column of ``docs``, its value is returned as ``doc_id``."""
    spread = ["tie", "doc_id"] if key == "doc_id" else ["tie"]  # what the blocks are dealt by
    sizes = saved(docs.select(F.col(key).cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("tie")))
    targets = saved(source_targets(sizes, weights, max_copies))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = F.least(due, F.lit(float(max_copies)))
    named = targets.select(F.col("source").alias("named"), "source_size", "source_rows", "target", F.floor(due).cast("int").alias("whole"), (due - F.floor(due)).alias("p"))
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("named")), "left")
    place = ["named", "source_size", "target", "whole"]
    open_rows = rows.where("size > 0").select(*place, "doc_id", "size", "p", "tie", F.ceil(F.col("source_rows") / fan_in).alias("blocks"))
    most = (targets.agg(F.max("source_rows")).first()[0] or 0)
    decided, level = [rows.where("size = 0").select(*place, "doc_id", "size", F.lit(0).alias("extra"))], 0
    while True:
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *spread), F.col("blocks"))
        item = F.struct("doc_id", "size", "p", "tie")
        ordered = F.array_sort(F.collect_list(item), lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0))
        folded = open_rows.withColumn("block", block).groupBy(*place, "block", "blocks").agg(ordered.alias("items")).withColumn("state", _fold(F.col("items"), level, seed)).drop("items")
        folded = saved(folded)
        done = folded.select(*place, F.explode("state.done").alias("d")).select(*place, "d.doc_id", "d.size", "d.extra")
        decided.append(done)
        held = folded.select(*place, "state.held.doc_id", "state.held.size", "state.held.p", "state.held.tie", F.ceil(F.col("blocks") / fan_in).alias("next"), "blocks")
        most = -(-most // fan_in)
        if most <= 1:
            break
        open_rows = held.select(*place, "doc_id", "size", "p", "tie", F.col("next").alias("blocks"))
        level += 1
    decided.append(held.select(*place, "doc_id", "size", F.when(F.col("p") >= 0.5, 1).otherwise(0).cast("int").alias("extra")))
    out = reduce(DataFrame.unionAll, decided)
    copies = F.least(F.col("whole") + F.col("extra"), F.lit(max_copies)).cast("int")
    return out.select("doc_id", "size", "source_size", "target", F.col("named").alias("source"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))

