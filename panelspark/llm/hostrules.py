"""Quality rules of documents and hosts (DataFrame functions only).

Each document is counted once: words, characters, symbols, repeated lines and
words in repeated three-word windows. From the counts come failures of rules,
which are added up by host (the ``source``). A host's rate of failures is
shrunk towards the rate of all hosts: the hosts' rates are taken as drawn from
one beta distribution for each rule, whose mean and spread are those of the
hosts themselves (moments of the beta-binomial, hosts weighted by their
documents). A host of which over ``limit`` of the documents fail a rule by the
shrunk rate is a bad host, and its documents go with it.

Hosts that hold a thousandth of all rows or more are at most a thousand and go
to all tasks; the others meet their documents in a join in which no key has
more than that share. Texts are in no shuffle.

Defined cases: a null or empty text has no words, and fails the base rule; a
null source is a host of its own; repeated rows count each for itself; where
hosts differ no more than chance, all have the common rate; where no document
fails or all do, that is the rate; an empty table gives an empty result; other
columns are ignored by :func:`judge` and kept, whatever their names, by
:func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import saved
from panelspark.llm.hotkeys import HOT_SHARE, join_said

SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Fixed values, name: a condition on the counts. ``base`` fails documents as well as hosts.
RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
#: Shrunk share of failing documents from which on a host is bad.
LIMIT = 0.5
#: Low bits of a packed hash that hold a window's place.
_PLACE = (1 << 31) - 1


def _packed(words: Column, hashes: Column) -> Column:
    """The three-word windows as sorted numbers, hash before place. Windows whose
    hash has an equal neighbour, few in most texts, are then compared as words."""

    def pack(h: Column, i: Column) -> Column:
        second, third = F.get(hashes, i + 1), F.get(hashes, i + 2)
        mixed = h.bitwiseXOR(F.shiftleft(second, 1)).bitwiseXOR(F.shiftleft(third, 2)).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))
        return F.coalesce(mixed, F.lit(0))  # none is null: so the numbers are sorted unboxed

    return F.sort_array(F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), pack))


def _alike(ordered: Column) -> Column:
    """Of sorted packed hashes, those that agree with a neighbour but for the place."""

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x.bitwiseXOR(y), 31) == 0, F.lit(False))

    return F.filter(ordered, lambda x, j: same(x, F.get(ordered, j + 1)) | same(x, F.get(ordered, j - 1)))


def _windows(words: Column, alike: Column) -> Column:
    """The windows at these places, sorted by words, then place."""

    def window(x: Column) -> Column:
        i = x.bitwiseAND(F.lit(_PLACE)).cast("int")
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))

    return F.sort_array(F.transform(alike, window))


def _covered(windows: Column) -> Column:
    """Words inside windows that have an equal neighbour."""

    def twice(x: Column, j: Column) -> Column:
        return F.coalesce(x["w"] == F.get(windows, j + 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(windows, j - 1)["w"], F.lit(False))

    places = F.array_sort(F.transform(F.filter(windows, twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(i, s["end"])).cast("long").alias("n")), lambda s: s["n"])


def count_rules(docs: DataFrame, kept: str = "*") -> DataFrame:
    """``doc`` (the columns ``kept`` of ``docs`` as a struct), ``host`` and the :data:`COUNTS`."""
    rows = docs.select(F.struct(kept).alias("doc"), F.struct("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_SPACE))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    counts = [F.length(F.array_join("words", "")), F.regexp_count(text, F.lit(SYMBOL)), F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines")]
    rows = rows.select("doc", "host", "text", words.alias("words"), lines.alias("lines"))
    rows = rows.select("doc", "host", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.array(*counts).alias("counts"))
    rows = rows.select("doc", "host", "words", _packed(F.col("words"), F.col("hashes")).alias("packed"), "counts")
    rows = rows.select("doc", "host", "words", _alike(F.col("packed")).alias("alike"), "counts")
    rows = rows.select("doc", "host", "words", _windows(F.col("words"), F.col("alike")).alias("windows"), "counts")
    counts = {"n_words": F.size("words"), "n_repeat_words": _covered(F.col("windows"))}
    counts |= {name: F.col("counts")[i] for i, name in enumerate(("word_chars", "n_symbols", "n_dup_lines", "n_lines"))}
    return rows.select("doc", F.col("host.source").alias("host"), *(counts[c].cast("long").alias(c) for c in COUNTS))


def host_rates(counted: DataFrame, limit: float = LIMIT, rules: dict[str, str] = RULES) -> DataFrame:
    """``host, n_docs, host_rate`` (the largest shrunk rate of a rule), ``bad, hot`` from
    rows of ``host`` and what the rules read."""
    failed = [F.sum(F.when(F.expr(rule), 1).otherwise(0)).cast("double").alias(name) for name, rule in rules.items()]
    hosts = counted.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), *failed)
    # one row: sums over hosts, from partial sums
    sums = [F.count(F.lit(1)).alias("m"), F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("n")).alias("n_n")]
    sums += [x for r in rules for x in (F.sum(r).alias(f"k_{r}"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"kk_{r}"))]
    both = hosts.crossJoin(F.broadcast(hosts.agg(*sums)))
    rates = []
    for r in rules:
        p = F.expr(f"k_{r} / all_n")
        noise = p * (1 - p)
        between = F.col(f"kk_{r}") - p * F.col(f"k_{r}") - noise * (F.col("m") - 1)
        room = noise * (F.expr("all_n - n_n / all_n") - (F.col("m") - 1))
        alike = F.greatest(F.lit(0.0), F.least(F.lit(1.0), between / F.nullif(room, F.lit(0.0))))
        # alike = 1 / (1 + a + b) of the beta prior: (k + (a + b) p) / (n + a + b), written so that no strength is infinite
        shrunk = (alike * F.col(r) + (1 - alike) * p) / (alike * F.col("n") + (1 - alike))
        rates.append(F.when(room > 1e-9, shrunk).otherwise(p))
    worst = F.greatest(*rates) if len(rates) > 1 else rates[0]
    return both.select("host", F.col("n").cast("long").alias("n_docs"), F.round(worst, 9).alias("host_rate"), (worst > limit).alias("bad"), (F.col("n") >= HOT_SHARE * F.col("all_n")).alias("hot"))


def _judged(counted: DataFrame, hosts: DataFrame) -> DataFrame:
    judged = join_said(counted.withColumn("base_failed", F.expr(RULES["base"])), hosts, ["host"], "hot")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("bad"))


def judge(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``doc_id``, the :data:`COUNTS`, ``base_failed, kept, host_rate`` for each row of
    ``docs`` (``doc_id, text, source``)."""
    counted = saved(count_rules(docs, "doc_id").select("doc.doc_id", "host", *COUNTS))
    hosts = saved(host_rates(counted, limit))
    return _judged(counted, hosts).select("doc_id", *COUNTS[:5], "base_failed", "kept", "host_rate")


def keep_good(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` (``text, source`` and any others) that fail neither by
    themselves nor by their host. The texts are counted twice, and not stored."""
    hosts = saved(host_rates(count_rules(docs, "source").drop("doc"), limit))
    return _judged(count_rules(docs), hosts).where("kept").select("doc.*")
