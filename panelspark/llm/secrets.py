"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of a text is addressed by the SHA-256 of its content. The ledger
is a table of what every (blob, rule, version of the rule) triple that was ever
scanned has given. A scan takes from it what is there, scans the other triples,
each distinct blob once however many paths hold it, and gives the ledger's rows
of all blobs at hand: append them, and the next scan has nothing to do. From
these rows the findings are joined back to all paths.

Defined cases: a null text is the empty blob and has no findings; repeated
rows each get their findings; empty tables give empty results; a blob that is
in the ledger several times counts once; other columns of the versions table
pass through ``findings_by_path`` untouched unless they are named ``blob`` or
``spans``, which are replaced, and through ``redact_documents`` in any case.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import saved


class Rule(NamedTuple):
    """``pattern`` finds candidates, leftmost and non-overlapping; one counts if
    ``group`` of it has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base kinds. A maximal run that is too short cannot hold
#: a long enough one, so the least lengths of access and hex stand in the pattern.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = 3
_SPAN = "struct<start:int,kind:int,end:int>"
_PLACE = "struct<start:int,end:int>"
#: A row of the ledger: what each rule's version has found in a blob.
LEDGER = f"blob string, found array<struct<rule:string,version:int,spans:array<{_PLACE}>>>"
_HITS = 256


def blob_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule in code points: the pieces between the matches and the
    matches themselves have the lengths that add up to the offsets. Hits are taken
    in runs of ``_HITS``, so that the array built so far is not copied at each."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    none = F.array().cast(f"array<{_PLACE}>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["hit"])
        found = F.array(F.struct(start.alias("start"), end.alias("end")).cast(_PLACE))
        out = F.when(F.char_length(part["value"]) >= rule.least, F.concat(state["out"], found)).otherwise(state["out"])
        return F.struct(end.cast("int").alias("at"), out.alias("out"))

    def run(state: Column, hits: Column) -> Column:
        inner = F.aggregate(hits, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["out"], inner["out"]).alias("out"))

    hits = F.filter(parts, lambda p: p["hit"].isNotNull())
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / _HITS).cast("int")), lambda i: F.slice(hits, i * _HITS + 1, F.lit(_HITS)))
    return F.when(text.rlike(rule.pattern), F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("out")), run, lambda s: s["out"])).otherwise(none)


def _entry(rule: Rule, spans: Column) -> Column:
    return F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), spans.alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of the ledger (:data:`LEDGER`) for every distinct text of ``versions``
    with all ``rules`` in their present versions: those of ``ledger`` as they are,
    and those that it lacks from a scan."""
    rows = versions.select(blob_address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is None:
        blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
        return blobs.select("blob", F.array(*[_entry(r, rule_spans(F.col("text"), r)) for r in rules]).alias("found"))
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    name = lambda e: F.concat_ws("@", e["rule"], e["version"].cast("string"))
    # once for each blob, rule and version, however often a run was appended
    known = ledger.select("blob", F.explode("found").alias("e")).where(F.array_contains(current, name(F.col("e")))).groupBy("blob", F.col("e.rule").alias("rule"), F.col("e.version").alias("version")).agg(F.first("e.spans").alias("spans"))
    known = known.groupBy(F.col("blob").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("@", "rule", F.col("version").cast("string")), "spans"))).alias("seen"))
    known = saved(known.join(rows.select("blob").distinct(), F.col("of") == F.col("blob"), "left_semi"))
    whole = known.where(F.size("seen") == len(rules))
    blobs = rows.join(whole, F.col("blob") == F.col("of"), "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    blobs = blobs.join(known.where(F.size("seen") < len(rules)), F.col("blob") == F.col("of"), "left")
    entries = [_entry(r, F.coalesce(F.col("seen")[f"{r.kind}@{r.version}"], rule_spans(F.col("text"), r))) for r in rules]
    old = whole.select(F.col("of").alias("blob"), F.array(*[_entry(r, F.col("seen")[f"{r.kind}@{r.version}"]) for r in rules]).alias("found"))
    return blobs.select("blob", F.array(*entries).alias("found")).unionAll(old)


def found_spans(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a ledger row that :func:`scan` gave for ``rules``, by start, then rule."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(found, lambda e: F.transform(e["spans"], lambda s: F.struct(s["start"].alias("start"), (F.array_position(kinds, e["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")).cast(_SPAN)))
    return F.array_sort(F.flatten(spans))


def findings_by_path(versions: DataFrame, entries: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``versions`` with their ``blob`` and its ``spans``, from the
    ledger rows (``entries``) that :func:`scan` gave for them."""
    paths = versions.drop("blob", "spans").withColumn("blob", blob_address(F.col("text")))
    found = entries.select(F.col("blob").alias("__blob"), found_spans(F.col("found"), rules).alias("spans"))
    return paths.join(found, F.col("blob") == F.col("__blob"), "left").drop("__blob")


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spans: Column) -> list[Column]:
    """Counts and digests of the spans of a row."""
    base = F.filter(spans, lambda s: s["kind"] < BASE_KINDS)

    def count(number: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES[:BASE_KINDS])]
    return [*counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans")]


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    entries = saved(scan(docs, ledger))
    found = entries.select(F.col("blob").alias("__blob"), found_spans(F.col("found")).alias("spans")).select("__blob", *digests(F.col("spans")))
    paths = docs.select("doc_id", blob_address(F.col("text")).alias("__address"))
    return paths.join(found, F.col("__address") == F.col("__blob")).drop("__address", "__blob")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def redact_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with all secrets cut from their texts; ``n_chars`` follows the text."""
    found = scan(docs, ledger).select(F.col("blob").alias("__blob"), found_spans(F.col("found")).alias("__spans"))
    found = saved(found.where(F.size("__spans") > 0))
    out = docs.withColumn("__address", blob_address(F.col("text"))).join(found, F.col("__address") == F.col("__blob"), "left")
    out = out.withColumn("text", redacted(F.col("text"), F.coalesce("__spans", F.array().cast(f"array<{_SPAN}>"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
