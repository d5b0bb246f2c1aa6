"""Panels of bars derived from the driver tables, and queries as named steps.

A query is a list of named SQL steps and a result. Spark binds each step as a
DataFrame: a step that several others read and that needs a shuffle is written
to the shared folder once, and steps that nothing reads are never planned.
DuckDB gets the same steps as one statement; where a step has a text of its own
for DuckDB (:class:`Both`), the oracle is computed in another way.

Prices are tick prices (5000 + l_extendedprice / 100); bars open and close with
the first and last tick of their span under a total order.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelspark.sources.shared import saved

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Words for what the dialects name differently. LISTED: the values of a frame; BELOW, SAME: how many of a
#: list are below or equal a value; FIRST: the place of the first that is equal; EARLIEST: the first valid value; RISING: values times 1, 2, 3, ...
_TOKENS = {
    "spark": {
        r"LISTED\[([^|]*)\|([^\]]*)\]": r"collect_list(\1) OVER \2",
        r"BELOW\[([^|]*)\|([^\]]*)\]": r"size(filter(\1, v -> v < \2))",
        r"SAME\[([^|]*)\|([^\]]*)\]": r"size(filter(\1, v -> v = \2))",
        r"LENGTH\[([^\]]*)\]": r"size(\1)",
        r"FIRST\[([^|]*)\|([^\]]*)\]": r"array_position(\1, \2)",
        r"EARLIEST\[([^\]]*)\]": r"first_value(\1, true)",
        r"RISING\[([^|]*)\|([^\]]*)\]": r"aggregate(sequence(1, \2), 0D, (s, i) -> s + i * element_at(\1, i))",
        r"MILLIS\[([^\]]*)\]": r"unix_millis(CAST(\1 AS TIMESTAMP))", r"DAYS\[([^|]*)\|([^\]]*)\]": r"datediff(\2, \1)", r"MATCHES\[([^|]*)\|([^;]*);\]": r"\1 RLIKE '\2'"},
    "duckdb": {
        r"LISTED\[([^|]*)\|([^\]]*)\]": r"list(\1) FILTER (\1 IS NOT NULL) OVER \2",
        r"BELOW\[([^|]*)\|([^\]]*)\]": r"len(list_filter(\1, lambda v: v < \2))",
        r"SAME\[([^|]*)\|([^\]]*)\]": r"len(list_filter(\1, lambda v: v = \2))",
        r"LENGTH\[([^\]]*)\]": r"len(\1)",
        r"FIRST\[([^|]*)\|([^\]]*)\]": r"list_position(\1, \2)",
        r"EARLIEST\[([^\]]*)\]": r"first_value(\1 IGNORE NULLS)",
        r"RISING\[([^|]*)\|([^\]]*)\]": r"list_sum(list_transform(range(1, \2 + 1), lambda i: i * \1[i]))",
        r"MILLIS\[([^\]]*)\]": r"epoch_ms(\1)", r"DAYS\[([^|]*)\|([^\]]*)\]": r"date_diff('day', \1, \2)", r"MATCHES\[([^|]*)\|([^;]*);\]": r"regexp_matches(\1, '\2')"},
}


class Both(str):
    """The text of a step for Spark; ``duckdb`` is that for DuckDB."""

    duckdb: str

    def __new__(cls, spark: str, duckdb: str) -> Both:
        text = super().__new__(cls, spark)
        text.duckdb = duckdb
        return text


def spoken(sql: str, dialect: str) -> str:
    """``sql`` in the words of ``dialect``."""
    if dialect == "duckdb":
        sql = getattr(sql, "duckdb", sql)
    for token, words in _TOKENS[dialect].items():
        sql = re.sub(token, words, sql)
    return sql


_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, price, qty"

_TICKS = """SELECT {symbol} AS symbol, date_trunc('{span}', l_shipdate) AS ts, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         5000 + l_extendedprice / 100 AS price, l_quantity AS qty, l_discount, l_tax, l_extendedprice, l_linestatus
  FROM lineitem {join}"""

_REST = "max(price) AS high, min(price) AS low, sum(qty) AS volume, avg(l_tax) AS tax, avg(l_discount) AS discount, sum(l_extendedprice) AS traded"

#: A tick by the order of the oracle, with its price: day, order and line alone leave ties (84 of the 600,000
#: ticks of sf0.1), and packed in one number they overflow where keys are large. Ticks equal up to the price
#: have one price.
_TICK = f"struct({_ORDER.removesuffix(', qty')})"

_BARS = Both(
    f"SELECT symbol, ts, min({_TICK}).price AS open, max({_TICK}).price AS close, {_REST} FROM ticks GROUP BY symbol, ts",
    f"""SELECT symbol, ts, max(CASE WHEN up = 1 THEN price END) AS open, max(CASE WHEN down = 1 THEN price END) AS close, {_REST}
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY {_ORDER}) AS up,
          row_number() OVER (PARTITION BY symbol, ts ORDER BY {_ORDER.replace(",", " DESC,")} DESC) AS down FROM ticks) n GROUP BY symbol, ts""",
)

_FIELDS = ("open", "high", "low", "close", "volume", "tax", "discount", "traded")

#: Bars alone are dealt, by symbol; each is then spread over the bars of the calendar up to the symbol's next
#: one (the first: from the calendar's begin on, too), where only its own has values. So the grid has the
#: layout of windows along a symbol, and none of its empty cells is shuffled. The calendar goes to all tasks:
#: it has one row for each span, however many symbols there are.
_SPREAD = f"""SELECT /*+ BROADCAST(d) */ d.bar_idx, d.ts, e.symbol, {", ".join(f"CASE WHEN e.at = e.own AND e.symbol IS NOT NULL THEN e.{c} END AS {c}" for c in _FIELDS)}
  FROM (SELECT *, explode(CASE WHEN hi >= lo THEN sequence(lo, hi) END) AS at
    FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) = 1 THEN 0 ELSE own END AS lo,
            coalesce(lead(own) OVER (PARTITION BY symbol ORDER BY ts), n) - 1 AS hi
      FROM (SELECT /*+ BROADCAST(c) */ b.*, c.bar_idx AS own, (SELECT CAST(count(*) AS INT) FROM calendar) AS n FROM bars b LEFT JOIN calendar c ON c.ts = b.ts) p) q) e
  JOIN calendar d ON d.bar_idx = e.at"""

#: Calendar by symbols, with nulls where a symbol has no bar.
_GRID = [
    ("calendar", "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar_idx FROM (SELECT DISTINCT ts FROM bars) c"),
    (
        "grid",
        Both(
            _SPREAD,
            """SELECT c.bar_idx, c.ts, s.symbol, b.open, b.high, b.low, b.close, b.volume, b.tax, b.discount, b.traded
  FROM calendar c CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.ts = c.ts AND b.symbol = s.symbol""",
        ),
    ),
]


#: Bars of symbols with few ticks a bar: merging them before the exchange saves nothing, so the ticks are dealt by
#: symbol. Bars and what is spread from them need no further exchange, and only columns that a query reads move.
#: SHARES is the number of parts: with the bytes moved to go by, Spark would make few parts of many cells.
_DEALT_BARS = Both(_BARS.replace("FROM ticks", "FROM (SELECT /*+ REPARTITION(SHARES, symbol) */ * FROM ticks) t"), _BARS.duckdb)

#: Ticks of a part, so that the memory of a task stays the same on larger tables.
SHARE = 500_000


def shares(ticks: DataFrame) -> int:
    """Parts in which ticks are dealt: one for each core at least."""
    return max(ticks.sparkSession.sparkContext.defaultParallelism, -(-ticks.count() // SHARE))


def _panel(symbol: str, span: str, join: str = "", few: bool = False) -> list[tuple[str, str]]:
    steps = [("ticks", _TICKS.format(symbol=symbol, span=span, join=join)), ("bars", _BARS), *_GRID]
    if few:  # the calendar is that of the ticks: bars have one reader, and are not written
        own = {"bars": _DEALT_BARS, "calendar": Both(_GRID[0][1].replace("FROM bars", "FROM ticks"), _GRID[0][1])}
        steps = [(name, own.get(name, text)) for name, text in steps]
    return steps


#: The fixtures: weekly bars by brand, and ragged daily bars by supplier.
PANELS = {"w": _panel("p_brand", "week", "JOIN part ON p_partkey = l_partkey"), "d": _panel("CAST(l_suppkey AS VARCHAR(20))", "day", few=True)}

_READS = r"\b(FROM|JOIN)\s+(\w+)\b"
#: What makes a step worth writing when several others read it.
_WORK = re.compile(r"\bOVER\b|\bGROUP BY\b|\bDISTINCT\b|\bJOIN\b")


@dataclass(frozen=True)
class PanelQuery:
    """Named steps and a result that reads them."""

    steps: tuple[tuple[str, str], ...]
    result: str

    def needed(self) -> list[tuple[str, str]]:
        """The steps that the result stands on, in order."""
        wanted, out = {m[1] for m in re.findall(_READS, self.result)}, []
        for name, text in reversed(self.steps):
            if name in wanted:
                wanted |= {m[1] for m in re.findall(_READS, text)}
                out.append((name, text))
        return out[::-1]

    def duckdb(self) -> str:
        """One statement for DuckDB."""
        wanted, steps = {m[1] for m in re.findall(_READS, spoken(self.result, "duckdb"))}, []
        for name, text in reversed(self.steps):
            if name in wanted:
                said = spoken(text, "duckdb")
                wanted |= {m[1] for m in re.findall(_READS, said)}
                steps.append(f"{name} AS ({said})")
        return f"WITH RECURSIVE {', '.join(reversed(steps))}\n{spoken(self.result, 'duckdb')}"

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        steps = [(name, spoken(text, "spark")) for name, text in self.needed()]
        result = spoken(self.result, "spark")
        readers = Counter(m[1] for text in [*(t for _, t in steps), result] for m in re.findall(_READS, text))
        known: dict[str, DataFrame] = {}
        for name, text in steps:
            if "SHARES" in text:
                text = text.replace("SHARES", str(shares(known["ticks"])))
            df = bound(spark, sf_dir, text, known)
            known[name] = saved(df) if name != "ticks" and readers[name] > 1 and _WORK.search(text) else df
        return bound(spark, sf_dir, result, known)


def steps_sql(panel: str, steps: list[tuple[str, str]], result: str) -> PanelQuery:
    """A query over the steps of a panel and further (name, text) steps."""
    return PanelQuery((*PANELS[panel], *steps), result)


def bound(spark: SparkSession, sf_dir: str, sql: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run ``sql``, in which the names of steps and of tables of the folder are bound for this query alone."""
    known, used = known or {}, {}

    def bind(m: re.Match) -> str:
        name = m[2]
        if name in known:
            used[name] = known[name]
        elif name in TABLES:
            used[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            return m[0]
        return f"{m[1]} {{{name}}}"

    return spark.sql(re.sub(_READS, bind, sql), **used)


def run_query(spark: SparkSession, sf_dir: str, query: PanelQuery | str) -> DataFrame:
    return query.run(spark, sf_dir) if isinstance(query, PanelQuery) else bound(spark, sf_dir, spoken(query, "spark"))


def oracle(query: PanelQuery | str) -> str:
    return query.duckdb() if isinstance(query, PanelQuery) else spoken(query, "duckdb")
