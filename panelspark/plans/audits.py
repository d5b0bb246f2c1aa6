"""Audits of all registered alphas: one plan evaluates many worlds.

A *world* is a panel of its own, real or altered. It is a key in every
partition of the formulas, so the alphas of all worlds are one batch of layouts
by symbol and by bar, as those of one world are.
"""

from __future__ import annotations

import re

from panelspark.functions.vocabulary import Formula, digits
from panelspark.operators import book
from panelspark.operators.book import Steps, unpivot
from panelspark.plans import alphas
from panelspark.sources.panels import PanelQuery, steps_sql

#: Bars after which a world is spoiled (fixed values).
CUTS = (150, 250, 330)
DRAWS = 3
FIELDS = ("open", "high", "low", "close", "volume")


def in_worlds(steps: Steps) -> Steps:
    """Steps of a formula, each world by itself."""
    return [(name, re.sub(r"PARTITION BY (symbol|bar_idx)\b", r"PARTITION BY world, \1", text)) for name, text in steps]


def _all_alphas() -> tuple[Formula, dict[int, str]]:
    g, columns = Formula(), {}
    for k, a in enumerate(alphas.ALPHAS.values(), 1):
        columns[k] = f"CASE WHEN bar_idx >= {a.warmup} THEN {g.finite(a.build(g))} END"
    return g, columns


def causality(cuts: tuple[int, ...] = CUTS) -> tuple[Steps, str]:
    """For each alpha and cut, the cells that move when all bars after the cut are
    spoiled: none up to the cut (a formula that looks ahead moves some), and after
    it those that the data reach. World 0 is the real one."""
    noise = "((bar_idx * 7 + {} * 5 + length(symbol) * 3 + ascii(substring(symbol, length(symbol), 1))) % 11) / 10e0"
    spoiled = ", ".join(f"CASE WHEN bar_idx > cut THEN {x} * (1 + {noise.format(i)}) ELSE {x} END AS {x}" for i, x in enumerate(FIELDS))
    worlds = ", ".join(f"({i}, {c})" for i, c in enumerate((10**9, *cuts)))
    g, columns = _all_alphas()
    steps, last = g.steps("world_grid")
    wide = f"SELECT world, cut, bar_idx, symbol, {', '.join(f'{x} AS s{k}' for k, x in columns.items())} FROM {last}"
    pivoted = ", ".join(f"max(CASE WHEN world = {i} THEN score END) AS v{i}" for i in range(len(cuts) + 1))
    moved = " UNION ALL ".join(f"SELECT run_id, {c} AS cut, bar_idx, CASE WHEN {digits('v0', 9)} IS DISTINCT FROM {digits(f'v{i}', 9)} THEN 1 ELSE 0 END AS moved FROM by_cell" for i, c in enumerate(cuts, 1))
    names = ", ".join(f"({k}, '{a}')" for k, a in enumerate(alphas.ALPHAS, 1))
    return [
        ("worlds", f"SELECT * FROM (VALUES {worlds}) AS v(world, cut)"),
        ("world_grid", f"SELECT world, cut, bar_idx, symbol, {spoiled} FROM grid CROSS JOIN worlds"),
        *in_worlds(steps),
        ("wide", wide),
        ("long_scores", unpivot("wide", "world, bar_idx, symbol", {k: f"s{k} * 1e0" for k in columns})),
        ("by_cell", f"SELECT run_id, bar_idx, symbol, {pivoted} FROM long_scores GROUP BY run_id, bar_idx, symbol"),
        ("moves", moved),
        ("names", f"SELECT * FROM (VALUES {names}) AS v(run_id, alpha)"),
    ], "SELECT n.alpha, m.cut, sum(CASE WHEN m.bar_idx <= m.cut THEN m.moved ELSE 0 END) AS past_moved, max(CASE WHEN m.bar_idx > m.cut THEN m.moved ELSE 0 END) AS future_moved FROM moves m JOIN names n ON n.run_id = m.run_id GROUP BY n.alpha, m.cut"


def null_control(draws: int = DRAWS) -> tuple[Steps, str]:
    """Verdicts of all alphas on following returns that are dealt out anew in each
    bar, each symbol's to any of them by hash, so nothing can be forecast and each
    verdict but ``dead`` is a false positive."""
    g, columns = _all_alphas()
    fields = ("bar_idx", "symbol", *FIELDS, "fwd")
    steps, last = g.steps("ahead_grid", fields, ["fwd", *columns.values()])
    place = lambda k: f"row_number() OVER (PARTITION BY bar_idx ORDER BY md5(concat(symbol, '-', bar_idx, '-', '{k}')), symbol)"
    kept = ", ".join(f"s{k}" for k in columns)
    return [
        ("ahead_grid", f"SELECT *, {book.AHEAD.format(1, '')} FROM grid"),
        *steps,
        ("drawn", f"SELECT bar_idx, fwd, {', '.join(f'{x} AS s{k}' for k, x in columns.items())}, {place('from')} AS q, {', '.join(f'{place(k)} AS p{k}' for k in range(draws))} FROM {last}"),
        ("places", unpivot("drawn", f"bar_idx, {kept}", {k: f"p{k}" for k in range(draws)}, "place", "draw")),
        ("dealt", f"SELECT p.bar_idx, p.draw, d.fwd, {', '.join(f'p.s{k}' for k in columns)} FROM places p JOIN drawn d ON d.bar_idx = p.bar_idx AND d.q = p.place"),
        ("scored", unpivot("dealt", "bar_idx, fwd", {f"{k} * 10 + draw": f"s{k} * 1e0" for k in columns})),
        *book._ic(known=True),
    ], "SELECT run_id % 10 AS draw, count(*) AS n_alphas, sum(CASE WHEN verdict = 'alive' THEN 1 ELSE 0 END) AS n_alive, sum(CASE WHEN verdict = 'reversed' THEN 1 ELSE 0 END) AS n_reversed, round(max(abs(mean_ic)), 5) AS worst_ic FROM verdicts WHERE n > 0 GROUP BY run_id % 10"


def all_sql() -> dict[str, PanelQuery]:
    return {"f09_null_of_all": steps_sql("w", *null_control()), "f10_causality_of_all": steps_sql("w", *causality())}
