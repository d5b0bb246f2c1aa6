"""The hypothesis gauntlet: each strategy with its grid of settings must hold out of
sample, on random subsets of the symbols, and against the number of its trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import book, significance
from panelspark.operators.book import RATE, Steps, strategy_scores
from panelspark.plans.studies import STITCHED, TESTED, _values, carry_of, reversal_of, walk
from panelspark.sources.panels import PanelQuery, steps_sql
from panelspark.sources.shared import saved

#: Name and scores of each hypothesis; the third is directional.
HYPOTHESES: dict[str, tuple[str, ...]] = {
    "reversal": tuple(reversal_of(k) for k in (1, 4, 8)),
    "momentum": tuple(f"-({reversal_of(k)})" for k in (10, 20, 40)),
    "trend": tuple(f"sign(-({reversal_of(k)}))" for k in (10, 20, 40)),
    "carry": tuple(carry_of(k) for k in (1, 3, 8)),
}
PER = 3
_SETTINGS: dict[int, str] = {PER * h + i: x for h, grid in enumerate(HYPOTHESES.values()) for i, x in enumerate(grid)}
#: Funding counts for carry alone.
_FUNDING = f"CASE WHEN floor(run_id % 100 / {PER}) = 3 THEN {RATE} ELSE 0e0 END"
_TREND = f"floor(run_id % 100 / {PER}) = 2"


def _full() -> Steps:
    """``scored`` of all settings over the whole timeline."""
    return strategy_scores({k: x.replace("PARTITION BY slice, symbol", "PARTITION BY symbol") for k, x in _SETTINGS.items()})


def _booked(scored: Steps) -> Steps:
    return [*scored, *book.weights(directional=_TREND), *book.accounting(cost=0.0005, funding=_FUNDING), *book.performance()]


def _drawn(draws: int, size: int) -> Steps:
    """``scored`` of all settings on random subsets of the symbols: run_id is 100 x draw + setting."""
    *steps, (_, last) = _full()
    return [
        *steps,
        ("every_score", last),
        _values("draws", "id", [(k,) for k in range(1, draws + 1)]),
        ("picked", f"SELECT id, symbol FROM (SELECT id, symbol, row_number() OVER (PARTITION BY id ORDER BY md5(concat(id, '-', symbol))) AS k FROM draws CROSS JOIN (SELECT DISTINCT symbol FROM bars) n) q WHERE k <= {size}"),
        ("scored", "SELECT p.id * 100 + s.run_id AS run_id, s.bar_idx, s.ts, s.symbol, s.close, s.volume, s.score FROM every_score s JOIN picked p ON p.symbol = s.symbol"),
    ]


def gauntlet(spark: SparkSession, sf_dir: str, draws: int = 10, size: int = 12) -> DataFrame:
    """``hypothesis, setting, oos_sharpe, positive, psr, dsr, verdict``."""
    run = lambda q: saved(q.run(spark, sf_dir))
    returns = run(steps_sql("w", _booked(_full()), "SELECT run_id, r FROM bar_returns"))
    stats = significance.moments(returns).withColumn("config", F.floor(F.col("run_id") / PER))
    judged = significance.probabilistic(significance.deflated(stats, ("config",)))
    best = judged.groupBy("config").agg(F.max_by(F.struct("run_id", "psr", "dsr"), F.struct("sr", -F.col("run_id"))).alias("b")).select("config", "b.*")
    oos = run(PanelQuery(steps_sql("w", [*walk(grid=_SETTINGS, per=PER, weigh=book.weights(directional=_TREND), cost=0.0005, funding=_FUNDING), TESTED], "").steps, STITCHED))
    drawn = run(steps_sql("w", _booked(_drawn(draws, size)), "SELECT run_id % 100 AS setting, avg(CASE WHEN sharpe > 0 THEN 1e0 ELSE 0e0 END) AS positive FROM metrics GROUP BY run_id % 100"))
    names = spark.createDataFrame(list(enumerate(HYPOTHESES)), "config long, hypothesis string")
    out = best.join(names, "config").join(oos.select("config", "oos_sharpe"), "config").join(drawn, F.col("run_id") == F.col("setting"))
    # fixed values
    passed = F.expr("oos_sharpe > 0.5 AND positive > 0.65 AND dsr > 0.6")
    return out.select("hypothesis", "setting", F.round("oos_sharpe", 5).alias("oos_sharpe"), "positive", "psr", "dsr", F.when(passed, "PASS").when(F.col("oos_sharpe") > 0, "weak").otherwise("REJECT").alias("verdict"))


def queries() -> dict:
    return {"k13_gauntlet": gauntlet}
