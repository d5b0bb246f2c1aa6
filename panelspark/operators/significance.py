"""Significance of Sharpe ratios: probabilistic and deflated.

Moments are one aggregate over the bar returns of all runs. The normal
distribution, which Spark SQL lacks, is the sum of a series of positive terms,
and its inverse the end of Newton's steps from 0, which approach it from one
side; both are expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import book
from panelspark.sources.panels import steps_sql

#: The Euler-Mascheroni constant (a fixed value).
GAMMA = 0.5772156649015329
#: Terms of the series (enough up to 8, where nothing is left of the other side) and steps of the inverse.
TERMS, STEPS, FAR = 250, 60, 8
_DENSITY = f"exp(-{{0}} * {{0}} / 2) / {math.sqrt(2 * math.pi)!r}"


def normal_cdf(x: str) -> str:
    """The normal distribution function of an SQL expression (or lambda variable)."""
    term = f"a.t * ({x}) * ({x}) / (2 * k + 1)"
    series = f"aggregate(sequence(1, {TERMS}), named_struct('t', {x}, 's', {x}), (a, k) -> named_struct('t', {term}, 's', a.s + {term}), a -> a.s)"
    return f"CASE WHEN {x} > {FAR} THEN 1e0 WHEN {x} < -{FAR} THEN 0e0 ELSE 5e-1 + {_DENSITY.format(f'({x})')} * {series} END"


def normal_quantile(p: str) -> str:
    """The inverse of :func:`normal_cdf`, of an SQL expression; null outside (0, 1)."""
    newton = f"aggregate(sequence(1, {STEPS}), 0e0, (z, i) -> z - ({normal_cdf('z')} - ({p})) / ({_DENSITY.format('z')}))"
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN {newton} END"


def moments(returns: DataFrame) -> DataFrame:
    """``run_id, n, sr, skew, kurt`` of ``(run_id, r)``: powers over the sample deviation.
    Runs with fewer than three returns, or constant ones, have null moments."""
    known = returns.where("r IS NOT NULL")
    stats = known.groupBy("run_id").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    stats = stats.selectExpr("run_id", "n", "mean", "CASE WHEN n >= 3 AND sd > 1e-15 THEN sd END AS sd")
    z = F.expr("(r - mean) / sd")
    return known.join(stats, "run_id").groupBy("run_id", "n").agg(F.first(F.expr("mean / sd")).alias("sr"), F.avg(z * z * z).alias("skew"), F.avg(z * z * z * z).alias("kurt"))


def probabilistic(stats: DataFrame, benchmark: str = "0.0") -> DataFrame:
    """Adds ``psr``: the chance that the true ratio exceeds ``benchmark`` (an SQL expression)."""
    z = f"(sr - ({benchmark})) * sqrt(n - 1) / nullif(sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 0)), 0)"
    return stats.withColumn("psr", F.expr(z)).withColumn("psr", F.expr(normal_cdf("psr")))


def deflated(stats: DataFrame, study: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``dsr`` of each run against the best ratio to expect of so many trials
    with no edge; the trials are the runs of the same ``study`` columns."""
    trials = stats.groupBy(*study).agg(F.count("sr").alias("n_trials"), F.var_samp("sr").alias("v"))
    chances = trials.withColumns({"p1": F.expr("1 - 1e0 / nullif(n_trials, 0)"), "p2": F.expr(f"1 - 1e0 / nullif(n_trials * {math.e!r}, 0)")})
    expected = chances.withColumns({"z1": F.expr(normal_quantile("p1")), "z2": F.expr(normal_quantile("p2"))}).selectExpr(*study, f"CASE WHEN n_trials >= 2 AND v > 0 THEN sqrt(v) * ({1 - GAMMA} * z1 + {GAMMA} * z2) ELSE 0.0 END AS expected_sr")
    joined = stats.join(expected, list(study)) if study else stats.crossJoin(F.broadcast(expected))  # one row
    return probabilistic(joined, "expected_sr").withColumnRenamed("psr", "dsr")


_STEPS = [*book.scores((1, 2, 4, 8, 20)), *book.weights(), *book.accounting(), *book.performance()]
_FIGURES = ["run_id", "n", *(f"round({c}, 8) AS {c}" for c in ("sr", "skew", "kurt"))]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(steps_sql("w", _STEPS, "SELECT run_id, r FROM bar_returns").run(spark, sf_dir))


def queries() -> dict:
    return {
        "k08_probabilistic_sharpe": lambda spark, sf_dir: probabilistic(_runs(spark, sf_dir)).selectExpr(*_FIGURES, "round(psr, 8) AS psr"),
        "k09_deflated_sharpe": lambda spark, sf_dir: deflated(_runs(spark, sf_dir)).selectExpr(*_FIGURES, "round(expected_sr, 8) AS expected_sr", "round(dsr, 8) AS dsr"),
    }


def _cdf_sql(x: str) -> str:
    """The oracle's: each term of the series by its logarithm."""
    odd = "coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln(2 * j + 1))), 0)"
    series = f"list_sum(list_transform(range(0, {TERMS}), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - {odd})))"
    return f"CASE WHEN {x} > {FAR} THEN 1e0 WHEN {x} < -{FAR} THEN 0e0 ELSE 5e-1 + sign({x}) * {_DENSITY.format(f'({x})')} * {series} END"


def _quantile_sql(p: str) -> str:
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN list_reduce(list_transform(range(0, {STEPS} + 1), lambda i: 0e0), lambda z, i: z - ({_cdf_sql('z')} - ({p})) / ({_DENSITY.format('z')})) END"


def oracle_sql() -> dict[str, str]:
    spread = "nullif(sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 0)), 0)"
    stats = [
        ("sized", "SELECT run_id, r, count(r) OVER (PARTITION BY run_id) AS n, avg(r) OVER (PARTITION BY run_id) AS mean, stddev_samp(r) OVER (PARTITION BY run_id) AS sd0 FROM bar_returns WHERE r IS NOT NULL"),
        ("scaled", "SELECT *, CASE WHEN n >= 3 AND sd0 > 1e-15 THEN sd0 END AS sd FROM sized"),
        ("stats", "SELECT run_id, n, max(mean / sd) AS sr, avg(power((r - mean) / sd, 3)) AS skew, avg(power((r - mean) / sd, 4)) AS kurt FROM scaled GROUP BY run_id, n"),
        ("trials", f"SELECT sqrt(var_samp(sr)) AS v, 1 - 1e0 / count(sr) AS p1, 1 - 1e0 / (count(sr) * {math.e!r}) AS p2 FROM stats"),
        ("expected", f"SELECT CASE WHEN v > 0 THEN v * ({1 - GAMMA!r} * {_quantile_sql('p1')} + {GAMMA!r} * {_quantile_sql('p2')}) ELSE 0e0 END AS expected_sr FROM trials"),
        ("placed_stats", f"SELECT *, sr * sqrt(n - 1) / {spread} AS z0, (sr - expected_sr) * sqrt(n - 1) / {spread} AS z1 FROM stats CROSS JOIN expected"),
    ]
    made = lambda result: steps_sql("w", [*_STEPS, *stats], result).duckdb()
    return {
        "k08_probabilistic_sharpe": made(f"SELECT {', '.join(_FIGURES)}, round({_cdf_sql('z0')}, 8) AS psr FROM placed_stats"),
        "k09_deflated_sharpe": made(f"SELECT {', '.join(_FIGURES)}, round(expected_sr, 8) AS expected_sr, round({_cdf_sql('z1')}, 8) AS dsr FROM placed_stats"),
    }
