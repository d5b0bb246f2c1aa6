"""Streams with a state for each account, in Spark's state store.

A batch reads and writes the state of its own accounts alone, and a restart
goes on from the checkpoint. The store is RocksDB, so state may be larger than
memory; a task holds one account's updates of one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelspark.sources.shared import new_path, ship

MARKS = "account string, at long, growth double, turnover double, equity double"
CASH, COST = 10_000.0, 0.001
#: What an account goes through in a call, as one row: a row for each would take most of a task's time.
_STEPS = "account string, since array<int>, step array<int>, n array<long>"
#: Days without an update from which an account has a status (fixed values).
LADDER = ((8, "STALE"), (30, "CRITICAL"), (46, "BROKEN"))
_DAY_MS = 86_400_000
_EPOCH = date(1970, 1, 1)
_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Account(StatefulProcessor):
    """An account's prices and weights by symbol, its equity, and its newest update."""

    def __init__(self, cash: float, cost: float):
        self.cash, self.cost = cash, cost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "symbol string", "price double, weight double")
        self.now = handle.getValueState("now", "equity double, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        equity, last = self.now.get() if self.now.exists() else (self.cash, None)
        times: dict[int, dict] = {}
        for r in rows:
            if r.price is not None and r.price > 0 and r.at is not None and (last is None or r.at > last):
                of, new = times.setdefault(r.at, {}), (r.price, r.weight or 0.0)
                of[r.symbol] = min(of.get(r.symbol, new), new)
        known: dict[str | None, tuple[float | None, float]] = {}
        for at in sorted(times):
            growth = turnover = 0.0
            for symbol, (price, weight) in times[at].items():
                if symbol not in known:
                    known[symbol] = tuple(self.held.getValue((symbol,))) if self.held.containsKey((symbol,)) else (None, 0.0)
                price0, weight0 = known[symbol]
                growth += weight0 * (price / price0 - 1) if price0 else 0.0
                turnover += abs(weight - weight0)
                known[symbol] = (price, weight)
            equity *= max((1 + growth) * (1 - self.cost * turnover), 0.0)
            yield Row(account=key[0], at=at, growth=growth, turnover=turnover, equity=equity)
        if times:
            for symbol, state in known.items():
                self.held.updateValue((symbol,), state)
            self.now.update((equity, max(times)))

    def close(self) -> None:
        pass


def accounts(updates: DataFrame, cash: float = CASH, cost: float = COST) -> DataFrame:
    """A stream of ``(account, at, symbol, price, weight)`` updates to marks.

    At each update an account earns on the weights it set before, for the symbols
    that have new prices, and pays for the change of their weights; an account
    that lost all stays at 0. Updates of one batch may come in any order. One
    that is no newer than the account's last of an earlier batch is no news and
    changes nothing; of updates of one symbol at the same time, the lowest price
    and weight count."""
    return updates.groupBy("account").transformWithState(_Account(cash, cost), MARKS, "Append", "None")


class _Watch(StatefulProcessor):
    """An account's newest day, number of updates and next step; a timer for that step."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "day int, n long, step int")

    def _due(self, day: int, step: int) -> int:
        return (day + LADDER[step][0]) * _DAY_MS - 1

    def _row(self, key: tuple, steps: list[tuple[int, int, int]]) -> Row:
        """The days, numbers of statuses (0: OK, then those of the ladder) and numbers of updates."""
        since, step, n = zip(*steps, strict=True)
        return Row(account=key[0], since=list(since), step=list(step), n=list(n))

    def _arm(self, day: int, n: int, step: int) -> None:
        self.now.update((day, n, step))
        if step < len(LADDER):
            self.handle.registerTimer(self._due(day, step))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        before = self.now.get()
        before = tuple(before) if before is not None else None
        day, n, step = before or (None, 0, 0)
        steps: list[tuple[int, int, int]] = []
        for new in sorted({(r.day - _EPOCH).days for r in rows if r.day is not None}):
            if day is not None and new <= day:
                continue
            for k in range(step, len(LADDER)) if day is not None else ():  # what it went through in between
                if day + LADDER[k][0] < new:
                    steps.append((day + LADDER[k][0], k + 1, n))
            day, n, step = new, n + 1, 0
            steps.append((day, 0, n))
        if (day, n, step) != before and day is not None:
            if before and before[2] < len(LADDER):
                self.handle.deleteTimer(self._due(before[0], before[2]))
            self._arm(day, n, step)
        if steps:
            yield self._row(key, steps)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        day, n, step = self.now.get()
        if step == len(LADDER) or expiredTimerInfo.getExpiryTimeInMs() != self._due(day, step):
            return
        now, steps = timerValues.getCurrentWatermarkInMs(), []
        while step < len(LADDER) and self._due(day, step) < now:  # all that is due: a timer set here fires in a later batch
            steps.append((day + LADDER[step][0], step + 1, n))
            step += 1
        self._arm(day, n, step)
        if steps:
            yield self._row(key, steps)

    def close(self) -> None:
        pass


def watched(updates: DataFrame, late: str = "0 days") -> DataFrame:
    """A stream of ``(account, ts)`` updates to the statuses of each account and the
    day ``since`` when it has them: OK at each day with an update, and without
    one STALE, CRITICAL and BROKEN by timers in event time, which fire when the
    newest update of any account, less ``late``, has reached their day."""
    rows = updates.withWatermark("ts", late).selectExpr("account", "CAST(ts AS DATE) AS day", "ts")
    steps = rows.groupBy("account").transformWithState(_Watch(), _STEPS, "Append", "EventTime")
    names = ", ".join(repr(s) for s in ("OK", *(s for _, s in LADDER)))
    each = steps.selectExpr("account", "inline(arrays_zip(since, step, n))")
    return each.selectExpr("account", "date_add(DATE '1970-01-01', since) AS since", f"element_at(array({names}), step + 1) AS status", "n AS n_updates")


def finished(spark: SparkSession, stream: DataFrame, path: str | None = None) -> DataFrame:
    """All rows that ``stream`` gives for the input that is there now, as a table in the
    shared folder. With the ``path`` of an earlier run it goes on from there."""
    path = path or new_path(spark, "stream")
    ship(spark)
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(path)
