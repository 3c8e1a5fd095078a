"""Walk-forward over a stream: every block of draws is tested on tickets from the draws before it, when it arrives."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sampling import RandomBaseline
from ..plans.backtest import BASELINE_SEED, cases_of
from ..plans.recommend import RecommendationEngine

BLOCK = "lottery string, split_id int, seen array<struct<number:int,count:long>>, draws array<struct<ord:long,draw_id:string,numbers:array<int>>>"


def _empty() -> dict:
    """A lottery's state: draws counted so far, number counts before the open block, that block, and draws that wait for the watermark."""
    return {"n": 0, "counts": {}, "block": [], "waiting": []}


class Blocks:
    """Takes draws whose time the watermark has passed, in the order of time and id; gives each full block with the counts before it."""

    def __init__(self, train_size: int, test_size: int) -> None:
        self.train_size, self.test_size = train_size, test_size

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else _empty()
        if not state.hasTimedOut:
            for pdf in batches:
                rows = zip((int(t.value // 1000) for t in pdf["time"]), pdf["draw_id"], pdf["numbers"])
                now["waiting"] += [[t, d, [int(x) for x in numbers]] for t, d, numbers in rows]
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted(w for w in now["waiting"] if w[0] < passed)
        now["waiting"] = [w for w in now["waiting"] if w[0] >= passed]
        out = [block for w in ready if (block := self.take(now, w))]
        state.update((json.dumps(now),))
        if now["waiting"]:
            state.setTimeoutTimestamp(max(min(w[0] for w in now["waiting"]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"lottery": key[0], **{c: [b[c] for b in out] for c in ("split_id", "seen", "draws")}})

    def take(self, now: dict, draw: list) -> dict | None:
        """Count a draw; the block that it fills."""
        _, name, numbers = draw
        at, now["n"] = now["n"], now["n"] + 1
        if at < self.train_size:
            self.count(now, numbers)
            return None
        now["block"].append({"ord": at, "draw_id": name, "numbers": numbers})
        if len(now["block"]) < self.test_size:
            return None
        seen = [{"number": int(k), "count": n} for k, n in sorted(now["counts"].items(), key=lambda x: int(x[0]))]
        full = {"split_id": (at + 1 - self.train_size) // self.test_size - 1, "seen": seen, "draws": now["block"]}
        for d in now["block"]:
            self.count(now, d["numbers"])
        now["block"] = []
        return full

    @staticmethod
    def count(now: dict, numbers: list[int]) -> None:
        for x in numbers:
            now["counts"][str(x)] = now["counts"].get(str(x), 0) + 1


@dataclass(frozen=True)
class StreamingBacktest:
    """The cases of ``Backtester.run`` from a stream of draws, one set of cases a lottery."""

    engine: RecommendationEngine = field(default_factory=RecommendationEngine)
    baseline: RandomBaseline = field(default_factory=RandomBaseline)

    def cases(self, draws: DataFrame, train_size: int, test_size: int = 1, ticket_count: int = 50, seed: int = 0, *, delay: str = "0 seconds") -> DataFrame:
        """The streaming cases, for the append mode: lottery and the columns of ``Backtester.run``.

        ``draws``: (lottery string, draw_id, numbers, time), a stream.  Draws wait in the
        state until the watermark, which is ``delay`` behind the largest time, has passed
        them, so those that come out of order by less are put in order; those that come
        later are dropped.  What is still waiting when a stream ends shows when a later
        draw arrives.  The state of a lottery is the counts of its numbers, the open block
        and the waiting draws; a lottery's draws are taken in their order, one task a
        lottery.  Only counting is Python; scores, tickets and matches are expressions
        behind it.  Draws without a
        time are dropped; a null lottery is a lottery.
        """
        for name, value in (("train_size", train_size), ("test_size", test_size), ("ticket_count", ticket_count)):
            if value <= 0:
                raise ValueError(f"{name} must be positive")
        timed = draws.select(F.col("lottery").cast("string").alias("lottery"), "draw_id", F.col("numbers").cast("array<int>").alias("numbers"), F.col("time").cast("timestamp").alias("time"))
        timed = timed.filter(F.col("time").isNotNull()).withWatermark("time", delay)
        blocks = timed.groupBy("lottery").applyInPandasWithState(Blocks(train_size, test_size), BLOCK, "state string", "append", GroupStateTimeout.EventTimeTimeout)
        tickets = self.engine.tickets_of(self.engine.candidates_of(F.col("seen")), ticket_count, F.lit(seed) + F.col("split_id"))
        # A list has ticket_count tickets; counting them would make them a second time.
        chosen = blocks.select("*", self.engine.chosen_of(tickets).alias("recommended"), F.lit(ticket_count).alias("generated"))
        chosen = chosen.withColumn("baseline", self.baseline.ticket_list(F.size("recommended"), F.lit(seed + BASELINE_SEED) + F.col("split_id")))
        each = chosen.select("lottery", "split_id", "generated", "recommended", "baseline", F.explode("draws").alias("_d")).select("*", "_d.*")
        return cases_of(each, train_size, test_size, "lottery")

