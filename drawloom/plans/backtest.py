"""Walk-forward backtest of the engine against the uniform baseline, all splits in one job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.draws import WalkForward
from ..operators.sampling import RandomBaseline, fixed_seed
from ..schema import BacktestError, DatasetError
from ..storage import materialize
from .recommend import RecommendationEngine

#: Where the fields of a case are in its semi-structured value.
VARIANT_PATHS = {
    "ord": ("$.draw.ord", "long"), "train_size": ("$.split.train_size", "long"), "test_size": ("$.split.test_size", "long"),
    "generated_ticket_count": ("$.tickets.generated", "long"), "recommended_ticket_count": ("$.tickets.recommended", "long"),
    "test_draw_id": ("$.draw.draw_id", "string"), "best_match": ("$.matches[0].best", "long"), "total_matches": ("$.matches[0].total", "long"),
    "baseline_best_match": ("$.matches[1].best", "long"), "baseline_total_matches": ("$.matches[1].total", "long"),
}
#: Added to the seeds of the baseline.
BASELINE_SEED = 10_000


def cases_of(tested: DataFrame, train_size: int, test_size: int, *more: str) -> DataFrame:
    """The cases of rows (split_id, ord, draw_id, numbers, generated, recommended, baseline), one a test draw, and the columns of ``more``."""
    matches = {side: F.transform(side, lambda t: F.size(F.array_intersect(t, F.col("numbers")))) for side in ("recommended", "baseline")}
    best = {side: F.coalesce(F.array_max(m), F.lit(0)).cast("long") for side, m in matches.items()}
    total = {side: F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x) for side, m in matches.items()}
    return tested.select(
        *more, "split_id", "ord", (F.lit(train_size) + F.col("split_id") * test_size).cast("long").alias("train_size"),
        F.lit(test_size).cast("long").alias("test_size"), F.col("generated").cast("long").alias("generated_ticket_count"),
        F.size("recommended").cast("long").alias("recommended_ticket_count"), F.col("draw_id").alias("test_draw_id"),
        best["recommended"].alias("best_match"), total["recommended"].alias("total_matches"),
        best["baseline"].alias("baseline_best_match"), total["baseline"].alias("baseline_total_matches"),
    )


class BacktestResult:
    """The cases, one per test draw, and what they sum up to."""

    def __init__(self, cases: DataFrame, dataset_size: int | None = None) -> None:
        self.cases, self.dataset_size = cases, dataset_size

    def variants(self) -> DataFrame:
        """split_id, result: every case as a semi-structured value, from which ``from_variants`` makes the cases again."""
        pair = lambda a, b: F.struct(F.col(a).alias("best"), F.col(b).alias("total"))
        nested = F.struct(
            F.struct("ord", F.col("test_draw_id").alias("draw_id")).alias("draw"), F.struct("train_size", "test_size").alias("split"),
            F.struct(F.col("generated_ticket_count").alias("generated"), F.col("recommended_ticket_count").alias("recommended")).alias("tickets"),
            F.array(pair("best_match", "total_matches"), pair("baseline_best_match", "baseline_total_matches")).alias("matches"),
        )
        return self.cases.select("split_id", F.to_variant_object(nested).alias("result"))

    @classmethod
    def from_variants(cls, variants: DataFrame, dataset_size: int | None = None) -> BacktestResult:
        """The cases of (split_id, result), each field by its path; a missing or mistyped one is null."""
        fields = [F.try_variant_get("result", path, kind).alias(name) for name, (path, kind) in VARIANT_PATHS.items()]
        return cls(variants.select("split_id", *fields), dataset_size)

    def summary(self) -> DataFrame:
        """One row; an average is matches per case, and all values are 0 without cases."""
        zero = F.lit(0).cast("long")
        out = [F.count(F.lit(1)).alias("case_count")]
        for side in ("", "baseline_"):
            out += [F.coalesce(F.max(f"{side}best_match"), zero).alias(f"{side}best_match"), F.coalesce(F.sum(f"{side}total_matches"), zero).alias(f"{side}total_matches"), F.coalesce(F.sum(f"{side}total_matches").cast("double") / F.count(F.lit(1)), F.lit(0.0)).alias(f"{side}average_matches")]
        return self.cases.agg(*out)

    def at_least(self, *thresholds: int) -> DataFrame:
        """A row each: threshold (long), match_count, baseline_match_count, the cases whose best match reaches it.

        All thresholds in one pass over the cases.
        """
        if not thresholds or min(thresholds) <= 0:
            raise ValueError("threshold must be positive")
        reach = lambda c, t: F.count_if(F.col(c) >= t)
        rows = [F.struct(F.lit(t).cast("long"), F.lit(i)) for i, t in enumerate(thresholds)]
        counts = self.cases.agg(
            F.array(*(reach("best_match", t) for t in thresholds)).alias("_ours"),
            F.array(*(reach("baseline_best_match", t) for t in thresholds)).alias("_theirs"),
        )
        each = counts.select("_ours", "_theirs", F.explode(F.array(*rows)).alias("_t")).select("_ours", "_theirs", F.col("_t.col1").alias("threshold"), F.col("_t.col2").alias("_i"))
        return each.select("threshold", F.get("_ours", "_i").alias("match_count"), F.get("_theirs", "_i").alias("baseline_match_count"))

    def report(self) -> DataFrame:
        """The summary with the size of the dataset and the differences to the baseline."""
        return self.summary().select(F.lit(self.dataset_size).cast("long").alias("dataset_size"), "*", (F.col("average_matches") - F.col("baseline_average_matches")).alias("average_difference"), (F.col("total_matches") - F.col("baseline_total_matches")).alias("total_difference"))


@dataclass(frozen=True)
class Backtester:
    engine: RecommendationEngine = field(default_factory=RecommendationEngine)
    baseline: RandomBaseline = field(default_factory=RandomBaseline)

    def split_tickets(self, walk: WalkForward, ticket_count: int, seed: int | None, *, check: bool = True) -> DataFrame:
        """split_id, tickets, recommended, baseline: a row for each split, dealt by split."""
        base = fixed_seed(seed)
        # A split's counts are one array from here on.  Written once, as the check and the lists read them.
        seen = materialize(walk.train_lists(), "backtest-counts")
        if check:
            candidates = seen.select(self.engine.candidates_of(F.col("seen")).alias("candidates"))
            self.engine.generator.check_lists(candidates, F.col("candidates"))
        # Few bytes and much work: dealt out to as many tasks as asked for, whatever their size.
        dealt = seen.repartition(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), "split_id")
        dealt = dealt.select("split_id", self.engine.candidates_of(F.col("seen")).alias("candidates"))
        lists = self.engine.recommend_lists(dealt, ticket_count, F.lit(base) + F.col("split_id")).drop("candidates")
        return lists.withColumn("baseline", self.baseline.ticket_list(F.size("recommended"), F.lit(base + BASELINE_SEED) + F.col("split_id")))

    def run(self, draws: DataFrame, train_size: int, test_size: int = 1, ticket_count: int = 50, seed: int | None = None, *, check: bool = True, n: int | None = None) -> BacktestResult:
        """Cases: split_id, ord, test_draw_id, train_size, test_size, ticket counts, best and total matches of both sides."""
        for name, value in (("train_size", train_size), ("test_size", test_size), ("ticket_count", ticket_count)):
            if value <= 0:
                raise ValueError(f"{name} must be positive")
        try:
            walk = WalkForward(draws, train_size, test_size, n)
        except DatasetError as short:
            raise BacktestError(str(short)) from short
        tickets = self.split_tickets(walk, ticket_count, seed, check=check)
        # A list has ticket_count tickets; counting them would make them a second time.
        tickets = tickets.select("split_id", F.lit(ticket_count).alias("generated"), "recommended", "baseline")
        joined = walk.test_rows().select("split_id", "ord", "draw_id", "numbers").join(tickets, "split_id")
        return BacktestResult(materialize(cases_of(joined, train_size, test_size), "backtest-cases"), walk.n)
