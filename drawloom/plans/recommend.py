"""Statistics to scores to tickets to a diverse choice, for one set of draws or all splits at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import diverse_tickets, weighed, weighted_tickets
from ..operators.diversity import OptimizerConfig, TicketOptimizer
from ..operators.sampling import TicketGenerator
from ..operators.scoring import NumberPredictor
from ..schema import RecommendationError
from ..storage import materialize


@dataclass(frozen=True)
class RecommendationResult:
    """scores (number, score), generated and recommended (pos, ticket)."""

    scores: DataFrame
    generated: DataFrame
    recommended: DataFrame


@dataclass(frozen=True)
class RecommendationEngine:
    predictor: NumberPredictor = field(default_factory=NumberPredictor)
    generator: TicketGenerator = field(default_factory=TicketGenerator)
    optimizer: TicketOptimizer = field(default_factory=lambda: TicketOptimizer(OptimizerConfig(max_overlap=4, max_tickets=10)))

    def candidates_of(self, seen: Column) -> Column:
        """(number, weight) from an array of (number, count); an expression. Recency plays no part here."""
        return weighed(seen, float(self.predictor.frequency_weight), float(self.predictor.recency_weight))

    def tickets_of(self, candidates: Column, ticket_count: int, seed: Column) -> Column:
        """``ticket_count`` tickets from an array of (number, weight); an expression."""
        return weighted_tickets(candidates, seed, ticket_count, self.generator.main_number_count)

    def chosen_of(self, tickets: Column) -> Column:
        """The optimizer's choice from an array of tickets; an expression."""
        return diverse_tickets(tickets, self.optimizer.config.max_overlap, self.optimizer.config.max_tickets)

    def recommend_lists(self, candidates: DataFrame, ticket_count: int, seed: Column) -> DataFrame:
        """``candidates`` plus tickets and recommended for every row; candidates: one array of (number, weight) in each row."""
        made = candidates.withColumn("tickets", self.tickets_of(F.col("candidates"), ticket_count, seed))
        return made.withColumn("recommended", self.chosen_of(F.col("tickets")))

    def recommend(self, frequencies: DataFrame, ticket_count: int = 50, seed: int | None = None) -> RecommendationResult:
        """From (number, count); recency plays no part here.

        The tickets are rows from the generator to the optimizer, so their number is
        bounded by the cluster only; they are written once, as the check, the choice and
        the result read them.
        """
        if ticket_count <= 0:
            raise ValueError("ticket_count must be positive")
        scores = self.predictor.score_numbers(frequencies.select("number", "count"))
        made = self.generator.generate_tickets(scores, ticket_count, seed)
        generated = materialize(made.select(F.col("ticket_no").alias("pos"), "ticket"), "recommend-tickets")
        recommended = self.optimizer.optimize(generated)
        if recommended.isEmpty():
            raise RecommendationError("No tickets were recommended")
        return RecommendationResult(scores, generated, recommended)
