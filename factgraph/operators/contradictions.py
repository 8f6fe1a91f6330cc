"""Contradicting pairs of facts: candidates, scoring, threshold, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gates import baseline_facts, facts_to_check
from .hooks import Batch, pair_texts, score_nli
from .similarity import band_candidates, cross_candidates
from .tables import upsert_contradictions


def detect(facts: DataFrame, articles: DataFrame, now: str, candidates: str = "band", low: float = 0.05, high: float = 0.3, least: float = 0.7, known: DataFrame | None = None, model: Batch | None = None, backfill: bool = False, days_back: int | None = None) -> DataFrame:
    """(fact1_id, fact2_id, contradiction_score, detected_at, updated_at, detection_method) of pairs that score above ``least``.

    ``candidates``: "band" pairs each fact to check with its near originals, "cross" with the trusted baseline of at most 500.
    """
    check = facts_to_check(facts, articles, now, backfill, days_back)
    if candidates == "cross":
        pairs = cross_candidates(check, baseline_facts(facts, articles, now))
    else:
        pairs = band_candidates(facts, check, low, high).select(F.col("id").alias("fact1_id"), F.col("neighbor_id").alias("fact2_id"))
    scored = score_nli(pair_texts(pairs, facts), model).where(F.col("contradiction_score") > least)
    at = F.lit(now).cast("timestamp")
    found = scored.groupBy(F.least("fact1_id", "fact2_id").alias("fact1_id"), F.greatest("fact1_id", "fact2_id").alias("fact2_id")).agg(F.max("contradiction_score").alias("contradiction_score")).withColumns({"detected_at": at, "updated_at": at, "detection_method": F.lit(candidates)})
    return found if known is None else upsert_contradictions(known, found)
