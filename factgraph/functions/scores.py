"""Scores, tiers and stances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of high and of low authority, and words that show a stance.
HIGH_AUTHORITY = [".gov", ".edu", "reuters.com", "apnews.com", "bbc.com", "snopes.com", "politifact.com", "who.int", "nasa.gov"]
LOW_AUTHORITY = ["twitter.com", "facebook.com", "instagram.com", "tiktok.com", "youtube.com"]
AGAINST = ["false", "hoax", "debunked", "incorrect", "lie", "myth", "refutes", "baseless", "scam"]
IN_FAVOUR = ["confirms", "verified", "true", "accurate", "evidence", "proven", "backs up"]


def holds_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def domain_authority(url: Column) -> Column:
    return F.when(holds_any(url, HIGH_AUTHORITY), 1.0).when(holds_any(url, LOW_AUTHORITY), 0.2).otherwise(0.5)


def heuristic_stance(snippet: Column) -> Column:
    """Words against win over words in favour; they may stand inside other words."""
    low = F.lower(snippet)
    return F.when(snippet.isNull() | (F.length(snippet) < 10), "NEUTRAL").when(holds_any(low, AGAINST), "CONTRADICT").when(holds_any(low, IN_FAVOUR), "SUPPORT").otherwise("NEUTRAL")


def stance_from_scores(label: Column, score: Column, least: float = 0.6) -> Column:
    return F.when(score.isNull() | (score < least), "NEUTRAL").when(F.lower(label) == "contradiction", "CONTRADICT").when(F.lower(label) == "entailment", "SUPPORT").otherwise("NEUTRAL")


def rating_stance(rating: Column) -> Column:
    return F.when(F.contains(rating, F.lit("False")), "CONTRADICT").otherwise("SUPPORT")


def rating_confidence(rating: Column) -> Column:
    return F.when(F.contains(rating, F.lit("False")), 0.05).otherwise(0.95)


def verdict_band(confidence: Column) -> Column:
    return F.when(confidence > 0.7, "VERIFIED TRUE").when(confidence > 0.4, "DEBATED").otherwise("FALSE / UNPROVEN")


def truthrank(confidence: Column) -> Column:
    """Boosts of confident facts: 1.2 above 0.8, and 1.5 more above 0.9."""
    return F.when(confidence > 0.8, 1.2).otherwise(1.0) * F.when(confidence > 0.9, 1.5).otherwise(1.0)


def trust_tier(score: Column) -> Column:
    return F.when(score >= 0.9, "High (0.9-1.0)").when(score >= 0.7, "Medium (0.7-0.9)").when(score >= 0.5, "Low (0.5-0.7)").otherwise("Unknown (<0.5)")


def percent_text(c: Column) -> Column:
    return F.format_string("%.1f", c * 100)


def net_confidence(support: Column, against: Column) -> Column:
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.lit(0.5) + F.lit(0.2) * (support - against)))
