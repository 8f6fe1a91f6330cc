"""Trust of articles and confidence of claims."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import domain_authority, heuristic_stance, net_confidence, rating_confidence, trust_tier
from ..functions.text import authority

#: Trusted hosts that are looked for at a time (some 10 MB that travel with each task): a longer list is looked for in as many parts.
HOSTS = 200_000


def domain_score_map(sources: DataFrame) -> DataFrame:
    """(host, score, position): score / 10 of each host; of one host's entries the last."""
    s = sources.select(authority(F.col("url")).alias("host"), (F.col("trust_score") / 10).alias("score"), "position").where("host <> ''")
    return s.groupBy("host").agg(F.max(F.struct("position", "score")).alias("m")).select("host", "m.score", "m.position")


def score_trust(articles: DataFrame, sources: DataFrame, match: str = "substring") -> DataFrame:
    """Articles with the trust of the host that their url holds, else 0.5; of several hosts the last in the list.

    ``match="registered_domain"`` compares the last two labels of hosts instead, by an equi-join.
    """
    hosts = domain_score_map(sources)
    if match == "registered_domain":
        two = lambda c: F.array_join(F.slice(F.split(c, r"\."), -2, 2), ".")
        domain = hosts.where(F.contains("host", F.lit("."))).groupBy(two(F.col("host")).alias("d")).agg(F.max_by("score", "position").alias("s"))
        key = F.when(F.contains(authority(F.col("url")), F.lit(".")), two(authority(F.col("url"))))
        return articles.withColumn("d", key).join(domain, "d", "left").withColumn("trust_score", F.coalesce("s", F.lit(0.5))).drop("d", "s")
    parts = -(-hosts.count() // HOSTS) or 1
    dealt = hosts.withColumn("part", F.pmod(F.xxhash64("host"), F.lit(parts)))
    out = articles.withColumn("__best", F.lit(None).cast(_BEST))
    for k in range(parts):
        rows = dealt.where(F.col("part") == k).select("host", "position", "score").collect()  # HOSTS rows or so
        out = out.withColumn("__found", _last_host([tuple(r) for r in rows])("url"))
        out = out.withColumn("__best", F.greatest("__best", F.when(F.col("__found.position").isNotNull(), F.col("__found")))).drop("__found")
    return out.withColumn("trust_score", F.coalesce("__best.score", F.lit(0.5))).drop("__best")


_BEST = "struct<position:bigint,score:double>"


def _last_host(hosts: list[tuple[str, int, float]]):
    """A function of urls: position and score of the last of the hosts in the list that a url holds, null where it holds none.

    Each task makes one automaton of all hosts and walks it once along every url, so its time is that of the urls' length.
    """

    def run(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for host, position, score in hosts:
            automaton.add_word(host, (position, score))
        if len(automaton):
            automaton.make_automaton()
        for part in urls:
            found = [max((best for _, best in automaton.iter(url)), default=(None, None)) if isinstance(url, str) and len(automaton) else (None, None) for url in part]
            yield pd.DataFrame(found, columns=["position", "score"]).astype({"position": "Int64", "score": "float64"})

    return F.pandas_udf(_BEST)(run)


def trust_tiers(articles: DataFrame) -> DataFrame:
    return articles.groupBy(trust_tier(F.col("trust_score")).alias("trust_tier")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("trust_tier"))


def top_evidence(evidence: DataFrame, k: int = 5) -> DataFrame:
    """The first k results of each claim."""
    w = Window.partitionBy("claim_id").orderBy("rank", "url")
    return evidence.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def score_claims(claims: DataFrame, evidence: DataFrame, fact_checks: DataFrame | None = None) -> DataFrame:
    """(claim_id, support, against, confidence): evidence weighed by its hosts' authority; a fact check decides alone."""
    e = evidence.select("claim_id", heuristic_stance(F.col("snippet")).alias("stance"), domain_authority(F.col("url")).alias("a"))
    side = lambda s: F.sum(F.when(F.col("stance") == s, F.col("a")).otherwise(0.0))
    sums = e.groupBy("claim_id").agg(side("SUPPORT").alias("support"), side("CONTRADICT").alias("against"))
    out = claims.select("claim_id").distinct().join(sums, "claim_id", "left").fillna(0.0, ["support", "against"])
    value = net_confidence(F.col("support"), F.col("against"))
    if fact_checks is not None:
        checks = fact_checks.groupBy("claim_id").agg(F.min("rating").alias("rating"))
        out = out.join(checks, "claim_id", "left")
        value = F.when(F.col("rating").isNotNull(), rating_confidence(F.col("rating"))).otherwise(value)
    return out.withColumn("confidence", F.round(value, 6)).select("claim_id", "support", "against", "confidence")
