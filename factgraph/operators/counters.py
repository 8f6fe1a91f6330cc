"""Counters of a run, gathered while its tables are written.

Counts are observed in the stage that writes: there each task counts once, when it succeeds, whatever is lost and run
again before. No pass over the rows is made to count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import event_rows
from .tables import new_rows


def write_counted(df: DataFrame, path: str, drop: tuple[str, ...] = (), where: Column | None = None, mode: str = "overwrite", **counts: Column) -> dict[str, int]:
    """Write ``df`` to ``path`` and return the counts of rows for which each of ``counts`` holds, as they were when written.

    Rows for which ``where`` doesn't hold are counted and not written, nor are the columns ``drop``. ``df`` should end
    in the stage that writes: what comes after its last shuffle.
    """
    seen = Observation()
    rows = df.observe(seen, *[F.count_if(c).alias(name) for name, c in counts.items()])
    rows = rows if where is None else rows.where(where)
    rows.drop(*drop).write.mode(mode).parquet(path)
    return {name: int(seen.get[name] or 0) for name in counts}


def ingest_event_dump(spark: SparkSession, dump: str, target: DataFrame, folder: str, min_mentions: int = 10) -> dict[str, int]:
    """Read an event dump and write its articles that ``target`` (url) doesn't have yet to ``folder``/articles.

    Returns the rows ``read``, the ``malformed`` ones (too few fields or no number of mentions), those ``skipped`` as
    they have too few mentions, those of no http url (``other``), the ``known`` ones (their url is in the target or came
    before in the dump) and those ``inserted``. The first five are counted while the accepted rows are written, which
    no shuffle precedes; the last while the new articles are.
    """
    rows = event_rows(spark, dump)
    kind = F.when((F.col("n") < 50) | F.col("mentions").isNull(), "malformed").when(F.col("mentions") < min_mentions, "skipped").when(~F.coalesce(F.startswith("url", F.lit("http")), F.lit(False)), "other").otherwise("accepted")
    is_ = lambda k: F.col("kind") == k
    accepted = f"{folder}/accepted"
    counts = write_counted(rows.withColumn("kind", kind), accepted, ("kind", "n"), is_("accepted"), read=F.lit(True), malformed=is_("malformed"), skipped=is_("skipped"), other=is_("other"), accepted=is_("accepted"))
    taken = spark.read.schema("mentions int, url string").parquet(accepted)
    found = new_rows(target, taken, ["url"], [F.desc("mentions")])
    counts |= write_counted(found, f"{folder}/articles", inserted=F.lit(True))
    return counts | {"known": counts.pop("accepted") - counts["inserted"]}


def write_deduplicated(facts: DataFrame, judged: DataFrame, path: str) -> dict[str, int]:
    """Write the facts that ``judged`` (id, kept) keeps, and count the ``new`` and the ``duplicate`` ones meanwhile."""
    rows = facts.join(judged.withColumnRenamed("kept", "__kept"), "id")
    return write_counted(rows, path, ("__kept",), F.col("__kept"), new=F.col("__kept"), duplicate=~F.col("__kept"))


def write_contradictions(found: DataFrame, known: DataFrame, path: str) -> dict[str, int]:
    """Write contradicting pairs, and count all (``found``) and which of them were not known (``new``) and known before (``updated``)."""
    old = known.select("fact1_id", "fact2_id").distinct().withColumn("__old", F.lit(True))
    rows = found.join(old, ["fact1_id", "fact2_id"], "left")
    return write_counted(rows, path, ("__old",), found=F.lit(True), new=F.col("__old").isNull(), updated=F.col("__old").isNotNull())


def one_row(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """Counts as a table of one row."""
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"`{c}` long" for c in counts))
