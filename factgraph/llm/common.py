"""Helpers that the corpus operators share: staged tables, bounded broadcasts, batches of whole groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import drop_staged, new_dir, staged  # noqa: F401  what the operators take from here

#: Bytes in one Arrow batch handed to Python. Texts may be very long, so batches are bounded by size.
BYTES_PER_BATCH = 8 << 20
#: Bytes of input (as stored) for each part that rows with texts are dealt into, and from where on a plan's size stands for "not known".
BYTES_PER_TASK, UNKNOWN = 64 << 20, 1 << 60


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short enough for very long texts; called by every operator that hands texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def partitions(df: DataFrame) -> int:
    """Into how many parts to deal rows that carry ``df``'s texts: the session's number, or one for each BYTES_PER_TASK of the tables that ``df`` reads, if that is more."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    stored = sum(n for n in sizes if n < UNKNOWN)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored // BYTES_PER_TASK))


def if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint for ``df``, given only once a count shows that it has at most ``max_rows`` rows.

    ``df`` should be staged or cheap, as it is counted here. Beyond the bound it is returned as it is, and joins with it shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names given: extra columns, whatever they are called, cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def whole_groups(batches: Iterable[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Batches of about ``rows`` rows in which no run of equal ``keys`` is cut; input is sorted by ``keys``.

    Memory is bounded by ``rows`` and the largest group, so callers bound their groups.
    """
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        last = np.ones(len(whole), dtype=bool)
        for k in keys:
            last &= (whole[k] == whole[k].iloc[-1]).to_numpy()
        cut = len(whole) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield whole.iloc[:cut].reset_index(drop=True)
        held = [whole.iloc[cut:].reset_index(drop=True)]
        n = len(held[0])
    if n:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def gathered(batches: Iterable[pd.DataFrame], rows: int, weight: str | None = None) -> Iterator[pd.DataFrame]:
    """The same rows in batches of at least ``rows``, but for the last: vectorised work pays only over many rows. A row that stands for many says so in ``weight``."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        held.append(b)
        n += int(b[weight].sum()) if weight else len(b)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def in_chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into consecutive chunks whose sizes add up to at most ``limit`` (a larger row is a chunk of its own)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)
