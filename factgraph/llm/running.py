"""Running sums in an order, over keys of any size: a key with a third of all rows spans as many tasks as it needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df``, and one for each of ``sums`` (new name: column): the sum over the rows of the same key before this one in ``order``.

    The key and the columns that are summed are longs; ``keep`` holds them, and no column with nulls. Sums are modulo
    2**64. Rows are dealt by ranges of key and order, each task adds up its own rows, and only the key that a range starts
    with can go on from an earlier one: one row for each range goes to the driver and back.
    """
    spark, n = df.sparkSession, common.partitions(df)
    names, columns = list(sums), list(sums.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, at, carry, held = None, None, np.zeros(len(columns), dtype=np.uint64), None
        for b in batches:
            if not len(b):
                continue
            keys = b[key].to_numpy()
            first = keys[0] if first is None else first
            new = np.concatenate(([keys[0] != at], keys[1:] != keys[:-1]))
            segment = np.cumsum(new)
            start = np.flatnonzero(np.concatenate(([True], new[1:])))
            out = b.copy()
            ends = carry.copy()
            for c, (name, column) in enumerate(zip(names, columns)):
                x = b[column].to_numpy().astype(np.int64).view(np.uint64)
                total = np.cumsum(x, dtype=np.uint64)
                before = total - x
                base = before[start]
                if not new[0]:
                    base[0] -= carry[c]  # goes on from the batch before
                row = segment - segment[0]
                own = before - base[row]
                out[name] = own.view(np.int64)
                ends[c] = own[-1] + x[-1]
            at, carry = keys[-1], ends
            if held is not None:
                yield held.assign(__head=held[key].to_numpy() == first, __tail=False)
            held = out
        if held is not None:
            tail = np.zeros(len(held), dtype=bool)
            tail[-1] = True
            yield held.assign(__head=held[key].to_numpy() == first, __tail=tail)

    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "`__part` int", *(f"`{name}` long" for name in names), "`__head` boolean", "`__tail` boolean"])
    ranged = df.repartitionByRange(n, F.asc(key), *order).sortWithinPartitions(F.asc(key), *order).select(*keep, F.spark_partition_id().alias("__part"))
    local = common.staged(ranged.mapInPandas(run, kinds), "running")

    # a row for each range: its last key with that key's sums, and whether this is also its first key
    tails = sorted(local.where("__tail").select("__part", key, "__head", *names, *[F.col(c).alias(f"__of_{i}") for i, c in enumerate(columns)]).collect(), key=lambda r: r["__part"])
    heads = {r["__part"]: r[key] for r in local.where("__head").groupBy("__part").agg(F.first(key).alias(key)).collect()}
    at, carry, offsets = None, [0] * len(names), []
    for r in tails:
        if heads[r["__part"]] == at:
            offsets.append((r["__part"], *carry))
        ends = [r[name] + r[f"__of_{i}"] for i, name in enumerate(names)]
        goes_on = r["__head"] and r[key] == at
        carry = [_wrapped(e + (c if goes_on else 0)) for e, c in zip(ends, carry)]
        at = r[key]
    if not offsets:
        return local.drop("__part", "__head", "__tail")
    extra = spark.createDataFrame(offsets, ", ".join(["`__part` int", *(f"`__add_{i}` long" for i in range(len(names)))])).withColumn("__head", F.lit(True))
    joined = local.join(F.broadcast(extra), ["__part", "__head"], "left")  # a row for each range at most
    for i, name in enumerate(names):
        joined = joined.withColumn(name, wrapping_sum(F.col(name), F.coalesce(f"__add_{i}", F.lit(0).cast("long"))))
    return joined.drop("__part", "__head", "__tail", *[f"__add_{i}" for i in range(len(names))])


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def wrapping_sum(a: Column, b: Column) -> Column:
    """The sum of two longs modulo 2**64, in any mode of arithmetic."""
    wide = lambda c: c.cast("decimal(20,0)")
    half, whole = F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    return (F.pmod(wide(a) + wide(b) + half, whole) - half).cast("long")
