"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textkit

#: Labelled rows that a fit uses at most (about; chosen by a hash of the id): the bound on what a fit reads and broadcasts.
MAX_TRAIN = 40_000
#: Share of the fitting sample that calibrates scores instead.
CALIBRATE = 0.25
#: Random Fourier features.
FEATURES = 192
RIDGE = 1e-2
#: Bytes of text handled at a time in a task.
CHUNK = 1 << 21

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _MARK, _SYMBOL, _HIGH = range(9)


def _kinds() -> np.ndarray:
    kind = np.full(256, _SYMBOL, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
    kind[[32, 9, 11, 12, 13]], kind[10] = _SPACE, _LINE
    kind[[ord(c) for c in ".,"]], kind[[ord(c) for c in "!?;:'\"()-"]] = _STOP, _MARK
    return kind


KIND = _kinds()
STATISTICS = ["log_bytes", "log_words", "word_length", "word_length_spread", "lower", "upper", "digit", "line", "stop", "mark", "symbol", "high", "symbol_words", "upper_words", "long_words", "distinct_words", "distinct_lines", "line_length", "top_word"]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of numbers per text, in the order of STATISTICS; an empty text has zeros."""
    n = len(texts)
    if not n:
        return np.zeros((0, len(STATISTICS)))
    names, begin, end, starts, buffer, at = textkit.words(texts, lower=True)
    kind = KIND[buffer]
    length = np.diff(at) - 1.0  # without the space that parts texts
    size = np.maximum(length, 1)
    share = [np.add.reduceat((kind == k).astype(np.int32), at[:-1]) / size for k in range(9)]
    count = np.diff(starts)
    words = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)
    chars = (end - begin).astype(float)
    total = lambda x: np.bincount(of, weights=x, minlength=n)
    mean = total(chars) / words
    spread = np.sqrt(np.maximum(total(chars**2) / words - mean**2, 0))
    sums = np.zeros((2, len(buffer) + 1), dtype=np.int32)
    np.cumsum(kind == _SYMBOL, out=sums[0, 1:])
    np.cumsum(kind == _UPPER, out=sums[1, 1:])
    within = sums[:, end] - sums[:, begin]
    order = np.lexsort((names, of))
    new = np.concatenate(([True], (names[order][1:] != names[order][:-1]) | (of[order][1:] != of[order][:-1])))[: len(order)]
    distinct = np.bincount(of[order][new], minlength=n)
    first = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, of[order][first], np.diff(np.append(first, len(order))))
    lines = [t.split(b"\n") for t in texts]
    return np.nan_to_num(np.stack([
        np.log1p(length), np.log1p(count), mean, spread, share[_LOWER], share[_UPPER], share[_DIGIT], share[_LINE], share[_STOP], share[_MARK], share[_SYMBOL], share[_HIGH],
        total(within[0] > 0) / words, total(within[1] >= 2) / words, total(chars > 24) / words, distinct / words**0.75,
        np.array([len(set(x)) / len(x) for x in lines]), np.log1p(length / np.array([len(x) for x in lines])), top / words,
    ], axis=1))


@dataclass
class Model:
    """A fitted classifier; ``score`` maps texts to the calibrated chance of label 1."""

    centre: np.ndarray
    scale: np.ndarray
    wave: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """A bias, the statistics, and cosines that approximate a Gaussian kernel over them."""
        x = np.clip((stats - self.centre) / self.scale, -5, 5)
        return np.hstack([np.ones((len(x), 1)), x, np.sqrt(2 / len(self.phase)) * np.cos(x @ self.wave + self.phase)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.clip(np.interp(self.raw(statistics(texts)), self.knots, self.values), 0, 1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of labels to scores: each pool's mean score and mean label."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # label sum, score sum, number
    for s, y in zip(score[order], label[order].astype(float)):
        pools.append([y, s, 1.0])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            y2, s2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + s2, pools[-1][2] + n2]
    return np.array([p[1] / p[2] for p in pools]), np.array([p[0] / p[2] for p in pools])


def _blocks(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    texts = [(t or "").encode("utf-8", "replace") for t in b["text"]]
    for i, j in common.in_chunks(np.array([len(t) for t in texts]), CHUNK):
        yield b.iloc[i:j], texts[i:j]


def held_out(id_: F.Column, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id is never held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 7) -> Model:
    """Fit on at most about ``max_train`` labelled rows, chosen by a hash of the id.

    The sampled labels are broadcast to the documents, so no text shuffles. Normal equations are sums over
    partitions: each task adds up its rows' products, Spark adds the tasks', and the driver solves a system of
    fixed size. The calibration part, a few thousand numbers, is pooled on the driver.
    Rows with a null id, label or a label other than 0 and 1 are left out; of rows that repeat an id all count. A null
    text counts as empty.
    """
    common.short_batches(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id is not null and y in (0, 1)")
    n = known.count()
    keep = min(1.0, 0.95 * max_train / max(n, 1))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    sample = common.staged(known.where(draw < keep), "labels")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    stats_type = "id " + slim.schema["id"].dataType.simpleString() + ", y double, x array<double>"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, texts in _blocks(b):
                yield pd.DataFrame({"id": part["id"], "y": part["y"], "x": list(statistics(texts))})

    rows = common.staged(slim.join(common.if_small(sample, 2 * max_train), "id").mapInPandas(measure, stats_type), "statistics")
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1000)) < int(1000 * CALIBRATE))
    d = len(STATISTICS)
    moments = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[f(F.get("x", i)).alias(f"{k}{i}") for k, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(d)]).first()
    rng = np.random.default_rng(seed)
    wave, phase = rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)
    if not moments["n"]:
        return Model(np.zeros(d), np.ones(d), wave, phase, np.zeros(1 + d + FEATURES), np.zeros(1), np.full(1, 0.5))
    model = Model(np.array([moments[f"m{i}"] for i in range(d)]), np.array([max(moments[f"s{i}"], 1e-6) for i in range(d)]), wave, phase, np.zeros(1 + d + FEATURES), np.zeros(1), np.full(1, moments["y"]))
    p = 1 + d + FEATURES

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p + 1))
        for b in batches:
            z = model.features(np.stack(b["x"].to_numpy()))
            total += z.T @ np.column_stack([z, b["y"].to_numpy()])
        yield pd.DataFrame({"cell": np.arange(p * (p + 1)), "part": total.reshape(-1)})

    parts = rows.where("not calibrates").select("x", "y").coalesce(32).mapInPandas(products, "cell long, part double")
    sums = parts.groupBy("cell").agg(F.sum("part").alias("part")).toPandas()
    total = np.zeros(p * (p + 1))
    total[sums["cell"]] = sums["part"]
    total = total.reshape(p, p + 1)
    penalty = RIDGE * max(total[0, 0], 1) / 100 * np.diag([0.0] + [1.0] * (p - 1)) + 1e-9 * np.eye(p)
    model.weight = np.linalg.solve(total[:, :p] + penalty, total[:, p])
    pool = rows.where("calibrates").select("x", "y").toPandas()
    if len(pool) and 0 < pool["y"].mean() < 1:
        model.knots, model.values = isotonic(model.raw(np.stack(pool["x"].to_numpy())), pool["y"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row: a narrow map over whole texts.

    Null texts count as empty, and empty texts get the score of their statistics; null ids and repeated rows pass
    through, one output row each; an empty table gives an empty result; extra columns are not read. A model fitted
    without labels scores 0.5, one fitted on a single label that label's share.
    """
    common.short_batches(docs.sparkSession)
    slim = common.plain(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, texts in _blocks(b):
                s = model.score(texts)
                yield pd.DataFrame({"doc_id": part["id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return slim.mapInPandas(run, f"doc_id {slim.schema['id'].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``threshold``; nulls as in ``score``."""
    common.short_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        out = [model.score(t) for _, t in _blocks(pd.DataFrame({"text": texts}))]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.where(of(F.col(f"`{text_col}`")) >= threshold)
