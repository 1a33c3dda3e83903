"""What the trained classifiers share: a bounded labelled sample, Adam, calibration, and scoring in workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import lean, ship

SAMPLE = 4000  #: labelled rows that a classifier is fitted on at most, half of them of each label


def held_out(key: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int = SAMPLE, text: str = "text", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most rows documents outside the held-out fold, in the order of a hash of the id. Half the
    rows may be of one label. Labels alone are ordered; then the texts of the chosen ids are fetched. Of rows with one id
    the least text is taken, and of its labels the least."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).filter("doc_id is not null and y is not null").filter(~held_out("doc_id", folds, fold))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    half = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows // 2) for y in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]))  # at most rows pairs
    got = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).toPandas()
    got = got.sort_values("doc_id")
    return got["text"].tolist(), got["y"].to_numpy(np.float32)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrated(logits: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets (Platt scaling)."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    params = {"a": np.array(1.0), "b": np.array(0.0)}
    adam = Adam(params, 0.05)
    for _ in range(steps):
        d = sigmoid(params["a"] * logits + params["b"]) - target
        adam.update({"a": (d * logits).mean(), "b": d.mean()})
    return max(float(params["a"]), 0.05), float(params["b"])


def score_rows(docs: DataFrame, make: Callable[[], Callable[[words.Block], np.ndarray]], folds: int, fold: int, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; make() gives a worker its function from a block to scores."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key, folds, fold).alias("held_out"), F.col(text).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score(block).astype(np.float64))], ["doc_id", "held_out", "score"])

    out = rows.mapInArrow(lean(task), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
