"""Minimising a loss that is a sum over rows: gradients are summed where the rows are, steps are taken on the driver.

Each round reads the rows once. A task adds up the loss and the gradient of its batches and hands on one vector of the
model's size; Spark sums the vectors. The steps are those of a limited-memory quasi-Newton method with backtracking, so
that a few dozen rounds are enough. What goes to the driver and to the tasks is the model, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.sources.shared import ship

#: Pairs of steps that the method remembers.
MEMORY = 8


def total(rows: DataFrame, loss: Callable[[pa.RecordBatch, np.ndarray], tuple[float, np.ndarray]], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss and its gradient over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, slope = 0.0, np.zeros(len(sent.value))
        for batch in batches:
            if batch.num_rows:
                v, g = loss(batch, sent.value)
                value += v
                slope += g
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([slope.tolist()], pa.list_(pa.float64()))], names=["loss", "slope"])

    found = rows.mapInArrow(run, "loss double, slope array<double>")
    row = found.select("loss", array_to_vector("slope").alias("slope"), F.lit("all").alias("rows")).groupBy("rows").agg(F.sum("loss").alias("loss"), Summarizer.sum(F.col("slope")).alias("slope")).first()
    sent.destroy()
    return (0.0, np.zeros(len(weights))) if row is None else (row["loss"], row["slope"].toArray())


def minimise(rows: DataFrame, loss: Callable[[pa.RecordBatch, np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, l2: float = 1e-3, rounds: int = 40, tolerance: float = 1e-4) -> np.ndarray:
    """The weights of the least loss(rows) + l2 / 2 * |weights|^2 that so many readings of the rows find. rows are read
    again and again, so they should be a written table."""
    ship(rows.sparkSession)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        v, g = total(rows, loss, w)
        return v + l2 / 2 * float(w @ w), g + l2 * w

    w = np.asarray(start, dtype=float)
    value, slope = at(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    size = 1 / max(1.0, float(np.linalg.norm(slope)))
    used = 1
    while used < rounds:
        way = -_times_inverse(steps, slope)
        while used < rounds:
            new = w + size * way
            new_value, new_slope = at(new)
            used += 1
            if new_value <= value + 1e-4 * size * float(slope @ way):
                break
            size /= 4
        else:
            break
        s, y = new - w, new_slope - slope
        if float(s @ y) > 1e-12:
            steps = [*steps[1 - MEMORY :], (s, y)]
        done = value - new_value <= tolerance * max(1.0, abs(value))
        w, value, slope, size = new, new_value, new_slope, 1.0
        if done:
            break
    return w


def _times_inverse(steps: list[tuple[np.ndarray, np.ndarray]], slope: np.ndarray) -> np.ndarray:
    """The slope times the inverse second derivative that the steps suggest."""
    q, factors = slope.copy(), []
    for s, y in reversed(steps):
        a = float(s @ q) / float(s @ y)
        q -= a * y
        factors.append(a)
    if steps:
        s, y = steps[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(steps, reversed(factors), strict=True):
        q += (a - float(y @ q) / float(s @ y)) * s
    return q
