"""A network over the last tokens of a text: each token's place has an embedding of its token, all of them feed a hidden
layer, that a class. It knows the order of tokens, which counts of tokens do not.

Tokens are numbered by a hash below `size` (0: no token), so that a model's size is that of its table, whatever the
words. Gradients are summed where the rows are (`gradient.minimise`).

Defined results: a null text has no tokens; of longer texts the last `places` tokens count; rows without label are not
learnt from, nothing to learn from is an error; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.text import tokens
from quirefold.operators.gradient import minimise
from quirefold.sources.shared import materialize, ship

#: Numbers of tokens, places from the end that count, numbers of an embedding, hidden units.
SIZE, PLACES, WIDTH, HIDDEN = 256, 8, 6, 16


def token_numbers(text: Column, size: int = SIZE, places: int = PLACES) -> Column:
    """The last tokens of a text, the last one first, as numbers; 0 where there is none."""
    words = F.slice(F.reverse(tokens(F.coalesce(text, F.lit("")))), 1, places)
    ids = F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(size - 1)) + 1).cast("int"))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("int"), places)), 1, places)


@dataclass(frozen=True)
class Network:
    """Embeddings (size, width), then weights and offsets of the hidden layer and of the classes."""

    token: np.ndarray
    hidden: np.ndarray
    hidden_0: np.ndarray
    out: np.ndarray
    out_0: np.ndarray

    @staticmethod
    def shapes(size: int, places: int, width: int, units: int, classes: int) -> list[tuple[int, ...]]:
        return [(size, width), (places * width, units), (units,), (units, classes), (classes,)]

    @classmethod
    def of(cls, flat: np.ndarray, shape: tuple[int, ...]) -> Network:
        parts, at = [], 0
        for s in cls.shapes(*shape):
            n = int(np.prod(s))
            parts.append(flat[at : at + n].reshape(s))
            at += n
        return cls(*parts)

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the hidden layer, its output, and the probability of each class."""
        x = self.token[ids].reshape(len(ids), -1)
        h = np.tanh(x @ self.hidden + self.hidden_0)
        z = h @ self.out + self.out_0
        z = np.exp(z - z.max(1, keepdims=True))
        return x, h, z / z.sum(1, keepdims=True)


def _numbers(batch: pa.RecordBatch, column: str, places: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(-1, places)


def loss_of(shape: tuple[int, ...]):
    """The negative log-likelihood of a batch (ids, y, n: how many such rows) and its gradient."""

    def loss(batch: pa.RecordBatch, flat: np.ndarray) -> tuple[float, np.ndarray]:
        net, ids, y, times = Network.of(flat, shape), _numbers(batch, "ids", shape[1]), np.asarray(batch.column("y")), np.asarray(batch.column("n"))
        x, h, p = net.forward(ids)
        at = np.arange(len(y))
        value = -(times * np.log(np.maximum(p[at, y], 1e-300))).sum()
        dz = p.copy()
        dz[at, y] -= 1
        dz *= times[:, None]
        dh = dz @ net.out.T * (1 - h * h)
        dx = (dh @ net.hidden.T).reshape(-1, shape[2])
        token = np.stack([np.bincount(ids.ravel(), weights=dx[:, k], minlength=shape[0]) for k in range(shape[2])], 1)
        return float(value), np.concatenate([g.ravel() for g in (token, x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))])

    return loss


@dataclass(frozen=True)
class TokenModel:
    shape: tuple[int, ...]
    flat: np.ndarray

    def predict(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with `prediction`, the most probable class, the smaller of equals, and `probability`, that of each class."""
        return self.predict_numbers(rows.select("*", token_numbers(F.col(text), self.shape[0], self.shape[1]).alias("_ids")))

    def predict_numbers(self, given: DataFrame) -> DataFrame:
        """`predict` of rows whose last column, `_ids`, has the numbers of their tokens; it goes."""
        ship(given.sparkSession)
        sent, shape = given.sparkSession.sparkContext.broadcast(self.flat), self.shape
        schema = T.StructType([*given.schema.fields[:-1], T.StructField("prediction", T.DoubleType()), T.StructField("_shares", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = Network.of(sent.value, shape)
            for batch in batches:
                p = net.forward(_numbers(batch, "_ids", shape[1]))[2] if batch.num_rows else np.zeros((0, shape[4]))
                shares = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * shape[4]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p.argmax(1).astype(float)), shares], names=[*batch.schema.names[:-1], "prediction", "_shares"])

        return given.mapInArrow(run, schema).withColumn("probability", array_to_vector("_shares")).drop("_shares")

    def save(self, spark, path: str) -> None:
        """As a table: one row, the weights and their shape."""
        spark.createDataFrame([(json.dumps(self.shape), self.flat.tolist())], "shape string, weights array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> TokenModel:
        row = spark.read.parquet(path).first()
        return TokenModel(tuple(json.loads(row["shape"])), np.asarray(row["weights"]))


def fit(rows: DataFrame, text: str, label: str, size: int = SIZE, places: int = PLACES, width: int = WIDTH, units: int = HIDDEN, l2: float = 1e-3, rounds: int = 60, seed: int = 1) -> TokenModel:
    """A network of the rows with a label, whole numbers from 0."""
    return fit_numbers(rows.withColumn("_ids", token_numbers(F.col(text), size, places)), label, size, places, width, units, l2, rounds, seed)


def fit_numbers(rows: DataFrame, label: str, size: int = SIZE, places: int = PLACES, width: int = WIDTH, units: int = HIDDEN, l2: float = 1e-3, rounds: int = 60, seed: int = 1) -> TokenModel:
    """`fit` of rows whose column `_ids` has the numbers of their tokens."""
    known = rows.filter(F.col(label).isNotNull()).select(F.col("_ids").alias("ids"), F.col(label).cast("int").alias("y"))
    known = materialize(known.groupBy("ids", "y").agg(F.count(F.lit(1)).alias("n")), "token_rows")  # few texts of token shapes differ
    top = known.agg(F.max("y").alias("y")).first()["y"]
    if top is None:
        raise ValueError("no row has a label")
    shape = (size, places, width, units, top + 1)
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.5, s) if k == 0 else rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for k, s in enumerate(Network.shapes(*shape))]
    return TokenModel(shape, minimise(known, loss_of(shape), np.concatenate([p.ravel() for p in parts]), l2, rounds))
