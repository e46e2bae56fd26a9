"""A linear-chain model of labels in order: what a contents line is depends on itself and on the line before.

A page is a sequence of lines; a line has features, numbers below `size` (words and places, hashed), and a label from 0.
The score of a labelling adds up a weight for each feature and label and one for each two labels in a row, at the
beginning and at the end. Training sums expected minus seen counts over all pages, by forward and backward recursions in
the tasks; prediction finds a page's best labelling as a whole. Pages of like length are computed together, and lines of
the same features have their scores once in a batch.

Defined results: pages with a line without label are not learnt from; a page of one line has no neighbours; a null text
is empty; an empty table gives an empty result, and nothing to learn from is an error; rows of the same number on a page
keep an order by their text.
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

#: Numbers that features are hashed to: the size of a model, whatever the number of words.
SIZE = 1 << 12

#: Lines whose features are written together for training.
PACKED = 50_000


def hashed(name: str, values: Column, size: int = SIZE) -> Column:
    """An array of texts as numbers below size, those of other names elsewhere."""
    return F.transform(values, lambda v: F.pmod(F.xxhash64(F.lit(name), v), F.lit(size)).cast("int"))


def line_words(text: Column) -> Column:
    return tokens(F.coalesce(text, F.lit("")))


def line_features(text: Column, left: Column | None = None, size: int = SIZE, words: Column | None = None) -> Column:
    """A line's features: its words and pairs of neighbours, the first three and the last in their places, its number of
    words, and how far in it begins, in fiftieths of the page. words: a column that holds `line_words` of the text, as
    they are named a dozen times."""
    words = line_words(text) if words is None else words
    first = lambda k: F.coalesce(F.try_element_at(words, F.lit(k)), F.lit(""))
    parts = [
        hashed("all", F.array(F.lit("")), size),
        hashed("word", F.array_distinct(words), size),
        hashed("first", F.array(first(1)), size),
        hashed("second", F.array(F.concat_ws(" ", first(1), first(2))), size),
        hashed("third", F.array(F.concat_ws(" ", first(1), first(2), first(3))), size),
        hashed("pair", F.array_distinct(F.zip_with(words, F.slice(words, 2, F.size(words) + 1), lambda a, b: F.concat_ws(" ", a, b))), size),
        hashed("last", F.array(first(-1)), size),
        hashed("many", F.array(F.least(F.size(words), F.lit(12)).cast("string")), size),
    ]
    if left is not None:
        parts.append(hashed("left", F.array(F.coalesce(F.floor(left * 50 + 1e-6).cast("string"), F.lit(""))), size))
    return F.array_distinct(F.concat(*parts))


def pages_of(rows: DataFrame, keys: tuple[str, ...], order: str, features: Column, label: str | None = None, besides: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lines: array of (order, row, features, label)), a row for each page. A page is the unit of this model.
    besides: columns that features need and rows do not keep."""
    y = (F.col(label) if label else F.lit(None)).cast("int").alias("y")
    line = F.struct(F.col(order).alias("o"), F.struct(*[F.col(c) for c in rows.columns if c not in (*keys, *besides)]).alias("row"), features.alias("f"), y)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


@dataclass(frozen=True)
class Weights:
    """The model: of features and labels, of labels in a row, at the beginning and at the end."""

    own: np.ndarray
    next: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, size: int, labels: int) -> Weights:
        a, b = size * labels, size * labels + labels * labels
        return cls(flat[:a].reshape(size, labels), flat[a:b].reshape(labels, labels), flat[b : b + labels], flat[b + labels :])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.own, self.next, self.first, self.last)])


class Batch:
    """The lines of some pages: their kind and label, the features of each kind, and groups of pages of like length. Lines
    with the same features in the same order are of one kind."""

    #: Columns of a batch as a row of a table.
    SCHEMA = "kind array<int>, labels array<int>, lengths array<int>, many array<int>, features array<int>"

    def __init__(self, lines: pa.Array) -> None:
        lengths = np.asarray(lines.value_lengths())
        flat = lines.flatten()
        features = flat.field("f")
        ends = np.cumsum(np.concatenate([[0], np.asarray(features.value_lengths())])) * 4
        numbers = np.asarray(features.flatten()).astype(np.int32)
        bits = pa.Array.from_buffers(pa.large_binary(), len(features), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(numbers)])
        kinds = bits.dictionary_encode()
        self.kind, of_kind = np.asarray(kinds.indices), kinds.dictionary.to_pylist()
        self.many = np.array([len(x) // 4 for x in of_kind], dtype=np.int64)
        self.features = np.frombuffer(b"".join(of_kind), np.int32)
        self.labels = np.asarray(flat.field("y").fill_null(-1))
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths

    def packed(self) -> pa.RecordBatch:
        """The batch as one row."""
        names = ["kind", "labels", "lengths", "many", "features"]
        return pa.RecordBatch.from_arrays([pa.array([np.asarray(getattr(self, n), np.int32)], pa.list_(pa.int32())) for n in names], names=names)

    @classmethod
    def unpacked(cls, batch: pa.RecordBatch, row: int) -> Batch:
        out = cls.__new__(cls)
        for n in batch.schema.names:
            setattr(out, n, np.asarray(batch.column(n)[row].values))
        out.starts = np.cumsum(out.lengths) - out.lengths
        return out

    def own_scores(self, w: Weights) -> np.ndarray:
        """Of each line and label; every line has a feature."""
        return np.add.reduceat(w.own[self.features], np.cumsum(self.many) - self.many, axis=0)[self.kind] if len(self.many) else np.zeros((0, w.own.shape[1]))

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(lines: a row for each page, padded with its last line; the pages' lengths; the pages)."""
        if not len(self.lengths):
            return
        power = np.ceil(np.log2(np.maximum(self.lengths, 1))).astype(int)
        for p in np.unique(power):
            pages = np.flatnonzero((power == p) & (self.lengths > 0))
            if len(pages):
                n = self.lengths[pages]
                yield self.starts[pages][:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1), n, pages


def forward_backward(e: np.ndarray, n: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pages' own scores e (pages, lines, labels) of n lines each: log sums from the left, from the right, and of all
    labellings."""
    left, right = np.empty_like(e), np.empty_like(e)
    left[:, 0] = w.first + e[:, 0]
    for t in range(1, e.shape[1]):
        on = _log_sum(left[:, t - 1, :, None] + w.next, 1) + e[:, t]
        left[:, t] = np.where((t < n)[:, None], on, left[:, t - 1])
    right[:, -1] = w.last
    for t in range(e.shape[1] - 2, -1, -1):
        on = _log_sum(w.next + (e[:, t + 1] + right[:, t + 1])[:, None, :], 2)
        right[:, t] = np.where((t < n - 1)[:, None], on, w.last)
    return left, right, _log_sum(left[:, -1] + w.last, 1)


def best_labels(e: np.ndarray, n: np.ndarray, w: Weights) -> np.ndarray:
    """The labelling of the highest score of each page, the smaller label of equals."""
    score, back = w.first + e[:, 0], np.zeros(e.shape, dtype=int)
    for t in range(1, e.shape[1]):
        ways = score[:, :, None] + w.next
        back[:, t] = ways.argmax(1)
        on = ways.max(1) + e[:, t]
        inside = (t < n)[:, None]
        score = np.where(inside, on, score)
        back[:, t] = np.where(inside, back[:, t], np.arange(e.shape[2]))  # padding repeats the last label
    out = np.empty(e.shape[:2], dtype=int)
    out[:, -1] = (score + w.last).argmax(1)
    for t in range(e.shape[1] - 1, 0, -1):
        out[:, t - 1] = np.take_along_axis(back[:, t], out[:, t, None], 1)[:, 0]
    return out


def loss_of(size: int, labels: int):
    """The negative log-likelihood of a batch of labelled pages, and its gradient."""

    def loss(batch: pa.RecordBatch, flat: np.ndarray) -> tuple[float, np.ndarray]:
        """batch: pages, or rows that hold packed batches of pages."""
        if "lines" in batch.schema.names:
            return of_pages(Batch(batch.column("lines")), flat)
        values, slopes = zip(*(of_pages(Batch.unpacked(batch, i), flat) for i in range(batch.num_rows)), strict=True)
        return sum(values), np.sum(slopes, axis=0)

    def of_pages(b: Batch, flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = Weights.of(flat, size, labels)
        own = b.own_scores(w)
        excess = np.zeros_like(own)  # expected minus seen counts of each line and label
        pairs, first, last, value = np.zeros_like(w.next), np.zeros_like(w.first), np.zeros_like(w.last), 0.0
        for lines, n, _ in b.groups():
            e, y = own[lines], b.labels[lines]
            page, at = np.arange(len(n)), np.arange(lines.shape[1])
            inside, onward = at < n[:, None], at[:-1] < n[:, None] - 1
            left, right, every = forward_backward(e, n, w)
            p = np.exp(left + right - every[:, None, None])
            p[page[:, None], at, y] -= 1
            excess[lines[inside]] += p[inside]
            if lines.shape[1] > 1:
                two = left[:, :-1, :, None] + w.next + (e[:, 1:] + right[:, 1:])[:, :, None, :] - every[:, None, None, None]
                pairs += np.exp(two[onward]).sum(0)
                np.subtract.at(pairs, (y[:, :-1][onward], y[:, 1:][onward]), 1)
            ends = y[page, n - 1]
            first += p[:, 0].sum(0)
            last += p[page, n - 1].sum(0)
            seen = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0]
            value += every.sum() - seen[inside].sum() - w.next[y[:, :-1], y[:, 1:]][onward].sum() - w.first[y[:, 0]].sum() - w.last[ends].sum()
        of_kind = np.stack([np.bincount(b.kind, weights=excess[:, k], minlength=len(b.many)) for k in range(labels)], 1)
        of_feature = np.repeat(of_kind, b.many, axis=0)
        slope = np.stack([np.bincount(b.features, weights=of_feature[:, k], minlength=size) for k in range(labels)], 1)
        return float(value), np.concatenate([slope.ravel(), pairs.ravel(), first, last])

    return loss


@dataclass(frozen=True)
class SequenceModel:
    weights: Weights

    @property
    def labels(self) -> int:
        return len(self.weights.first)

    def predict(self, pages: DataFrame) -> DataFrame:
        """The pages' lines with `prediction`, their label in the page's best labelling, and `probability`, that of each
        label given the page. pages: of `pages_of`."""
        ship(pages.sparkSession)
        keys = [c for c in pages.columns if c != "lines"]
        sent = pages.sparkSession.sparkContext.broadcast(self.weights)
        found = T.ArrayType(T.StructType([T.StructField("y", T.IntegerType()), T.StructField("p", T.ArrayType(T.DoubleType()))]))
        schema = T.StructType([*pages.schema.fields, T.StructField("found", found)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = sent.value
            for batch in batches:
                b = Batch(batch.column("lines"))
                own = b.own_scores(w)
                y, p = np.zeros(len(own), np.int32), np.zeros_like(own)
                for lines, n, _ in b.groups():
                    inside = np.arange(lines.shape[1]) < n[:, None]
                    y[lines[inside]] = best_labels(own[lines], n, w)[inside]
                    left, right, every = forward_backward(own[lines], n, w)
                    p[lines[inside]] = np.exp(left + right - every[:, None, None])[inside]
                shares = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                pairs = pa.StructArray.from_arrays([pa.array(y), shares], names=["y", "p"])
                bounds = pa.array(np.concatenate([b.starts, [len(y)]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(bounds, pairs)], names=[*batch.schema.names, "found"])

        out = pages.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip("lines", "found")).alias("_l"))
        rows = [f.name for f in pages.schema["lines"].dataType.elementType["row"].dataType.fields]
        return out.select(*keys, *[F.col(f"_l.lines.row.{c}").alias(c) for c in rows], F.col("_l.found.y").cast("double").alias("prediction"), array_to_vector("_l.found.p").alias("probability"))

    def save(self, spark, path: str) -> None:
        """As a table: one row, the weights and their shape."""
        shape = json.dumps([self.weights.own.shape[0], self.labels])
        spark.createDataFrame([(shape, self.weights.flat().tolist())], "shape string, weights array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> SequenceModel:
        row = spark.read.parquet(path).first()
        return SequenceModel(Weights.of(np.asarray(row["weights"]), *json.loads(row["shape"])))


def fit(pages: DataFrame, size: int = SIZE, l2: float = 0.01, rounds: int = 25) -> SequenceModel:
    """A model of the pages whose lines all have labels. pages: of `pages_of`, with a label."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("lines")
            # pieces of pages in their order, of about PACKED lines
            piece = np.cumsum(np.asarray(lines.value_lengths())) // PACKED
            for at in np.split(np.arange(len(piece)), np.flatnonzero(np.diff(piece)) + 1):
                if len(at):
                    yield Batch(lines.slice(at[0], len(at))).packed()

    labelled = pages.filter(~F.exists("lines", lambda x: x["y"].isNull())).select(F.transform("lines", lambda x: F.struct(x["f"].alias("f"), x["y"].alias("y"))).alias("lines"))
    known = materialize(labelled.mapInArrow(run, Batch.SCHEMA), "pages")
    top = known.agg(F.max(F.array_max("labels")).alias("y")).first()["y"]
    if top is None:
        raise ValueError("no page has labels")
    labels = top + 1
    start = np.zeros(size * labels + labels * labels + 2 * labels)
    return SequenceModel(Weights.of(minimise(known, loss_of(size, labels), start, l2, rounds), size, labels))
