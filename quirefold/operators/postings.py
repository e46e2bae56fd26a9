"""Terms of one group of texts as arrays: what a task counts and sums up of the rows that Spark deals to it."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, null one of them, and the values."""
    found = pc.dictionary_encode(column, null_encoding="encode")
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    found = found.unify_dictionaries().combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


@dataclass(frozen=True)
class Postings:
    """A group's texts (keys, y), distinct terms, words before pairs and each in order, a hash of each, and a row
    (doc, term, tf) for each text and term, by text."""

    keys: pa.Array
    y: pa.Array
    terms: pa.Array
    spread: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, ngrams: int) -> Postings:
        """rows (_key, _y, _words); rows of one key and y are one text, whose pairs of words do not reach from row to row."""
        key, keys = _codes(rows["_key"])
        y, ys = _codes(rows["_y"])
        text, text_of = np.unique(key.astype(np.int64) * (len(ys) + 1) + y, return_inverse=True)
        lists = pa.concat_arrays(rows["_words"].chunks)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        word, words = _codes(pa.chunked_array([lists.flatten()]))
        order = pc.sort_indices(words).to_numpy(zero_copy_only=False)
        words, rank = words.take(pa.array(order)), np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        code, doc, n = rank[word], text_of[row], len(words)
        if ngrams == 2:
            beside = np.flatnonzero(row[1:] == row[:-1])
            code = np.concatenate([code, n + code[beside] * n + code[beside + 1]])
            doc = np.concatenate([doc, doc[beside]])
        distinct, term = np.unique(code, return_inverse=True)
        both, tf = np.unique(doc.astype(np.int64) * max(len(distinct), 1) + term, return_counts=True)
        pairs = distinct[distinct >= n] - n
        terms = words.take(pa.array(distinct[distinct < n]))
        mark = np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.uint64, n) * np.uint64(0x9E3779B97F4A7C15)
        spread = np.concatenate([mark[distinct[distinct < n]], ((mark[pairs // n] >> np.uint64(7)) + mark[pairs % n]) * np.uint64(0xD6E8FEB86659FD93)]) >> np.uint64(33)
        if len(pairs):
            joined = pc.binary_join_element_wise(words.take(pa.array(pairs // n)), words.take(pa.array(pairs % n)), " ")
            terms = pa.concat_arrays([terms, joined])
        size = max(len(distinct), 1)
        return cls(keys.take(pa.array(text // (len(ys) + 1))), ys.take(pa.array(text % (len(ys) + 1))), terms, spread.astype(np.int64), both // size, both % size, tf.astype(np.float64))

    def known(self, table: pa.Table) -> tuple[Postings, np.ndarray]:
        """The postings of a table's terms, and the table's row of each."""
        at = pc.fill_null(pc.index_in(self.terms, table["term"].combine_chunks()), -1).to_numpy(zero_copy_only=False)[self.term]
        kept = at >= 0
        return Postings(self.keys, self.y, self.terms, self.spread, self.doc[kept], self.term[kept], self.tf[kept]), at[kept]

    def sums(self, weights: np.ndarray | None = None) -> np.ndarray:
        """By text."""
        return np.bincount(self.doc, weights, minlength=len(self.keys))


def document_counts(group: int, found: Postings, schema: pa.Schema) -> pa.Table:
    """(_g, term, _n): the number of texts that have a term."""
    n = np.bincount(found.term, minlength=len(found.terms))
    return pa.Table.from_arrays([pa.array(np.full(len(n), group, np.int32)), found.terms, pa.array(n.astype(np.int64))], schema=schema)


def text_weights(found: Postings, table: pa.Table, schema: pa.Schema) -> pa.Table:
    """(_key, n_terms, total, top) of texts with a term of table (term, idf): weights of length one."""
    met, at = found.known(table)
    x = met.tf * table["idf"].to_numpy()[at]
    n, total, length = met.sums(), met.sums(x), np.sqrt(met.sums(x * x))
    top = np.zeros(len(n))
    np.maximum.at(top, met.doc, x)
    has = n > 0
    return pa.Table.from_arrays([found.keys.filter(pa.array(has)), pa.array(n[has].astype(np.int64)), pa.array(total[has] / length[has]), pa.array(top[has] / length[has])], schema=schema)


def class_sums(found: Postings, table: pa.Table, classes: list, schema: pa.Schema) -> pa.Table:
    """(term, idf, t, s0, s1, ...): weights of length one by term, of all texts and of each class."""
    met, at = found.known(table)
    x = met.tf * table["idf"].to_numpy()[at]
    weight = x / np.sqrt(met.sums(x * x))[met.doc]
    own = np.full(len(found.keys), -1)
    for i, c in enumerate(classes):
        own[pc.fill_null(pc.equal(found.y, pa.scalar(c, found.y.type)), False).to_numpy(zero_copy_only=False)] = i
    own, size = own[met.doc], table.num_rows
    seen = np.flatnonzero(np.bincount(at, minlength=size))
    sums = [np.bincount(at, weight, size)[seen], *[np.bincount(at[own == i], weight[own == i], size)[seen] for i in range(len(classes))]]
    rows = pa.array(seen)
    return pa.Table.from_arrays([table["term"].take(rows), table["idf"].take(rows), *map(pa.array, sums)], schema=schema)


def text_scores(found: Postings, table: pa.Table, schema: pa.Schema) -> pa.Table:
    """(_key, scores) of texts with a term of table (term, idf, w: a weight for each class)."""
    met, at = found.known(table)
    x = met.tf * table["idf"].to_numpy()[at]
    n, length = met.sums(), np.sqrt(met.sums(x * x))
    has = n > 0
    w = pa.concat_arrays(table["w"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    scores = np.stack([met.sums(x * w[at, i])[has] / length[has] for i in range(w.shape[1])], 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32)), pa.array(scores.ravel()))
    return pa.Table.from_arrays([found.keys.filter(pa.array(has)), lists.cast(schema.field(1).type)], schema=schema)
