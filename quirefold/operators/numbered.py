"""Complement naive Bayes over all texts of a table, whose terms are numbered once and meet by numbers.

Texts are dealt to groups (`textmodel.Groups`), terms to parts by a hash. A group numbers its terms, part by part, and keeps its
texts as rows of numbers; a part gets the terms of all groups once, and hands back, in each group's own order, what the group
cannot know. A term that one group alone has, as nearly half of them are, needs nothing: its counts and sums are the group's own.
No term is dropped and no sum is rounded; blocks of numbers are packed, as tables of terms would be many times as large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirefold.operators.postings import Postings
from quirefold.operators.textmodel import Groups
from quirefold.sources.shared import materialize

#: Groups a part: a part's terms are the fewer rows in a task the more parts there are, and its blocks the larger the fewer.
GROUPS_A_PART = 2


def packed(x: np.ndarray, level: int = 3) -> bytes:
    """Numbers by place of their bytes, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpacked(block: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(block[8:], size, asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def packed_steps(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=0).astype(np.int64))


def unpacked_steps(block: bytes) -> np.ndarray:
    return np.cumsum(unpacked(block, np.int64))


def packed_bits(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + packed(np.packbits(x))


def unpacked_bits(block: bytes) -> np.ndarray:
    return np.unpackbits(unpacked(block[8:], np.uint8), count=int.from_bytes(block[:8], "little")).astype(bool)


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _joined(blocks: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(blocks) if blocks else np.zeros(0, dtype)


def number_terms(group: int, rows: pa.Table, ngrams: int, parts: int, schema: pa.Schema) -> pa.Table:
    """The group's texts as numbers of terms (part -1), and its terms and the number of texts of each, by part. A term's number
    depends on the group's words alone, not on the order of its rows. _to: where a row goes next, a part or a place of its own."""
    found = Postings.of(rows, ngrams)
    part = found.spread % parts
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term = place[found.term]
    by_text = np.argsort(found.doc * max(len(order), 1) + term)
    doc, term, tf = found.doc[by_text], term[by_text], found.tf[by_text]
    n, size = np.bincount(term, minlength=len(order)), np.bincount(doc, minlength=len(found.keys))
    first = (np.cumsum(size) - size)[size > 0]
    steps = np.diff(term, prepend=0)
    steps[first] = term[first]
    texts = int((found.keys.is_valid().to_numpy(zero_copy_only=False) & (size > 0)).sum())
    out = [{"_to": parts + group, "_g": group, "_part": -1, "_texts": texts, "_keys": found.keys.to_pylist(), "_doc": packed(size.astype(np.int32)), "_term": packed(steps.astype(np.int32)), "_tf": packed(tf.astype(np.int32))}]
    terms = found.terms.take(pa.array(order)).cast(pa.large_string())
    offsets, data = np.frombuffer(terms.buffers()[1], np.int64)[: len(order) + 1] if len(order) else np.zeros(1, np.int64), terms.buffers()[2]
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[p], bounds[p + 1]
        own = np.frombuffer(data, np.uint8)[offsets[a] : offsets[b]]
        out.append({"_to": int(p), "_g": group, "_part": int(p), "_len": packed(np.diff(offsets[a : b + 1]).astype(np.int32)), "_terms": packed(own, 6), "_n": packed(n[a:b].astype(np.int32))})
    return _table(out, schema)


def meet_terms(part: int, rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """For each group which of its terms of the part others have too, and of these the number of texts and a number. Texts pass."""
    if rows["_part"][0].as_py() == -1:
        return pa.Table.from_arrays([rows[c] if c in rows.column_names else pa.nulls(rows.num_rows, schema.field(c).type) for c in schema.names], schema=schema)
    rows = rows.to_pylist()
    sizes = [unpacked(r["_len"], np.int32) for r in rows]
    data = np.concatenate([unpacked(r["_terms"], np.uint8) for r in rows])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    terms = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    found = pc.dictionary_encode(terms)
    code = found.indices.to_numpy(zero_copy_only=False)
    shared = np.bincount(code) > 1
    df = np.bincount(code, np.concatenate([unpacked(r["_n"], np.int32) for r in rows])).astype(np.int64)
    # numbers in the order of terms, which is that of each group: they ascend, and pack well
    several, number = np.flatnonzero(shared), np.zeros(len(shared), np.int64)
    number[several[pc.sort_indices(found.dictionary.take(pa.array(several))).to_numpy(zero_copy_only=False)]] = np.arange(len(several))
    out, at = [], 0
    for r, size in zip(rows, sizes, strict=True):
        own = code[at : at + len(size)]
        at += len(size)
        met = own[shared[own]]
        out.append({"_g": r["_g"], "_part": part, "_shared": packed_bits(shared[own]), "_df": packed(df[met]), "_id": packed_steps(number[met])})
    return _table(out, schema)


class GroupTexts:
    """A group's numbered texts (x, the weight of each text's terms before it is divided by the text's length), with what the
    parts handed back, and its labels."""

    def __init__(self, texts: pa.Table, met: pa.Table, n: int, classes: list) -> None:
        own = texts.filter(pc.equal(texts["_part"], -1))
        self.keys = own["_keys"].combine_chunks().flatten()
        row = own.select(["_doc", "_term", "_tf"]).to_pylist()[0]
        size = unpacked(row["_doc"], np.int32)
        self.doc = np.repeat(np.arange(len(size)), size)
        steps = unpacked(row["_term"], np.int32).astype(np.int64)
        whole, start = np.cumsum(steps), (np.cumsum(size) - size)[size > 0]
        self.term = whole - np.repeat((whole - steps)[start], size[size > 0])
        self.parts = sorted((r for r in met.to_pylist() if r["_shared"] is not None), key=lambda r: r["_p"])
        self.shared = _joined([unpacked_bits(r["_shared"]) for r in self.parts], bool)
        df = np.bincount(self.term, minlength=len(self.shared))
        df[self.shared] = _joined([unpacked(r["_df"], np.int64) for r in self.parts], np.int64)
        self.x = unpacked(row["_tf"], np.int32) * (np.log((1 + n) / (1 + df)) + 1)[self.term]
        self.length = np.sqrt(np.bincount(self.doc, self.x * self.x, len(size)))
        # how many labels of each class a text has, and of none
        labels = texts.filter(pc.equal(texts["_part"], -2))
        at = pc.index_in(labels["_key"].combine_chunks(), self.keys, skip_nulls=True)
        self.labels = np.zeros((len(size), len(classes) + 1))
        y = pc.fill_null(pc.index_in(labels["_y"].combine_chunks(), pa.array(classes, labels.schema.field("_y").type), skip_nulls=True), len(classes))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        np.add.at(self.labels, (at.filter(pa.array(known)).to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)[known]), 1)

    def sums(self) -> np.ndarray:
        """Weights of length one, summed up by class (the last: labels of no class) and term."""
        taken = self.labels.any(axis=1)[self.doc]
        doc, term = self.doc[taken], self.term[taken]
        weight = self.x[taken] / self.length[doc]
        return np.stack([np.bincount(term, weight * of_class[doc], len(self.shared)) for of_class in self.labels.T])


def _complement(sums: np.ndarray, alpha: float) -> np.ndarray:
    return alpha + sums.sum(axis=0) - sums[:-1]


def _totals(c: np.ndarray) -> list[float]:
    return [*c.sum(axis=1).tolist(), *np.log(c).sum(axis=1).tolist(), float(c.shape[1])]


def class_sums(texts: pa.Table, met: pa.Table, n: int, classes: list, alpha: float, schema: pa.Schema) -> pa.Table:
    """Of the labelled texts' terms: sums by class of those that other groups have too, by part; of the others only what
    they add to the sums over all terms (part -1)."""
    if not pc.any(pc.equal(texts["_part"], -1)).as_py():
        return schema.empty_table()
    group = GroupTexts(texts, met, n, classes)
    sums = group.sums()
    known = sums.any(axis=0)
    out = [{"_g": -1, "_part": -1, "_totals": _totals(_complement(sums[:, known & ~group.shared], alpha))}]
    sums, known = sums[:, group.shared], known[group.shared]
    at = 0
    for r in group.parts:
        size = int(unpacked_bits(r["_shared"]).sum())
        own = np.flatnonzero(known[at : at + size])
        if len(own):
            out.append({"_g": r["_group"], "_part": r["_p"], "_at": packed_steps(own), "_sums": packed(sums[:, at + own].ravel())})
        at += size
    return _table(out, schema)


def complements(part: int, sums: pa.Table, met: pa.Table, classes: int, alpha: float, schema: pa.Schema) -> pa.Table:
    """Which of the part's shared terms a labelled text has, by number, and their complements, class by class."""
    given = sums.to_pylist()
    if part == -1 or not given:
        return _table([{"_part": part, "_totals": r["_totals"]} for r in given], schema)
    ids = {r["_g"]: unpacked_steps(r["_id"]) for r in met.to_pylist()}
    total = np.zeros((classes + 1, max(len(x) and int(x.max()) + 1 for x in ids.values())))
    for r in given:
        at = ids[r["_g"]][unpacked_steps(r["_at"])]  # a group has a term once
        total[:, at] += unpacked(r["_sums"], np.float64).reshape(classes + 1, -1)
    known = total.any(axis=0)
    c = _complement(total[:, known], alpha)
    return _table([{"_part": part, "_known": packed_bits(known), "_c": packed(c.ravel()), "_totals": _totals(c)}], schema)


def handed_back(given: pa.Table, met: pa.Table, classes: int, schema: pa.Schema) -> pa.Table:
    """For each group which of its shared terms of the part a labelled text has, and their complements, class by class."""
    rows = given.to_pylist()
    if not rows or not met.num_rows:
        return schema.empty_table()
    known = unpacked_bits(rows[0]["_known"])
    c = np.zeros((classes, len(known)))
    c[:, known] = unpacked(rows[0]["_c"], np.float64).reshape(classes, -1)
    out = []
    for r in met.to_pylist():
        own = unpacked_steps(r["_id"])
        has = known[own]
        if has.any():
            out.append({"_group": r["_g"], "_p": r["_part"], "_known": packed_bits(has), "_c": packed(c[:, own[has]].ravel())})
    return _table(out, schema)


def text_scores(texts: pa.Table, met: pa.Table, n: int, classes: list, alpha: float, norm: bool, totals: list[float], schema: pa.Schema) -> pa.Table:
    """(_key, scores) of the texts with a term that a labelled text has."""
    if not pc.any(pc.equal(texts["_part"], -1)).as_py():
        return schema.empty_table()
    group, k = GroupTexts(texts, met, n, classes), len(classes)
    sums = group.sums()
    known = sums.any(axis=0) & ~group.shared
    c = np.ones((k, len(known)))
    c[:, known] = _complement(sums[:, known], alpha)
    found = {r["_p"]: r for r in met.to_pylist() if r["_known"] is not None}
    place, at = np.flatnonzero(group.shared), 0
    for r in group.parts:
        size = int(unpacked_bits(r["_shared"]).sum())
        if r["_p"] in found:
            own = place[at : at + size][unpacked_bits(found[r["_p"]]["_known"])]
            known[own] = True
            c[:, own] = unpacked(found[r["_p"]]["_c"], np.float64).reshape(k, -1)
        at += size
    whole, logs, terms = np.array(totals[:k]), np.array(totals[k : 2 * k]), totals[2 * k]
    w = np.log(c) - np.log(whole)[:, None]
    w = w / (logs - terms * np.log(whole))[:, None] if norm else -w
    w[:, ~known] = 0
    has = np.bincount(group.doc, known[group.term], len(group.keys)) > 0
    scores = np.stack([np.bincount(group.doc, group.x * own[group.term], len(group.keys))[has] / group.length[has] for own in w], 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, k, dtype=np.int32)), pa.array(scores.ravel()))
    return pa.Table.from_arrays([group.keys.filter(pa.array(has)), lists.cast(schema.field(1).type)], schema=schema)


def complement_scores(docs: DataFrame, labels: DataFrame, key: str, text: str, classes: list, ngrams: int, alpha: float, norm: bool) -> DataFrame:
    """(key, scores by class) of the texts of docs with a term that a labelled one has. Terms are weighed by all of docs; labels
    (key, y): each row counts, those of no class for the sum of all only."""
    groups = Groups.of(docs, key, text, ngrams)
    parts, kind = -(-groups.n // GROUPS_A_PART), docs.schema[key].dataType
    fields = lambda ddl: T.StructType.fromDDL(ddl)
    numbered = fields("_to int, _g int, _part int, _texts bigint, _doc binary, _term binary, _tf binary, _len binary, _terms binary, _n binary").add("_keys", T.ArrayType(kind))
    met = fields("_g int, _part int, _texts bigint, _doc binary, _term binary, _tf binary, _shared binary, _df binary, _id binary").add("_keys", T.ArrayType(kind))
    arrow, met_arrow = to_arrow_schema(numbered), to_arrow_schema(met)
    by_part = lambda df, c="_part": df.repartition(2 * parts, c).groupBy(c)
    by_group = lambda df, c="_g": df.repartition(2 * groups.n, c).groupBy(c)
    own = groups.dealt(docs).groupBy("_g").applyInArrow(lambda g, rows: number_terms(g[0].as_py(), rows, ngrams, parts, arrow), numbered)
    own = materialize(by_part(own, "_to").applyInArrow(lambda p, rows: meet_terms(p[0].as_py(), rows, met_arrow), met), "numbered", True)
    n = own.agg(F.sum("_texts")).first()[0] or 0

    texts, shared = own.filter("_part = -1").select("_g", "_part", "_keys", "_doc", "_term", "_tf"), own.filter("_part >= 0")
    given = labels.select(F.col(key).cast(kind).alias("_key"), F.col("y").alias("_y")).filter(F.col("_key").isNotNull())
    texts = texts.unionByName(given.select(groups.group("_key").alias("_g"), F.lit(-2).alias("_part"), "_key", "_y"), allowMissingColumns=True)
    # both sides of these meetings come from one table: columns of one name and origin would be taken for the same
    named = F.col("_g").alias("_group"), F.col("_part").alias("_p")
    back = shared.select(*named, "_shared", "_df")
    summed = fields("_g int, _part int, _at binary, _sums binary, _totals array<double>")
    summed_arrow = to_arrow_schema(summed)
    sums = by_group(texts).cogroup(by_group(back, "_group")).applyInArrow(lambda t, m: class_sums(t, m, n, classes, alpha, summed_arrow), summed)
    added, handed = fields("_part int, _known binary, _c binary, _totals array<double>"), fields("_group int, _p int, _known binary, _c binary")
    added_arrow, handed_arrow, k = to_arrow_schema(added), to_arrow_schema(handed), len(classes)
    ids = shared.select("_g", "_part", "_id")
    of_parts = by_part(sums).cogroup(by_part(ids)).applyInArrow(lambda p, s, m: complements(p[0].as_py(), s, m, k, alpha, added_arrow), added)
    of_parts = materialize(of_parts, "complements", True)
    sum_of = of_parts.select(F.posexplode("_totals").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    totals = [r["x"] for r in sorted(sum_of.collect())] or [0.0] * (2 * k + 1)

    # not written: the same numbers for each group that has a term, many times as large as by part
    given = by_part(of_parts.filter("_part >= 0").select("_part", "_known", "_c")).cogroup(by_part(ids))
    back = back.unionByName(given.applyInArrow(lambda c, m: handed_back(c, m, k, handed_arrow), handed), allowMissingColumns=True)
    scored = T.StructType([T.StructField("_key", kind), *fields("scores array<double>")])
    scored_arrow = to_arrow_schema(scored)
    found = by_group(texts).cogroup(by_group(back, "_group")).applyInArrow(lambda t, m: text_scores(t, m, n, classes, alpha, norm, totals, scored_arrow), scored)
    return found.select(F.col("_key").alias(key), F.transform("scores", lambda x: F.round(x, 9)).alias("scores"))
