"""Substring dedup by suffix automata of reference shards.

What is removed: every word covered by a window of `length` words that also starts anywhere else in the corpus. The
corpus is its own reference, and to stream every document against automata of everything would be quadratic, so the
reference is first cut down to what repeats, and each document only meets the shards that it can match:

1. one pass over the texts gives each document's digest and its anchors, the minimisers of its windows: equal windows
   have equal anchors. Documents whose word sequences are equal are settled by their digest, one of them goes on;
2. anchors that occur twice or more are counted (about one in fourteen words is an anchor); windows with such an anchor
   are candidates; candidate windows are counted by hash. Every window found twice or more becomes reference text once,
   in its first document, as maximal segments. How often a passage is copied no longer matters from here on;
3. the reference is dealt into shards of bounded size by document; a window's hash tells which shards can match a
   document. Each task builds the suffix automaton of its shard, streams its documents' candidate passages through it and marks
   all spans whose matching statistics reach the length. A shard that many documents need goes to several tasks, each
   with a bounded share of the documents. Shards go only to the tasks that need them, not to all executors, so the
   size of what is sent is bounded by the shard;
4. spans of all shards are united per document.

Counts are aggregated before they are shuffled; joins on anchors and windows can be split by adaptive execution.

Window hashes choose what becomes reference text and route documents; the spans come from the automata, which compare
word by word.

Defined results: a null or empty text has no words; a document shorter than a window loses nothing; equal documents of
a window's length or more lose all words, all of them; overlapping repeats within one document count; very long texts
are taken whole; rows with a null id and rows that repeat an id, with the same or another text, are documents of their
own; an empty table gives an empty result; other columns are passed on unread, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm import textkit as K
from quirefold.llm.store import keyed, materialize, prepare, settle, unused

#: Words of a shard's reference text, about.
SHARD_WORDS = 250_000
#: Candidate words that one task streams through one shard, about.
TASK_WORDS = 1_500_000
#: Words under an anchor's hash, at most.
ANCHOR_WORDS = 8

_LONGS = T.ArrayType(T.LongType())
PASS_ONE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("anchors", _LONGS)])
SEGMENTS = T.StructType([T.StructField("rep", T.LongType()), T.StructField("words", _LONGS)])
SPANS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", _LONGS)])
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _slide(x: np.ndarray, n: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over x[i : i + n], shorter at the end."""
    out, width = x, 1
    while width * 2 <= n:
        out = np.concatenate([of(out[:-width], out[width:]), out[-width:]]) if len(out) > width else out
        width *= 2
    rest = n - width
    if rest and len(out) > rest:
        out = np.concatenate([of(out[:-rest], out[rest:]), out[-rest:]])
    return out


class Windows:
    """Windows of the words of a slice: which words start one, the windows' hashes and anchors."""

    def __init__(self, w: K.Words, length: int) -> None:
        self.length, self.k = length, min(ANCHOR_WORDS, length)
        self.width = length - self.k + 1
        self.fits = w.room(length)
        self.grams = K.ngram_hashes(w.hash, self.k)
        self.anchor = _slide(self.grams, self.width, np.minimum)

    def anchor_positions(self) -> np.ndarray:
        """Positions whose gram is the least one of some window."""
        least = np.where(self.fits, self.anchor, np.uint64(0))
        most = _slide(least[::-1], self.width, np.maximum)[::-1]  # over the windows that hold a position
        return np.flatnonzero((most == self.grams) & (most > 0))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _list_array(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _signed(values))


def _joined(w: K.Words, keep: np.ndarray | None = None) -> list[str]:
    """SHA-256 of each document's (kept) words with one blank between."""
    blob, start, end, out = w.raw.tobytes(), w.start.tolist(), w.end.tolist(), []
    for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        chosen = range(a, b) if keep is None else (a + np.flatnonzero(keep[a:b])).tolist()
        out.append(hashlib.sha256(b" ".join([blob[start[i] : end[i]] for i in chosen])).hexdigest())
    return out


def _all_words_digests(w: K.Words) -> list[str]:
    """The same for all words, without a list of words: bytes.split cuts at the same white space."""
    blob, off = w.raw.tobytes(), w.offsets.tolist()
    return [hashlib.sha256(b" ".join(blob[a:b].split())).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]


def _pass_one(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in K.per_slice(batch.column(1)):
                win = Windows(w, length)
                at = win.anchor_positions()
                index = np.arange(len(w), dtype=np.uint64) - np.repeat(w.doc[:-1], w.counts()).astype(np.uint64)
                with np.errstate(over="ignore"):
                    digests = [K.mix(w.hash * np.uint64(m) + K.mix(index + np.uint64(m))) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in digests]
                    d1, d2 = (s[w.doc[1:]] - s[w.doc[:-1]] for s in sums)
                anchors = _list_array(win.grams[at], np.searchsorted(at, w.doc))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(w.counts(), pa.int64()), _signed(d1), _signed(d2), pa.array(_all_words_digests(w), pa.string()), anchors], names=[f.name for f in PASS_ONE])

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _candidates(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, K.Words, Windows, np.ndarray]]:
    """(first row, words, windows, which windows have a repeated anchor) of a batch (doc_id, text, anchors)."""
    for a, b, w in K.per_slice(batch.column("_text")):
        win = Windows(w, length)
        yield a, w, win, win.fits & np.isin(win.anchor, _flat(batch.column("anchors").slice(a, b - a)))


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, w, _, chosen in _candidates(batch, length):
                h, docs = K.ngram_hashes(w.hash, length)[chosen], ids[a + w.doc_of()[chosen]]
                for i in range(0, len(h), 100_000):
                    yield pa.RecordBatch.from_arrays([_signed(h[i : i + 100_000]), pa.array(docs[i : i + 100_000])], names=["window", "doc"])

    return run


def _segments(length: int):
    """Maximal segments of reference text: rows (doc_id, text, anchors, windows) to SEGMENTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, w, _, chosen in _candidates(batch, length):
                own = batch.column("windows").slice(a, len(w.doc) - 1)
                # A window counts in its representative document only: hashes are salted with the row.
                hashes, rows = K.ngram_hashes(w.hash, length), w.doc_of()
                wanted = _flat(own) ^ K.mix(np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False)).astype(np.uint64))
                hit = chosen & np.isin(hashes ^ K.mix(rows.astype(np.uint64)), wanted)
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(rows[at]) > 0)) + 1
                first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
                reps = [int(ids[a + rows[x]]) for x in first.tolist()]
                words = [w.hash[x : y + length].view(np.int64) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["rep", "words"])

    return run


class SuffixAutomaton:
    """Of several sequences; a match never runs over the end of one."""

    def __init__(self) -> None:
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size, self.last = [-1], [0], 0

    def add(self, sequence: list[int]) -> None:
        go, link, size = self.go, self.link, self.size
        last = 0
        for c in sequence:
            known = go[last].get(c)
            if known is not None and last == 0 or known is not None and size[known] == size[last] + 1:
                last = known if size[known] == size[last] + 1 else self._clone(last, c, known)
                continue
            if known is not None:
                last = self._clone(last, c, known)
                continue
            new = len(go)
            go.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c: int, q: int) -> int:
        go, link, size = self.go, self.link, self.size
        clone = len(go)
        go.append(go[q].copy())
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = clone
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = clone
            p = link[p]
        return clone

    def matches(self, sequence: list[int], length: int) -> list[int]:
        """Ends (past the last word) of matches of at least that length."""
        go, link, size = self.go, self.link, self.size
        state = long = 0
        out = []
        for i, c in enumerate(sequence, 1):
            to = go[state].get(c)
            while to is None and state:
                state = link[state]
                long = size[state]
                to = go[state].get(c)
            if to is None:
                long = 0
                continue
            state = to
            long += 1
            if long >= length:
                out.append(i)
        return out


def _runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _cover(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Words that windows from these starts cover."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def _stream(length: int):
    """One task: a shard's segments and some documents (doc_id, text, anchors) -> spans as start, end, start, end, ..."""

    def run(shard: pa.Table, docs: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        for words in shard.column("words"):
            automaton.add(words.values.to_numpy().tolist())
        ids, spans = [], []
        for batch in docs.to_batches(max_chunksize=256):
            numbers = batch.column("doc_id").to_pylist()
            for a, w, _, chosen in _candidates(batch, length):
                covered = _cover(np.flatnonzero(chosen), len(w), length)
                symbols = w.hash.view(np.int64)
                for d in range(len(w.doc) - 1):
                    lo, hi = int(w.doc[d]), int(w.doc[d + 1])
                    ends = [x + e for x, y in _runs(covered[lo:hi]) for e in automaton.matches(symbols[lo + x : lo + y].tolist(), length)]
                    if ends:
                        found = _runs(_cover(np.array(ends) - length, hi - lo, length))
                        ids.append(numbers[a + d])
                        spans.append([z for r in found for z in r])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64()))})

    return run


def _keep_mask(w: K.Words, spans: pa.Array) -> np.ndarray:
    keep = np.ones(len(w), dtype=bool)
    for d, flat in enumerate(spans):
        base = int(w.doc[d])
        x = flat.values.to_numpy().tolist()
        for s, e in zip(x[::2], x[1::2], strict=True):
            keep[base + s : base + e] = False
    return keep


def _digest_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in K.per_slice(batch.column("_text"), hashes=False):
            keep = _keep_mask(w, batch.column("spans").slice(a, b - a))
            removed = w.counts() - K.sums_by_doc(keep, w.doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(removed, pa.int64()), pa.array(_joined(w, keep), pa.string())], names=[f.name for f in RESULT])


def _kept_text(column: str, into: str):
    """Texts without the words of their spans: kept words with the white space after each; None spans: unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts, spans = batch.column(at).to_pylist(), batch.column(into).to_pylist()
            for i, flat in enumerate(spans):
                if flat:
                    w = K.Words(*K.utf8(pa.array([texts[i]])), hashes=False)
                    raw, edge = w.raw.tobytes(), [*w.start.tolist(), len(w.raw)]
                    parts, done = [raw[: edge[0]]], 0
                    for s, e in zip(flat[::2], flat[1::2], strict=True):
                        parts.append(raw[edge[done] : edge[s]])
                        done = min(e, len(w))
                    parts.append(raw[edge[done] :] if done < len(w) else b"")
                    texts[i] = b"".join(parts).decode().strip(" \t\n\x0b\x0c\r")
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


class Repeats:
    """The tables that say what repeats: `ones` (PASS_ONE without anchors), `copies`, and `spans` of the other documents.

    docs: (doc_id, _text) with ids that are neither null nor repeated."""

    def __init__(self, docs: DataFrame, length: int) -> None:
        self.length, self.docs = length, docs
        firsts = materialize(self.docs.mapInArrow(_pass_one(length), PASS_ONE), "pass_one")
        self.ones = firsts.drop("anchors")
        long = firsts.filter(F.col("n_words") >= length)
        groups = long.groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        groups = materialize(groups, "copy_groups")
        #: Documents that have an equal one; all their words go.
        self.copies = materialize(long.join(groups.select("d1", "d2", "n_words", "rep"), ["d1", "d2", "n_words"]).select("doc_id", "rep"), "copies")
        extra = self.copies.filter("doc_id <> rep").select("doc_id")
        unlike = long.join(extra, "doc_id", "left_anti")
        counted = unlike.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("c"))
        repeated = materialize(counted.filter("c > 1").select("anchor"), "anchors")
        met = materialize(unlike.select("doc_id", F.explode(F.array_distinct("anchors")).alias("anchor")).join(repeated, "anchor"), "met")
        wanted = met.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
        copied = self.copies.select(F.col("doc_id").alias("_copied"))
        wanted = wanted.join(copied, F.col("doc_id") == F.col("_copied"), "left").select("doc_id", "anchors", F.col("_copied").isNotNull().alias("copied"))
        self.candidates = materialize(self.docs.join(wanted, "doc_id"), "candidates")
        self.spans = self._spans()

    def _spans(self) -> DataFrame:
        length = self.length
        windows = self.candidates.mapInArrow(_window_hashes(length), "window long, doc long")
        twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("rep")).filter("c > 1")
        twice = materialize(twice.select("window", "rep"), "twice")
        per_rep = twice.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list("window").alias("windows"))
        segments = materialize(self.candidates.join(per_rep, "doc_id").mapInArrow(_segments(length), SEGMENTS), "segments")
        total = segments.agg(F.sum(F.size("words"))).first()[0] or 0
        shard_of = F.pmod(F.xxhash64("rep"), F.lit(1 + total // SHARD_WORDS))
        segments = segments.withColumn("shard", shard_of)
        # Documents that are copies lose all words anyway and need no spans.
        routed = self.candidates.filter("not copied").mapInArrow(_window_hashes(length), "window long, doc long").join(twice, "window")
        need = routed.select(F.col("doc").alias("doc_id"), shard_of.alias("shard")).distinct()
        need = materialize(need.join(self.ones.select("doc_id", "n_words"), "doc_id"), "need")
        load = need.groupBy("shard").agg((1 + F.floor(F.sum("n_words") / TASK_WORDS)).alias("parts"))
        load = materialize(load, "load")
        dealt = need.join(load, "shard").select("doc_id", "shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
        docs = dealt.join(self.candidates, "doc_id")
        shard = segments.join(load, "shard").select("shard", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        found = shard.groupBy("shard", "part").cogroup(docs.groupBy("shard", "part")).applyInArrow(_stream(length), SPANS)
        united = found.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("_flat"))
        return materialize(united.select("doc_id", _union_spans(F.col("_flat")).alias("spans")), "spans")


def _union_spans(flat):
    """Sorted disjoint spans from spans of several shards, all as flat lists."""
    n = F.size(flat) / 2
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), lambda i: F.struct(F.element_at(flat, 2 * i + 1).alias("s"), F.element_at(flat, 2 * i + 2).alias("e")))
    kind = "array<bigint>"

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(last, x["e"])))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) >= x["s"]), joined).otherwise(F.concat(acc, F.array(x["s"], x["e"])))

    return F.aggregate(F.array_sort(pairs), F.array().cast(kind), add)


def _keyed_docs(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str, DataFrame]:
    """df, its key column, and (doc_id, _text), where doc_id is the key."""
    prepare(df.sparkSession)
    whole, key = keyed(df, id_col)
    return whole, key, whole.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))


def repeated_passages(df: DataFrame, length: int = 35, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    whole, key, docs = _keyed_docs(df.select(id_col, text), id_col, text)

    def judged() -> DataFrame:
        found = Repeats(docs, length)
        changed = found.candidates.select("doc_id", "_text").join(found.spans, "doc_id").mapInArrow(_digest_kept, RESULT)
        nothing = F.sha2(F.lit(""), 256)
        gone = found.copies.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_gone"))
        changed = changed.select(F.col("doc_id").alias("_changed"), F.col("n_removed").alias("_n"), F.col("kept_sha256").alias("_sha"))
        rows = found.ones.join(gone, F.col("doc_id") == F.col("_id"), "left").join(changed, F.col("doc_id") == F.col("_changed"), "left")
        removed = F.when(F.col("_gone"), F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0)))
        return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.when(F.col("_gone"), nothing).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"))

    out = settle(df.sparkSession, "repeats", judged)
    if key == id_col:
        return out
    names = whole.select(F.col(key).alias("_key"), F.col(id_col).alias("_name"))
    return out.join(names, F.col("doc_id") == F.col("_key")).select(F.col("_name").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def remove_repeats(df: DataFrame, length: int = 35, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the words of repeated passages taken out of its texts, and the white space after them."""
    whole, key, docs = _keyed_docs(df, id_col, text)

    def spans_of() -> DataFrame:
        found = Repeats(docs, length)
        words = found.ones.select("doc_id", "n_words")
        gone = found.copies.select("doc_id").join(words, "doc_id").select("doc_id", F.array(F.lit(0).cast("long"), F.col("n_words")).alias("spans"))
        return found.spans.unionByName(gone)

    doc, into = unused(whole, "_doc"), unused(whole, "_spans")
    spans = settle(df.sparkSession, "all_spans", spans_of).select(F.col("doc_id").alias(doc), F.col("spans").alias(into))
    rows = whole.join(spans, whole[key] == spans[doc], "left").drop(doc)
    out = rows.mapInArrow(_kept_text(text, into), rows.schema).drop(into)
    return out if key == id_col else out.drop(key)
