"""Best-fit packing by hierarchical residual packing.

Documents become token pieces of at most the sequence length (only longer documents are cut; their first piece is the
shorter one). Pieces are then packed in rounds: every partition packs its own items best-fit, largest first, and emits
the bins that are nearly full; underfull bins go on as single items to the next round, in which several partitions
meet in one (a tree), until one partition has packed what is left or packing brings nothing more. Items of a round are
spread over as many partitions as keep each below a fixed number of rows, so no task's memory grows with the corpus,
and no key is involved that could be hot.

Defined results: a null text is the empty document, one end token; each piece appears once; rows that repeat an id are
documents of their own with the same piece numbers; a null id stays null; of pieces of one length any order will do;
very long texts are encoded whole and cut; an empty table gives no sequences; extra columns are not read, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.chunks import CHUNK_PATTERNS, ChunkEncoder, text_slices
from quirefold.llm.quality import broadcast_file
from quirefold.llm.store import materialize, prepare

#: Rows that one task packs at once.
ROWS_PER_TASK = 500_000
#: Partitions that meet in one at each level of the tree.
FAN_IN = 8
#: Free tokens up to which a bin counts as nearly full.
SLACK = 1

PIECE = T.StructType(
    [T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("offset", T.LongType()))]
)
BINS = T.StructType([T.StructField("fill", T.LongType()), T.StructField("items", T.ArrayType(PIECE))])


#: Letters and marks on whose classes all versions of the pre-token pattern agree, without the `<` of special tokens.
_COMMON_CHUNK = re.compile(r"[!-;=-~\u00a1-\u024f]+\Z")
_COMMON_TEXT = re.compile(r"[\n\t\r !-;=-~\u00a1-\u024f]+\Z")


#: The pattern of the library's byte-level pre-tokeniser.
BYTE_LEVEL_PATTERN = next(iter(CHUNK_PATTERNS))


class JsonTokenizer:
    """A vocabulary file of the `tokenizers` library; common chunks take a faster implementation of the same merges."""

    def __init__(self, json_bytes: bytes, ranks: bytes | None, pattern: str | None) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_bytes.decode())
        before = json.loads(json_bytes).get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if any("<" not in t.content for t in self.tokenizer.get_added_tokens_decoder().values()):
            ranks = None  # the patterns below tell texts with special tokens by this character only
        self.fast = None
        if ranks is not None:
            import tiktoken

            from quirefold.llm.bpe import parse_ranks

            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(ranks), special_tokens={})
        self.chunks = ChunkEncoder(self.whole, self.many, BYTE_LEVEL_PATTERN if usual and json.loads(json_bytes).get("normalizer") is None else None)

    def whole(self, text: str) -> bytes:
        if self.fast is not None and _COMMON_TEXT.match(text):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def many(self, chunks: list[str]) -> list[bytes]:
        """Chunks without white space are encoded in one go, a line each; a line's end is a token of its own."""
        if self.fast is None:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch([f" {c}" for c in chunks], add_special_tokens=False)]
        simple = [i for i, c in enumerate(chunks) if _COMMON_CHUNK.match(c)]
        out: list[bytes] = [b""] * len(chunks)
        for a in range(0, len(simple), 20_000):
            part = simple[a : a + 20_000]
            ids = np.asarray(self.fast.encode_to_numpy("".join(f" {chunks[i]}\n" for i in part), disallowed_special=()), dtype="<u4")
            ends = np.flatnonzero(ids == self.line_end).tolist()
            start = 0
            for i, end in zip(part, ends, strict=True):
                out[i] = ids[start:end].tobytes()
                start = end + 1
        for i in set(range(len(chunks))).difference(simple):
            out[i] = self.whole(f" {chunks[i]}")
        return out

    @property
    def line_end(self) -> int:
        return self.fast.encode_ordinary("\n")[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.chunks.encode(texts)


_tokenizers: dict[tuple, JsonTokenizer] = {}


def _cut(ids: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of one document's ids."""
    n = len(ids) // 4
    head = n if n <= size else n % size or size
    start = piece = 0
    while start < n:
        length = head if piece == 0 else size
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start += length
        piece += 1


def _pieces_of(model, digest, ranks, pattern: str | None, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (digest, ranks is None, pattern)
        if key not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[key] = JsonTokenizer(model.value, None if ranks is None else ranks.value, pattern)
        tokenizer, end = _tokenizers[key], array("I", [end_id]).tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            for a, b in text_slices(texts):
                rows = [(d, *p) for d, e in zip(ids[a:b], tokenizer.encode(texts[a:b]), strict=True) for p in _cut(e + end, size)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(df: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document. ranks_path: the same vocabulary as a rank file."""
    spark = prepare(df.sparkSession)
    model, digest = broadcast_file(spark, json_path)
    ranks = broadcast_file(spark, ranks_path)[0] if ranks_path else None
    schema = T.StructType(PIECE.fields[:5])
    return df.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(_pieces_of(model, digest, ranks, pattern, size, end_id), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item, best-fit with the largest first; number of bins."""
    bins = np.empty(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    some = 0  # bit r: room[r] is not empty
    count = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fitting = some >> s
        if fitting:
            free = s + (fitting & -fitting).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
            free -= s
        else:
            b, count, free = count, count + 1, capacity - s
        if free:
            room[free].append(b)
            some |= 1 << free
        bins[i] = b
    return bins, count


def _pack_rows(table: pa.Table, capacity: int) -> pa.Table:
    """Bins of the table's rows (bins themselves, or single pieces), with offsets moved."""
    fill = table.column("fill").to_numpy()
    items = table.column("items").combine_chunks()
    if isinstance(items, pa.ChunkedArray):
        items = pa.concat_arrays(items.chunks)
    bins, count = best_fit(fill, capacity)
    order = np.argsort(bins, kind="stable")
    taken = items.take(pa.array(order))
    lengths = np.diff(taken.offsets.to_numpy())
    ordered_bins, ordered_fill = bins[order], fill[order]
    before = np.concatenate([[0], np.cumsum(ordered_fill)[:-1]]) if len(order) else np.zeros(0, np.int64)
    first = np.searchsorted(ordered_bins, np.arange(count + 1))
    base = before - np.repeat(before[first[:-1]], np.diff(first)) if len(order) else before
    flat = taken.flatten()
    columns = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
    columns["offset"] = pa.array(columns["offset"].to_numpy(zero_copy_only=False) + np.repeat(base, lengths))
    bounds = np.concatenate([[0], np.cumsum(lengths)])[first].astype(np.int32)
    packed = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    total = np.add.reduceat(ordered_fill, first[:-1]) if count else np.zeros(0, np.int64)
    return pa.table({"fill": pa.array(total, pa.int64()), "items": pa.ListArray.from_arrays(pa.array(bounds), packed)})


def _pack_partition(capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield from _pack_rows(pa.Table.from_batches(held), capacity).to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield from flush()
                held, rows = [], 0
        yield from flush()

    return run


def pack(pieces: DataFrame, capacity: int = 1024, slack: int = SLACK, fan_in: int = FAN_IN, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with (sequence_id, offset)."""
    item = F.struct(*[F.col(f.name) for f in PIECE.fields[:5]], F.lit(0).cast("long").alias("offset"))
    fields = T.StructType(PIECE.fields)
    bins = pieces.select(F.col("length").alias("fill"), F.array(item).cast(T.ArrayType(fields)).alias("items"))
    full = F.col("fill") >= capacity - slack
    parts, dealt = [bins.filter(full)], bins.filter(~full)
    partitions, before = dealt.rdd.getNumPartitions(), None
    while True:
        packed = materialize(dealt.mapInArrow(_pack_partition(capacity, rows_per_task), BINS), "bins")
        under = packed.filter(~full).count()
        least = max(1, -(-under // rows_per_task))
        if under == 0 or (partitions <= least and (partitions == 1 or (before is not None and under >= before))):
            parts.append(packed)
            break
        parts.append(packed.filter(full))
        before, partitions = under, max(least, partitions // fan_in)
        dealt = packed.filter(~full).repartition(partitions)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    numbered = whole.withColumn("sequence_id", F.monotonically_increasing_id())
    return numbered.select("sequence_id", F.explode("items").alias("i")).select("i.doc_id", "i.piece", "i.start", "i.length", "i.ids_crc32", "sequence_id", "i.offset")


def pack_documents(df: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = 1024, end_id: int = 2) -> DataFrame:
    pieces = materialize(token_pieces(df, json_path, ranks_path, pattern, size, end_id), "pieces")
    return pack(pieces, size)
