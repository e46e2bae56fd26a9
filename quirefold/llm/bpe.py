"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as a whole. Tier two, for the
misses: a heap of adjacent pairs over a linked list of bytes merges the pair of lowest rank, leftmost first, until no
pair is in the vocabulary; it takes n log n steps however long a pre-token is. Ranks come from a public vocabulary file
whose path is a parameter; the file is read on the driver and broadcast after a check of its size. Which characters are
letters and digits depends on a library's edition of Unicode: it is that of the tiktoken library (`library_pattern`).

Row-local: no shuffle; a worker holds one Arrow batch, the vocabulary and memos of bounded bytes. Any pre-token
pattern of the `regex` library will do; those of chunks.py are faster.

Defined results: a null text counts as empty, has no ids and decodes to the empty string; very long texts and very
long runs without blanks are encoded whole; decoding inverts encoding byte for byte; of other ids, those that the
vocabulary lacks (null, negative, too large) decode to the replacement character, a null list to the empty string;
repeated rows are encoded alike; an empty table gives an empty result; extra columns pass through, and the added ones
avoid their names (`round_trip` leaves out columns that have its names).
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.chunks import ChunkEncoder, Memo, text_slices
from quirefold.llm.quality import broadcast_file
from quirefold.llm.store import prepare, unused

_MASK = (1 << 64) - 1
#: What an id without a token decodes to.
UNKNOWN = "\ufffd".encode()
#: Odd multipliers of the displacement hash.
_STEP, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """A minimal perfect hash by displacement: n keys to n slots, each slot of one key; other keys are detected."""

    #: Mean keys of a bucket.
    BUCKET = 4

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.n_buckets = max(1, n // self.BUCKET)
        self.displace = [0] * self.n_buckets
        self.slots: list[bytes | None] = [None] * n
        self.index = [0] * n
        buckets: dict[int, list[int]] = {}
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets.setdefault(h % self.n_buckets, []).append(i)
        taken = np.zeros(n, dtype=bool)
        lone = [b for b, members in buckets.items() if len(members) == 1]
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            own, first = np.array([hashes[i] for i in members], dtype=np.uint64)[:, None], 0
            while True:  # tries many displacements at once
                tries = np.arange(first, first + 256, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    places = ((own ^ (tries * np.uint64(_STEP))) * np.uint64(_SPREAD) >> np.uint64(31)) % np.uint64(n)
                good = ~taken[places].any(0) & (np.diff(np.sort(places, 0), axis=0) > 0).all(0)
                if good.any():
                    break
                first += 256
            k = int(good.argmax())
            self._put(b, first + k, members, places[:, k].tolist(), keys)
            taken[places[:, k]] = True
        for b, p in zip(lone, np.flatnonzero(~taken).tolist(), strict=True):  # single keys take what slots are left
            self._put(b, -p - 1, buckets[b], [p], keys)

    def _put(self, bucket: int, displacement: int, members: list[int], places: list[int], keys: list[bytes]) -> None:
        self.displace[bucket] = displacement
        for p, i in zip(places, members, strict=True):
            self.slots[p], self.index[p] = keys[i], i

    def _place(self, h: int, d: int) -> int:
        return (((h ^ (d * _STEP & _MASK)) * _SPREAD & _MASK) >> 31) % self.n

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.n_buckets]
        p = -d - 1 if d < 0 else self._place(h, d)
        return self.index[p] if self.slots[p] == key else -1


class Merger:
    """Tier two: merges the bytes of a pre-token by rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: Ids of two adjacent parts -> id of both together.
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    def ids(self, piece: bytes) -> list[int]:
        """Pairs of parts are merged by rank, then from the left, as long as any is a token."""
        n, pair = len(piece), self.pairs.get
        part = [self.single[b] for b in piece]  # id of the part that starts here
        if n == 1:
            return part
        after = list(range(1, n + 1))  # where the next part starts
        before = list(range(-1, n - 1))
        rank = [pair(a << 32 | b, -1) for a, b in zip(part, part[1:], strict=False)]  # of the part here with the next; -1: no token, or no part starts here
        rank.append(-1)
        shift = n.bit_length()
        low = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & low
            r = top >> shift
            if rank[i] != r:
                continue  # of an earlier state
            j = after[i]
            e = after[i] = after[j]
            part[i] = r
            rank[j] = part[j] = -1
            if e < n:
                before[e] = i
                x = rank[i] = pair(r << 32 | part[e], -1)
                if x >= 0:
                    heappush(heap, x << shift | i)
            else:
                rank[i] = -1
            if i:
                p = before[i]
                x = rank[p] = pair(part[p] << 32 | r, -1)
                if x >= 0:
                    heappush(heap, x << shift | p)
        return [x for x in part if x >= 0]


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def library_members(kind: str) -> set[int]:
    """The code points that the tiktoken library takes for members of a class such as \\p{L}: of a text of all of them, what
    it encodes when asked for runs of the class."""
    import tiktoken

    asked = tiktoken.Encoding("bytes", pat_str=f"{kind}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return {ord(c) for a in range(0, 0x110000, 0x1000) for c in bytes(asked.encode_ordinary("".join(_points(a, a + 0x1000)))).decode()}


def _points(start: int, end: int) -> list[str]:
    return [chr(c) for c in range(start, end) if not 0xD800 <= c < 0xE000]


@cache
def library_pattern(pattern: str) -> str:
    """pattern for the `regex` library, with letters and digits as the tiktoken library knows them."""
    import regex

    every = "".join(_points(0, 0x110000))
    for kind in (r"\p{L}", r"\p{N}"):
        own, theirs = set(map(ord, regex.findall(kind, every))), library_members(kind)
        less, more = _ranges(own - theirs), _ranges(theirs - own)
        if less or more:
            pattern = pattern.replace(kind, f"[{f'[{kind}--[{less}]]' if less else kind}{more}]")
    return f"(?V1){pattern}"


def _ranges(points: set[int]) -> str:
    """Code points as ranges of a character class."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, exact: str | None = None) -> None:
        """exact: the pattern for texts beyond ASCII, see `library_pattern`."""
        import regex

        tokens = list(ranks)
        self.perfect = PerfectHash(tokens)
        self.merger = Merger(ranks)
        self.id_of = [ranks[t] for t in tokens]
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.find = regex.compile(pattern).findall
        self.exact = regex.compile(exact or library_pattern(pattern)).findall
        self.memo = Memo()
        self.chunks = ChunkEncoder(self.whole, lambda chunks: [self.chunk(c) for c in chunks], pattern)

    def pre_token(self, s: str) -> bytes:
        piece = s.encode()
        k = self.perfect.get(piece)
        return array("I", [self.id_of[k]] if k >= 0 else self.merger.ids(piece)).tobytes()

    def known(self, s: str) -> bytes:
        ids = self.memo.get(s)
        return self.memo.put(s, self.pre_token(s)) if ids is None else ids

    def chunk(self, c: str) -> bytes:
        """A chunk after a blank. Words, and words before one mark, need no pattern."""
        if c.isalpha():
            return self.chunks.memo.get(c) or self.pre_token(f" {c}")
        if c[-1] in ".,;:!?" and c[:-1].isalpha():
            return self.word(c[:-1]) + self.known(c[-1])
        return self.whole(f" {c}")

    def word(self, c: str) -> bytes:
        """A word after a blank; it goes to the memo of chunks."""
        ids = self.chunks.memo.get(c)
        return self.chunks.memo.put(c, self.pre_token(f" {c}")) if ids is None else ids

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.known, (self.find if text.isascii() else self.exact)(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.chunks.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode_any(self, ids: list[int | None]) -> bytes:
        """The same for ids of any origin."""
        n = len(self.token)
        return b"".join(self.token[i] if i is not None and 0 <= i < n and self.token[i] else UNKNOWN for i in ids)


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(data, digest: str, pattern: str, exact: str) -> Codec:
    if (digest, pattern) not in _codecs:
        _codecs.clear()
        _codecs[digest, pattern] = Codec(parse_ranks(data.value), pattern, exact)
    return _codecs[digest, pattern]


def _run(data, digest: str, pattern: str, exact: str, column: str, what: str, into: str):
    def digests(codec: Codec, texts: list[str]) -> pa.StructArray:
        encoded = codec.encode(texts)
        return pa.StructArray.from_arrays(
            [
                pa.array([len(e) // 4 for e in encoded], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                pa.array([hashlib.sha256(codec.decode(e)).hexdigest() for e in encoded], pa.string()),
            ],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    def ids(codec: Codec, texts: list[str]) -> pa.Array:
        encoded = codec.encode(texts)
        bounds = np.cumsum([0, *(len(e) // 4 for e in encoded)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32)))

    def texts_of(codec: Codec, lists: list[list[int] | None]) -> pa.Array:
        return pa.array([codec.decode_any(x or []).decode("utf-8", "replace") for x in lists], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, digest, pattern, exact)
        for batch in batches:
            values = batch.column(column).to_pylist()
            if what == "decode":
                yield pa.RecordBatch.from_arrays([*batch.columns, texts_of(codec, values)], names=[*batch.schema.names, into])
                continue
            values = [v or "" for v in values]
            for a, b in text_slices(values):
                out = (ids if what == "ids" else digests)(codec, values[a:b])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, out], names=[*batch.schema.names, into])

    return run


def _apply(df: DataFrame, path: str, pattern: str, column: str, what: str, kind: T.DataType, into: str) -> DataFrame:
    spark = prepare(df.sparkSession)
    into = unused(df, into)
    schema = T.StructType([*df.schema.fields, T.StructField(into, kind)])
    return df.mapInArrow(_run(*broadcast_file(spark, path), pattern, library_pattern(pattern), column, what, into), schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with each text's token ids."""
    return _apply(df, path, pattern, text, "ids", T.ArrayType(T.IntegerType()), into)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text of each row's ids; bytes that are no UTF-8, and ids without a token, become replacement characters."""
    return _apply(df, path, pattern, ids, "decode", T.StringType(), into)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with a struct of the ids' number and digest, and the digest of the decoded bytes, as columns."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    out = _apply(df, path, pattern, text, "digests", kind, "round_trip")
    taken = {text.lower(), *(f.name for f in kind.fields)}
    kept = [F.col(c) for c in df.columns if c.lower() not in taken]
    return out.select(*kept, f"{out.columns[-1]}.*")
