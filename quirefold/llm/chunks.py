"""Encode texts by blank-separated chunks.

Byte-level BPE with the usual pre-token pattern never joins characters across a blank that follows anything but white
space: ``" word"`` is encoded alike wherever it stands. So a text is split at its blanks, each distinct chunk is
encoded once per worker (a memo of bounded bytes), and a text's ids are the chunks' ids put together. A text in which a
chunk is empty, starts with white space (runs of white space, then) or is long is encoded as a whole by the plain way.
That holds for the patterns listed here; with another one every text is encoded as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np

_NO_WHITE = re.compile(r"\S+\Z")

# Pre-token patterns for which chunks may be encoded one by one.
CHUNK_PATTERNS = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])
#: Bytes that a worker's memo takes at most, about; then it forgets all and goes on. Only speed depends on it.
MEMO_BYTES = 192 << 20
#: What an entry takes besides its characters and ids, and characters of the longest chunk that is remembered.
ENTRY_BYTES, LONG_CHUNK = 200, 100


class Memo(dict):
    """What is known of short strings, within a number of bytes."""

    def __init__(self, limit: int | None = None) -> None:
        super().__init__()
        self.limit, self.used = limit or MEMO_BYTES, 0

    def room_for(self, entries: int, size: int) -> None:
        """Forget all, if so many more entries, of so many characters and bytes together, do not fit."""
        self.used += entries * ENTRY_BYTES + 2 * size
        if self.used > self.limit:
            self.clear()
            self.used = entries * ENTRY_BYTES + 2 * size

    def put(self, key: str, value: bytes) -> bytes:
        if len(key) <= LONG_CHUNK:
            self.room_for(1, len(key) + len(value))
            self[key] = value
        return value


class ChunkEncoder:
    """whole(text) and many(chunks, each to be preceded by a blank) give ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, whole: Callable[[str], bytes], many: Callable[[list[str]], Iterable[bytes]], pattern: str | None) -> None:
        self.whole, self.many, self.by_chunk = whole, many, pattern in CHUNK_PATTERNS
        self.memo = Memo()

    def encode(self, texts: list[str]) -> list[bytes]:
        # a memo that cannot hold the chunks of these texts is of no use
        if not self.by_chunk or ENTRY_BYTES * sum(t.count(" ") for t in texts) > 4 * MEMO_BYTES:
            return [self.whole(t) for t in texts]
        memo = self.memo
        split = [t.split(" ") for t in texts]
        new = set().union(*(chunks[1:] for chunks in split)).difference(memo)
        plain = [c for c in new if c and len(c) <= LONG_CHUNK and not c[0].isspace()]
        if ENTRY_BYTES * len(plain) > MEMO_BYTES:
            return [self.whole(t) for t in texts]
        memo.room_for(len(plain), 2 * sum(map(len, plain)))
        if not memo:  # forgotten: what these texts need is needed again
            known = set().union(*(chunks[1:] for chunks in split))
            plain = [c for c in known if c and len(c) <= LONG_CHUNK and not c[0].isspace()]
        memo.update(zip(plain, self.many(plain), strict=True))
        out = []
        for text, chunks in zip(texts, split, strict=True):
            try:  # after a leading blank the first chunk is empty: the blank belongs to the next
                rest = [*map(memo.__getitem__, chunks[1:])]
            except KeyError:
                out.append(self.whole(text))
            else:
                out.append(b"".join([self.whole(chunks[0]) if chunks[0] else b"", *rest]))
        return out


class RankEncoder:
    """A byte-level vocabulary given as ranks, by the library; for `ChunkEncoder`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size, self.line_end = max(ranks.values()) + 1, ranks.get(b"\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def many(self, chunks: list[str]) -> list[bytes]:
        """Chunks without white space are encoded in one go, a line each; a line's end is a token of its own."""
        plain = [i for i, c in enumerate(chunks) if _NO_WHITE.match(c)] if self.line_end is not None else []
        out: list[bytes | None] = [None] * len(chunks)
        for a in range(0, len(plain), 20_000):
            part = plain[a : a + 20_000]
            ids = np.asarray(self.encoding.encode_to_numpy("".join(f" {chunks[i]}\n" for i in part), disallowed_special=()), dtype="<u4")
            ends = np.flatnonzero(ids == self.line_end).tolist()
            start = 0
            for i, end in zip(part, ends, strict=True):
                out[i] = ids[start:end].tobytes()
                start = end + 1
        return [self.whole(f" {c}") if x is None else x for c, x in zip(chunks, out, strict=True)]


def text_slices(texts: list[str], most: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of about `most` characters, or one longer text."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
