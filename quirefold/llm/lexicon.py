"""BPE encoding and decoding of words with a minimal acyclic transducer as lexicon.

The vocabulary is a public tokenizer file of kind "BPE with word ends" whose normaliser lower-cases and drops white
space; its path is a parameter. The words of all texts are counted; the most frequent ones are merged once and compiled
into a minimal acyclic transducer: words that end alike share states, the ids stand on the arcs as early as they are
certain. It is written as flat arrays to one file, which executors fetch and map into memory. Words that it lacks are
merged exactly: of neighbouring pairs of linked symbols the lowest rank first, leftmost of equal ones. New words of a
batch walk the transducer and are merged together, in arrays; a word of more than `LONG` symbols has a heap of its own.

Texts are cut at ASCII white space, across which nothing is merged or composed. Parts of visible ASCII are normalised
and cut here; all others by the normaliser and pre-tokeniser of the file, in the library's own classes of letters.

Limits, none of which changes a result: the lexicon takes at most `most` words of at most `LONG` bytes that occur at
least `least` times; a worker's memo forgets all beyond `MEMO` parts.

Defined results: a null text counts as empty, has no ids and decodes to the empty string; the strings of special tokens
become their ids, as the library does; very long texts and words are encoded whole; of ids to decode, those that the
vocabulary lacks (null, negative, too large) are left out, as the library does; repeated rows are encoded alike; an
empty table gives an empty result; extra columns pass through, and the added ones avoid their names (`round_trip` leaves
out columns that have its names).
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.quality import broadcast_file
from quirefold.llm.store import materialize, prepare, unused

#: Bytes of the longest word of a lexicon, and of the longest part that a memo keeps.
LONG = 100
#: Parts of texts that a worker remembers.
MEMO = 600_000
#: Bytes of texts whose new parts are learnt together (a longer text is one group).
GROUP_BYTES = 4 << 20
#: No rank.
_NONE = 1 << 40
#: Words that are merged at once.
TOGETHER = 16_384
#: The pattern of words within visible ASCII, lower case, parts ending in a new line.
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")
_VISIBLE = re.compile(rb"[\x21-\x7e]+").fullmatch
#: Ends a part among words. Within text for the library it is a byte that stands alone there, as `_MARK_WORD`.
_END, _MARK, _MARK_WORD = "\n", "\x01", "\u0101"
#: Parts that the library cuts at once.
PARTS = 4096


class Builder:
    """Builds the minimal transducer of sorted words, state by state: a word's states are final once the next word
    leaves them, and a final state is replaced by an equal one that exists."""

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.frozen: list[tuple] = []
        self.open = [self._new()]
        self.word = b""

    @staticmethod
    def _new() -> list:
        return [None, {}]  # what a word that ends here adds, or None; label -> [target, ids]

    def _freeze(self, depth: int) -> None:
        """Open states below this depth get their numbers."""
        while len(self.open) > depth + 1:
            end, arcs = self.open.pop()
            state = (end, tuple((label, to, ids) for label, (to, ids) in sorted(arcs.items())))
            if state not in self.register:
                self.register[state] = len(self.frozen)
                self.frozen.append(state)
            self.open[-1][1][self.word[len(self.open) - 1]][0] = self.register[state]

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        """Words come in ascending order, each once."""
        depth = len(os.path.commonprefix([self.word, word]))
        self._freeze(depth)
        self.word = word
        for label in word[depth:]:
            self.open[-1][1][label] = [-1, ()]
            self.open.append(self._new())
        for k in range(depth):  # what both words add stays here, the rest of the earlier ones moves on
            arc, below = self.open[k][1][word[k]], self.open[k + 1]
            same = len(os.path.commonprefix([arc[1], ids]))
            rest, arc[1] = arc[1][same:], arc[1][:same]
            ids = ids[same:]
            if rest:
                for onward in below[1].values():
                    onward[1] = rest + onward[1]
                if below[0] is not None:
                    below[0] = rest + below[0]
        if depth < len(word):
            self.open[depth][1][word[depth]][1] = ids
            self.open[-1][0] = ()
        else:
            self.open[-1][0] = ids

    def pack(self) -> bytes:
        """The transducer as flat arrays: what ends add, arcs in order of state and label (both as one number, target, what
        they add), and the distinct sequences of ids; the root is the last state. Sequence 0 is empty; ends are counted
        from 1, 0 is no end."""
        self._freeze(0)
        end, arcs = self.open[0]
        states = [*self.frozen, (end, tuple((label, to, ids) for label, (to, ids) in sorted(arcs.items())))]
        numbers: dict[tuple, int] = {(): 0}
        number = lambda ids: numbers.setdefault(ids, len(numbers))
        ends, keys, targets, added = [], [], [], []
        for state, (end, arcs) in enumerate(states):
            ends.append(0 if end is None else 1 + number(end))
            for label, to, ids in arcs:
                keys.append(state << 8 | label)
                targets.append(to)
                added.append(number(ids))
        starts = np.cumsum([0, *map(len, numbers)])
        parts = [np.asarray(x, dtype="<i8").tobytes() for x in (ends, keys, targets, added, starts, [x for ids in numbers for x in ids])]
        return struct.pack("<6q", *map(len, parts)) + b"".join(parts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... as many as lengths[0], then the same for the next, and so on."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


class Lexicon:
    """A packed transducer, mapped from a file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, arrays = 48, []
        for size in struct.unpack("<6q", self.map[:48]):
            arrays.append(np.frombuffer(self.map, "<i8", size // 8, at))
            at += size
        self.ends, self.keys, self.targets, self.added, self.starts, self.ids = arrays

    def get(self, words: list[bytes]) -> list[list[int] | None]:
        """The words' ids, or None. All words take their steps through the transducer together."""
        if not words or not len(self.keys):
            return [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first, letters = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), len(self.ends) - 1)
        alive, steps = np.flatnonzero(sizes > 0), []
        state[sizes == 0] = -1
        for k in range(int(sizes.max())):
            if not len(alive):
                break
            key = state[alive] << 8 | letters[first[alive] + k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            state[alive[~there]] = -1
            alive, arc = alive[there], arc[there]
            state[alive] = self.targets[arc]
            adds = self.added[arc]
            steps.append((alive[adds > 0], adds[adds > 0]))
            alive = alive[sizes[alive] > k + 1]
        known = np.flatnonzero(state >= 0)
        known = known[self.ends[state[known]] > 0]
        steps.append((known, self.ends[state[known]] - 1))
        word, seq = (np.concatenate([s[i] for s in steps]) for i in (0, 1))
        found = np.zeros(len(words), dtype=bool)
        found[known] = True
        kept = np.flatnonzero(found[word])
        order = kept[np.argsort(word[kept], kind="stable")]  # a word's steps stay in order
        lengths = self.starts[seq[order] + 1] - self.starts[seq[order]]
        ids = self.ids[ragged(self.starts[seq[order]], lengths)].tolist()
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word[order], weights=lengths, minlength=len(words)).astype(np.int64), out=bounds[1:])
        bounds = bounds.tolist()
        return [ids[bounds[i] : bounds[i + 1]] if f else None for i, f in enumerate(found.tolist())]


class Words:
    """The vocabulary: words of a part of a text, and the exact merging of a word."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        spec, tokenizer = json.loads(data), Tokenizer.from_str(data.decode())
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["decoder"] or model["continuing_subword_prefix"] or any(not t["special"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("not a BPE vocabulary with word ends and plain special tokens")
        self.normal, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.rank = {self.vocab[a] << 32 | self.vocab[b]: r for r, (a, b) in reversed([*enumerate(pairs)])}
        self.special = {t["content"]: t["id"] for t in added}
        self.find_special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True)) or "(?!)").split
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self.made_of = np.asarray(self.made, np.int64)
        #: Ids of single symbols by code point, within a word and at its end.
        self.inner, self.last = (np.asarray([self.vocab.get(chr(c) + e, -1) for c in range(512)], np.int64) for e in ("", self.end))

    def words(self, part: bytes) -> list[str | int]:
        """Words of a part without ASCII white space, as strings of byte characters; special tokens as ids."""
        out: list[str | int] = []
        for piece in filter(None, self.find_special(part.decode())):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out += [w for w, _ in self.cut(self.normal(piece))]
        return out

    def cut_all(self, parts: list[bytes]) -> Iterator[tuple[list[bytes], list[str | int]]]:
        """Groups of these parts and their `words`, an end after each part's. Nothing is composed or joined across a blank,
        so parts are cut together."""
        ascii_, odd, special = [], [], []
        for p in parts:
            (special if b"<|" in p or b"\x01" in p else ascii_ if p.isascii() else odd).append(p)
        if ascii_ and not _VISIBLE(b"".join(ascii_)):
            odd += [p for p in ascii_ if not _VISIBLE(p)]
            ascii_ = [p for p in ascii_ if _VISIBLE(p)]
        if ascii_:
            yield ascii_, _ASCII_WORD.findall(b"\n".join([*ascii_, b""]).decode().lower())
        for a in range(0, len(odd), PARTS):
            group = odd[a : a + PARTS]
            text = self.normal(f" {_MARK} ".join([*map(bytes.decode, group), ""]))
            yield group, [_END if w == _MARK_WORD else w for w, _ in self.cut(text)]
        if special:
            yield special, [w for p in special for w in [*self.words(p), _END]]

    def merge(self, word: str) -> list[int]:
        """The word's symbols, the last with the word's end, merged by rank, then from the left."""
        part = [i for s in [*word[:-1], word[-1] + self.end] if (i := self.vocab.get(s)) is not None]
        n, rank_of = len(part), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [rank_of(a << 32 | b, -1) for a, b in zip(part, part[1:], strict=False)] + [-1]  # of the symbol here with the next
        heap = [(r, i) for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if rank[i] != r:
                continue  # of an earlier state
            j = after[i]
            e = after[i] = after[j]
            part[i], part[j], rank[j] = self.made[r], -1, -1
            rank[i] = -1
            if e < n:
                before[e] = i
                rank[i] = rank_of(part[i] << 32 | part[e], -1)
                if rank[i] >= 0:
                    heappush(heap, (rank[i], i))
            if (p := before[i]) >= 0:
                rank[p] = rank_of(part[p] << 32 | part[i], -1)
                if rank[p] >= 0:
                    heappush(heap, (rank[p], p))
        return [i for i in part if i >= 0]


    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """`merge` of each word; words of like lengths are merged together, a pair of each at a time."""
        out: list[list[int] | None] = [None] * len(words)
        by_size = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(by_size), TOGETHER):
            group = by_size[a : a + TOGETHER]
            short = [i for i in group if 0 < len(words[i]) <= LONG and len(self.pair_keys)]
            for i, ids in zip(short, self._merge_together([words[i] for i in short]), strict=True):
                out[i] = ids
        return [self.merge(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _merge_together(self, words: list[str]) -> list[list[int] | None]:
        """None for a word with a symbol that has no id."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n, width = len(words), int(sizes.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        row, place = np.repeat(np.arange(n), sizes), ragged(np.zeros(n, np.int64), sizes)
        at_end = place == sizes[row] - 1
        plain = np.minimum(codes, 511)
        ids = np.where(codes < 512, np.where(at_end, self.last[plain], self.inner[plain]), -1)
        part = np.full((n, width + 1), -1)
        part[row, place] = ids
        odd = np.zeros(n, dtype=bool)
        odd[row[ids < 0]] = True
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        rank = np.full((n, width + 1), _NONE)
        inner = np.flatnonzero(~at_end)
        rank[row[inner], place[inner]] = self._ranks(part[row[inner], place[inner]], part[row[inner], place[inner] + 1])
        rows = np.flatnonzero(~odd)
        while len(rows):
            i = rank[rows].argmin(1)
            r = rank[rows, i]
            going = r < _NONE
            rows, i, r = rows[going], i[going], r[going]
            j = after[rows, i]
            e = after[rows, j]
            after[rows, i] = e
            part[rows, i] = made = self.made_of[r]
            part[rows, j] = -1
            rank[rows, j] = rank[rows, i] = _NONE
            on = e < sizes[rows]
            x, at, to = rows[on], i[on], e[on]
            before[x, to] = at
            rank[x, at] = self._ranks(made[on], part[x, to])
            p = before[rows, i]
            on = p >= 0
            x, at = rows[on], p[on]
            rank[x, at] = self._ranks(part[x, at], made[on])
        kept = part >= 0
        bounds = np.concatenate([[0], np.cumsum(kept.sum(1))]).tolist()
        flat = part[kept].tolist()
        return [None if o else flat[bounds[k] : bounds[k + 1]] for k, o in enumerate(odd.tolist())]


class Codec:
    def __init__(self, words: Words, lexicon: Lexicon) -> None:
        self.words, self.lexicon = words, lexicon
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}  # part -> its ids, in decimals, and what they decode to
        self.end = -1
        self.decimal = {i: b"%d" % i for i in words.token} | {self.end: b"\n"}
        self.token = {i: t.encode() for i, t in words.token.items()} | {self.end: b"\n"}

    def learn(self, parts: list[bytes]) -> None:
        """Encode and decode these parts of texts for the memo."""
        for group, words in self.words.cut_all(parts):
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            new = [w for w in number if isinstance(w, str) and w != _END]
            ids_of: dict[str | int, list[int]] = dict(zip(new, self.lexicon.get([w.encode() for w in new]), strict=True))
            unseen = [w for w, ids in ids_of.items() if ids is None]
            ids_of.update(zip(unseen, self.words.merge_all(unseen), strict=True))
            every = [[self.end] if w == _END else [w] if isinstance(w, int) else ids_of[w] for w in number]
            lengths = np.fromiter(map(len, every), np.int64, len(every))
            flat, at = np.fromiter(chain.from_iterable(every), np.int64, lengths.sum()), np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            ids = flat[ragged((np.cumsum(lengths) - lengths)[at], lengths[at])].tolist()
            written = [map(bytes.strip, b" ".join(map(name.__getitem__, ids)).split(b"\n")) for name in (self.decimal, self.token)]
            self.memo.update(zip(group, zip(*written, strict=True), strict=False))

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each text's ids, in decimals joined by blanks, and what they decode to. The new parts of a few texts are learnt
        together; the memo forgets only between such groups, and keeps no long parts."""
        a = 0
        while a < len(texts):
            b, split, size = a, [], 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= GROUP_BYTES):
                split.append(texts[b].split())  # at ASCII white space
                size += len(texts[b])
                b += 1
            new = set().union(*split).difference(self.memo)
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = set().union(*split)
            self.learn([*new])
            for parts in split:
                ids, tokens = zip(*map(self.memo.__getitem__, parts), strict=True) if parts else ((), ())
                yield b" ".join(filter(None, ids)), b" ".join(filter(None, tokens))
            for p in new:
                if len(p) > LONG:
                    del self.memo[p]
            a = b

    def decode(self, ids: Iterable[int | None]) -> str:
        return " ".join([t for t in map(self.words.token.get, ids) if t is not None])


_words: dict[str, Words] = {}
_codecs: dict[tuple[str, str], Codec] = {}


def _vocabulary(data, digest: str) -> Words:
    if digest not in _words:
        _words.clear()
        _words[digest] = Words(data.value)
    return _words[digest]


def _codec(data, digest: str, lexicon: str) -> Codec:
    if (digest, lexicon) not in _codecs:
        _codecs.clear()
        _codecs[digest, lexicon] = Codec(_vocabulary(data, digest), Lexicon(SparkFiles.get(lexicon)))
    return _codecs[digest, lexicon]


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def word_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n): how often each word of at most `LONG` bytes occurs in all texts."""
    spark = prepare(df.sparkSession)
    data, digest = broadcast_file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, parts = _vocabulary(data, digest), Counter()

        def taken() -> pa.RecordBatch:
            words: Counter = Counter()
            for group, cut in vocabulary.cut_all([*parts]):
                number = {w: k for k, w in enumerate(dict.fromkeys(cut))}
                at = np.fromiter(map(number.__getitem__, cut), np.int64, len(cut))
                ends = at == number[_END]
                part = np.cumsum(ends) - ends
                times = np.fromiter(map(parts.__getitem__, group), np.int64, len(group))
                sums = np.bincount(at, weights=times[part]).astype(np.int64).tolist()
                for w, k in number.items():
                    if isinstance(w, str) and w != _END and len(w) <= LONG and len(w.encode()) <= LONG:
                        words[w] += sums[k]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([*words], pa.string()), pa.array([*words.values()], pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in _texts(batch, "text"):
                parts.update(t.split())
                if len(parts) > MEMO:
                    yield taken()
        yield taken()

    found = df.select(F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(df: DataFrame, path: str, text: str = "text", most: int = 30_000, least: int = 2) -> str:
    """The name under which executors find the transducer of the most frequent words: at most `most` of them go to the
    driver, which writes the file and gives it to Spark. Words of like frequency (to an eighth of a power of two) are
    taken together, from the most frequent on, as far as all of them fit."""
    spark = df.sparkSession
    class_of = F.floor(F.log2("n") * 8)
    counts = materialize(word_counts(df, path, text).filter(F.col("n") >= least), "words")
    room, lowest = most, None
    for r in sorted(counts.groupBy(class_of.alias("c")).count().collect(), reverse=True):  # at most 8 rows a power of two
        if (room := room - r["count"]) < 0:
            break
        lowest = r["c"]
    frequent = counts.filter(class_of >= lowest).collect() if lowest is not None else []
    with open(path, "rb") as f:
        words = Words(f.read())
    builder = Builder()
    known = sorted((r["word"].encode(), r["word"]) for r in frequent)
    for (key, _), ids in zip(known, words.merge_all([word for _, word in known]), strict=True):
        builder.add(key, tuple(ids))
    file = os.path.join(tempfile.mkdtemp(prefix="quirefold-lexicon-"), f"{uuid.uuid4().hex}.lexicon")
    with open(file, "wb") as f:
        f.write(builder.pack())
    spark.sparkContext.addFile(file)
    return os.path.basename(file)


def _apply(df: DataFrame, path: str, lexicon: str, column: str, what: str, kind: T.DataType, into: str) -> DataFrame:
    spark = prepare(df.sparkSession)
    data, digest = broadcast_file(spark, path)
    into = unused(df, into)

    def digests(codec: Codec, batch: pa.RecordBatch) -> pa.Array:
        found = [*codec.encode(_texts(batch, column))]
        return pa.StructArray.from_arrays(
            [
                pa.array([ids.count(b" ") + (ids != b"") for ids, _ in found], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                pa.array([hashlib.sha256(tokens).hexdigest() for _, tokens in found], pa.string()),
            ],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, digest, lexicon)
        for batch in batches:
            if what == "digests":
                out = digests(codec, batch)
            elif what == "ids":
                out = pa.array([[int(i) for i in ids.split()] for ids, _ in codec.encode(_texts(batch, column))], pa.list_(pa.int32()))
            else:
                out = pa.array([codec.decode(x or []) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, kind)]))


def encode(df: DataFrame, path: str, lexicon: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with each text's token ids. lexicon: of `compile_lexicon`, of the same vocabulary."""
    return _apply(df, path, lexicon, text, "ids", T.ArrayType(T.IntegerType()), into)


def decode(df: DataFrame, path: str, lexicon: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with what each row's ids decode to: the tokens joined by blanks."""
    return _apply(df, path, lexicon, ids, "decode", T.StringType(), into)


def round_trip(df: DataFrame, path: str, lexicon: str, text: str = "text") -> DataFrame:
    """df with the number of ids, the digest of the ids in decimals joined by blanks, and that of the decoded text."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    out = _apply(df, path, lexicon, text, "digests", kind, "round_trip")
    taken = {text.lower(), *(f.name for f in kind.fields)}
    kept = [F.col(c) for c in df.columns if c.lower() not in taken]
    return out.select(*kept, f"{out.columns[-1]}.*")
