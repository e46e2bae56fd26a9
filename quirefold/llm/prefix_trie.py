"""The prefix trie of conversations, by Patricia construction.

Conversations are sorted by their sequences of turns over range partitions, so that a common beginning, however
frequent, is spread over many tasks. Each partition is read once, in order: what neighbours have in common tells where
the compressed tree has its points (branches, ends and leaves), a stack holds the points of the path that is open, and
a point's sums are complete when it leaves the stack. Then the unary nodes of its edge are written out; they have the
point's members and leaves, and its saved tokens plus a suffix sum of the edge. Nodes that reach over the bounds of
partitions are written in parts and added up by key. Two numbers a partition, the turns that its ends share with its
neighbours, make every node count as new once, and every leaf once.

A turn is 16 bytes of the SHA-256 digest of role and text, and the text's code points: texts are never gathered, a
conversation's digests are one row. A node's key is a digest chained from the root.

Defined results: a null role or text is the empty string; turns are ordered by number (null first), of equal numbers by
role, then digest; repeated rows are turns of their own; rows with a null conversation are no conversation's; an empty
table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.store import materialize, prepare

#: Ids of conversations with the same turns that are written as one string.
CHUNK = 4096
#: Nodes and strings of ids that a task hands on at once.
ROWS = 4096
_KIND = pa.schema(
    [("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ids", pa.string())]
)
_SCHEMA = "key binary, parent binary, depth bigint, conv bigint, n bigint, children bigint, leaves bigint, saved bigint, ids string"
ROOT = b""


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns: array of (digest, chars) in order), a row for each conversation."""
    speaker, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(speaker).cast("string"), F.lit(":"), speaker, said), 256)), 1, 16)
    rows = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.struct(F.col(turn).alias("turn"), speaker.alias("role"), digest.alias("digest"), F.length(said).alias("chars")).alias("t"))
    in_order = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv").agg(F.transform(in_order, lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def _shared(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


class _Point:
    """A branch, end or leaf of the compressed tree: what is known of its members so far."""

    __slots__ = ("depth", "known", "n", "conv", "children", "leaves", "saved")

    def __init__(self, depth: int, known: int) -> None:
        self.depth, self.known = depth, known  # nodes of its edge down to `known` were met by an earlier partition
        self.n = self.children = self.leaves = self.saved = 0
        self.conv: int | None = None

    def add(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


class _Tree:
    """The compressed tree over the sorted conversations of one partition; finished nodes go to `rows`."""

    def __init__(self, before: int | None, behind: int) -> None:
        self.before, self.behind = before, behind
        self.stack = [_Point(0, -1 if before is None else 0)]
        self.path: list[bytes] = []
        self.chars: list[int] = []
        self.keys = [ROOT]
        self.ends: list[int] = []
        self.rows: list[tuple] = []
        self.first = True

    def add(self, conv: int, path: list[bytes], chars: list[int], after: int | None) -> None:
        """after: turns shared with the next conversation of the partition; None at its end."""
        depth = _shared(self.path, path)
        if len(self.path) > depth or len(path) > depth:
            self.end_ids()
        self.close(depth)
        del self.keys[depth + 1 :]
        for t in path[depth:]:
            self.keys.append(hashlib.blake2b(self.keys[-1] + t, digest_size=16).digest())
        self.path, self.chars = path, chars
        if len(path) > self.stack[-1].depth:
            self.stack.append(_Point(len(path), (self.before or 0) if self.first else depth))
        self.first = False
        top = self.stack[-1]
        top.add(1, conv)
        top.leaves += (self.behind if after is None else after) < len(path)
        self.ends.append(conv)
        if len(self.ends) == CHUNK:
            self.end_ids()

    def end_ids(self) -> None:
        if self.ends:
            self.rows.append((self.keys[-1], None, None, self.ends[0], None, None, None, None, ",".join(map(str, self.ends))))
            self.ends = []

    def close(self, depth: int) -> None:
        """Points below this depth are complete: their edges' nodes are written, their sums go to the point above."""
        while (top := self.stack[-1]).depth > depth:
            self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth, top.known))
            above = self.stack[-1]
            saved = top.saved
            for d in range(top.depth, above.depth, -1):
                saved += (top.n - (d > top.known)) * self.chars[d - 1]
                children = top.children if d == top.depth else int(d + 1 > top.known)
                self.rows.append((self.keys[d], self.keys[d - 1], d, top.conv, top.n, children, top.leaves, saved, None))
            above.add(top.n, top.conv)
            above.children += above.depth + 1 > top.known
            above.leaves += top.leaves
            above.saved += saved

    def finish(self) -> None:
        self.end_ids()
        self.close(0)
        root = self.stack[0]
        self.rows.append((ROOT, None, 0, root.conv, root.n, root.children, root.leaves, root.saved, None))


def _grow(bounds: dict[int, tuple[int | None, int]]):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("part", "conv", "path", "chars")), strict=True)

    def taken(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _KIND, strict=True)], schema=_KIND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held = None, None
        for row in rows(batches):
            if held:
                same = held[0] == row[0]
                tree.add(*held[1:], _shared(held[2], row[2]) if same else None)
                if not same:
                    tree.finish()
                    yield taken(tree.rows)
                    tree = None
                elif len(tree.rows) >= ROWS:
                    yield taken(tree.rows)
                    tree.rows = []
            tree, held = tree or _Tree(*bounds[row[0]]), row
        if held:
            tree.add(*held[1:], None)
            tree.finish()
            yield taken(tree.rows)

    return run


def _bounds(ordered: DataFrame) -> dict[int, tuple[int | None, int]]:
    """For each partition, how many turns its first conversation shares with the one before, and its last with the one
    behind: two numbers a partition. None and -1 where there is no such conversation."""
    ends = ordered.groupBy("part").agg(F.min_by("path", "seq").alias("first"), F.max_by("path", "seq").alias("last"))
    at = F.arrays_zip("last", F.lead("first").over(Window.orderBy("part")).alias("first"))
    same = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x["last"].eqNullSafe(x["first"])).cast("int")).alias("n"), (s["on"] & x["last"].eqNullSafe(x["first"])).alias("on")))["n"]
    out, before = {}, None
    for r in ends.select("part", same.alias("n")).orderBy("part").collect():
        out[r["part"]] = (before, -1 if r["n"] is None else r["n"])
        before = r["n"]
    return out


def _end_digests(ids: DataFrame) -> DataFrame:
    """(key, ends): the digest of all ids of a key, strings of ids in order; they stream through the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"])

    return ids.repartition("key").sortWithinPartitions("key", "conv").select("key", "ids").mapInArrow(run, "key binary, ends string")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """seqs (conv, turns: array of (digest, chars)) -> a row for each distinct beginning of d turns, d from 0:
    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prepare(seqs.sparkSession)
    flat = materialize(seqs.select("conv", F.col("turns.digest").alias("path"), F.col("turns.chars").alias("chars")), "sequences")
    ordered = flat.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "ordered")
    again = ordered.repartition("part").sortWithinPartitions("part", "seq").select("part", "conv", "path", "chars")
    parts = materialize(again.mapInArrow(_grow(_bounds(ordered)), _SCHEMA), "parts")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    nodes = parts.filter("ids is null").groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), *sums)
    nodes = materialize(nodes, "nodes")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    found = nodes.join(above, "parent", "left").join(_end_digests(parts.filter("ids is not null")), "key", "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
