"""Near duplicates by MinHash with tensored banding, every link verified on full shingle sets.

Candidates. Two small collections of min-hash bands, A and B, of `side` bands each; a table key is a pair of one band
of either, so side * side tables cost only 2 * side bands of hashing: about the square root. A pair of documents is a
candidate if it agrees on a band of A and on one of B. With six rows a band and side 26, a pair at similarity 0.8 is
missed with probability 0.0008, at 0.85 with 0.00001; a pair at 0.5 is a candidate with probability 0.11, at 0.4 with 0.01.

Links without pairs. Documents with equal shingle sets are one class and are represented by their smallest id. Bands
that one class only has are dropped before any table is formed. Of each band's members the least is its centre; a member
that agrees with a centre on both sides is compared with it, first with one centre each, then with those of other
components. So a large group of near copies becomes one component by a number of comparisons that is linear in its size,
and bands whose members are all in one component are done with. Only documents that still share bands with other
components on both sides get table keys: the pairs of their open bands. Tables are dealt to tasks by their band of A, and
where that has very many members by the pair; two documents are compared in the first table that they share. In tables
with members of several components the rows outside the largest one meet all rows of the table, in tasks that hold a
bounded block of either side (or many small tables). There too, sizes and a sketch of 256 min-hash bytes are compared before any text is fetched; a pair at
the threshold fails the sketch with a probability below 0.00001. Of a small table the pairs that pass leave the task, of
a large one only links. So no list of all pairs is ever made, and no bucket is capped.

Bands, centres and components are aggregated before they are shuffled, joins back are such that adaptive execution
can split them; intermediate tables are in the shared folder and are deleted once the components are written.

Defined results: words are lower-cased in A-Z only; a document with fewer words than a shingle has its whole sequence
as one; a null or wordless text has no shingle, is linked with nothing and kept; equal texts are linked, and of them the
smallest id stands for all; very long texts are compared whole; rows with a null id and rows that repeat an id are
documents of their own, judged by their own texts (the component of null ids alone is null); an empty table gives an
empty result; other columns are not read, and `drop_near_duplicates` passes them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm import textkit as K
from quirefold.llm.graph import components
from quirefold.llm.store import keyed, materialize, prepare, settle

ROWS_PER_BAND = 6
SIDE = 26
#: Min-hashes whose lowest bytes are a document's sketch.
SKETCH = 256
#: Standard deviations below the threshold at which a sketch speaks against a link.
SKETCH_DEVIATIONS = 5.0
#: Tables of at most so many rows are compared as pairs.
SMALL_TABLE = 32
#: Rows of a large table that a task holds on either side, about; rows and shingles, where it has their texts.
BLOCK_ROWS = 4096
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 400_000
#: Rows of tables of less than a block that go to one task, about, and pairs that it compares at a time.
TABLE_ROWS_PER_TASK = 100_000
PAIRS_AT_ONCE = 50_000

_LONG = T.LongType()
SIGNATURES = T.StructType(
    [T.StructField(n, _LONG) for n in ("doc", "n_shingles", "s1", "s2")] + [T.StructField("bands", T.ArrayType(_LONG)), T.StructField("sketch", T.BinaryType())]
)
LINKS = T.StructType([T.StructField("u", _LONG), T.StructField("v", _LONG)])


def shingle_sets(w: K.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their bounds."""
    counts = w.counts()
    grams, fits = w.ngrams(k)
    doc_of = w.doc_of()
    short = (counts > 0) & (counts < k)
    if short.any():  # the whole sequence is the shingle
        firsts = w.doc[:-1][short]
        for d, i in zip(np.flatnonzero(short).tolist(), firsts.tolist(), strict=True):
            grams[i] = K.ngram_hashes(w.hash[i : i + int(counts[d])], int(counts[d]))[0]
        fits[firsts] = True
    g, d = grams[fits], doc_of[fits]
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(len(counts) + 1))


def _seeds(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, (2, n), dtype=np.uint32) | np.array([[0], [1]], dtype=np.uint32)


def min_hashes(g: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n min-hashes (32 bits) of each document's shingles, documents in columns; 0 for documents without any."""
    out = np.zeros((n, len(bounds) - 1), dtype=np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        x, starts = (g >> np.uint64(32)).astype(np.uint32), bounds[:-1][some]
        flip, mult = _seeds(n)
        y = np.empty_like(x)
        for i in range(n):
            np.bitwise_xor(x, flip[i], out=y)
            np.multiply(y, mult[i], out=y)
            out[i, some] = np.minimum.reduceat(y, starts)
    return out


def band_keys(hashes: np.ndarray, side: int, rows: int) -> np.ndarray:
    """Keys (documents, 2 * side): each is a hash of `rows` min-hashes; the lowest bit tells the collection, A or B."""
    keys = np.empty((hashes.shape[1], 2 * side), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(2 * side):
            key = np.full(hashes.shape[1], b + 1, dtype=np.uint64)
            for r in range(b * rows, (b + 1) * rows):
                key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[r])
            keys[:, b] = key & ~np.uint64(1) | np.uint64(b >= side)
    return keys


def _signature_batches(k: int, side: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in K.per_slice(batch.column(1), lower=True):
                g, bounds = shingle_sets(w, k)
                n = np.diff(bounds)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(g ^ np.uint64(s)))]) for s in (1, 2)]
                    s1, s2 = ((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums)
                hashes = min_hashes(g, bounds, max(2 * side * rows, SKETCH))
                keys = band_keys(hashes, side, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, 2 * side, dtype=np.int32)), pa.array(keys.ravel()))
                sketch = np.ascontiguousarray((hashes[:SKETCH] & 255).astype(np.uint8).T)
                starts = np.arange(0, sketch.size + 1, SKETCH, dtype=np.int32)
                sketches = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(starts), pa.py_buffer(sketch)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), lists, sketches], names=[f.name for f in SIGNATURES])

    return run


def _similar(shared, a, b, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def _sketches(column: pa.Array) -> np.ndarray:
    """(rows, SKETCH) bytes of a column of sketches."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)


def least_matches(percent: int) -> float:
    """Equal sketch bytes below which a pair cannot be a link, but for the stated probability."""
    p = percent / 100
    return SKETCH * p - SKETCH_DEVIATIONS * (SKETCH * p * (1 - p)) ** 0.5


def _alike_batches(percent: int):
    """Rows (u, v, sketch of u, of v) whose sketches do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array((_sketches(batch.column(2)) == _sketches(batch.column(3))).sum(1) >= least_matches(percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["u", "v"])

    return run


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) that sizes and sketches do not rule out."""
    of = lambda x: reps.select(F.col("doc").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    return both.select("u", "v", "su", "sv").mapInArrow(_alike_batches(percent), LINKS)


def _sets_of(column: pa.Array, k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, w in K.per_slice(column, lower=True):
        g, bounds = shingle_sets(w, k)
        out += [g[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return bool(_similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent))


def _verify_batches(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).to_numpy()
            _, first, at = np.unique(v, return_index=True, return_inverse=True)
            centres = _sets_of(batch.column(3).take(pa.array(first)), k)
            good = pa.array([_linked(own, centres[c], percent) for own, c in zip(_sets_of(batch.column(2), k), at.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, alike: bool = False) -> DataFrame:
    """Those of pairs (u, v) whose sets are similar enough. A text is only copied for pairs of like sizes and sketches;
    alike: that all of them are such is known already."""
    pairs = materialize(pairs if alike else _alike(pairs, reps, percent), "alike")
    left = pairs.join(texts.select(F.col("_key").alias("u"), F.col("_text").alias("_tu")), "u")
    right = left.join(texts.select(F.col("_key").alias("v"), F.col("_text").alias("_tv")), "v")
    return materialize(right.select("u", "v", "_tu", "_tv").mapInArrow(_verify_batches(k, percent), LINKS), "links")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, into: str) -> DataFrame:
    """rows with the component of a node (itself, if it has none)."""
    named = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(named, rows[node] == named["_n"], "left").withColumn(into, F.coalesce("_c", node)).drop("_n", "_c")


def _bands(column: pa.Array) -> np.ndarray:
    """(rows, 2, side) bands of A and of B."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().reshape(len(lists), 2, -1)


def _meet_here(bands: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows i and j of a table (a, b) are to be compared there: the first band of A that they share is a, and they
    share a band of B, of which the first is b (0: any)."""
    same = bands[i] == bands[j]
    first, some, rows = same.argmax(2), same.any(2).all(1), np.arange(len(i))
    return some & (bands[i, 0, first[:, 0]][rows] == a) & ((b == 0) | (bands[i, 1, first[:, 1]][rows] == b))


def _partners(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row outside the table's largest component: the rows of other components that size and sketch leave, and
    their matches. In a block of a table `side` tells rows that are looked for (1) from those that are searched (0)."""
    labels, n, top, a, b = (table.column(c).to_numpy() for c in ("label", "n_shingles", "top", "a", "b"))
    side = table.column("side").to_numpy()
    sketch, least, bands = _sketches(table.column("sketch")), least_matches(percent), _bands(table.column("bands"))
    members = np.flatnonzero(side != 1)
    members = members[np.argsort(n[members], kind="stable")]
    sizes, own, other = n[members], sketch[members], labels[members]
    for x in np.flatnonzero((side != 0) & (labels != top)).tolist():
        lo, hi = np.searchsorted(sizes, -(-percent * n[x] // 100), "left"), np.searchsorted(sizes, 100 * n[x] // percent, "right")
        matches = (own[lo:hi] == sketch[x]).sum(1)
        fine = (matches >= least) & (other[lo:hi] != labels[x])
        found, matches = members[lo:hi][fine], matches[fine]
        here = _meet_here(bands, np.full(len(found), x), found, a[x], b[x])
        yield x, found[here], matches[here]


def _of_tables(table: pa.Table) -> tuple[pa.Table, list[int]]:
    """Rows of several tables in order of their keys, and where each table begins and the last one ends."""
    table = table.take(pa.array(np.argsort(table.column("key").to_numpy(), kind="stable")))
    keys = table.column("key").to_numpy()
    return table, [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]


def _small_pairs(percent: int):
    """Pairs of rows of different components within small tables that size and sketch leave, many tables at once."""

    def run(tables: pa.Table) -> pa.Table:
        rows, bounds = _of_tables(tables)
        docs, labels, n, a, b = (rows.column(c).to_numpy() for c in ("doc", "label", "n_shingles", "a", "b"))
        sketch, bands, starts, sizes = _sketches(rows.column("sketch")), _bands(rows.column("bands")), np.array(bounds[:-1]), np.diff(bounds)
        found: list[np.ndarray] = []
        for size in np.unique(sizes).tolist():
            first, second = np.triu_indices(size, 1)
            begin = starts[sizes == size]
            step = max(1, PAIRS_AT_ONCE // max(1, len(first)))
            for k in range(0, len(begin), step):
                i, j = ((begin[k : k + step, None] + x).ravel() for x in (first, second))
                fine = (labels[i] != labels[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[fine], j[fine]
                alike = (sketch[i] == sketch[j]).sum(1) >= least_matches(percent)
                i, j = i[alike], j[alike]
                here = _meet_here(bands, i, j, a[i], b[i])
                found.append(np.sort(np.stack([docs[i[here]], docs[j[here]]]), 0))
        u, v = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _possible(percent: int):
    """Which rows of (blocks of) tables have a possible partner there."""

    def run(tables: pa.Table) -> pa.Table:
        rows, bounds = _of_tables(tables)
        some = np.zeros(len(rows), dtype=bool)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for x, found, _ in _partners(rows.slice(a, b - a), percent):
                if len(found):
                    some[a + x] = True
                    some[a + found] = True
        return rows.filter(pa.array(some)).select(["key", "doc"])

    return run


def _exact_block(k: int, percent: int):
    """Links between rows outside their table's largest component and rows of the table, one for each component."""

    def run(table: pa.Table) -> pa.Table:
        sets = _sets_of(pa.concat_arrays(table.column("_text").chunks), k)
        ids, labels = table.column("doc").to_numpy(), table.column("label").to_numpy()
        u, v = [], []
        for x, found, matches in _partners(table, percent):
            done: set[int] = set()
            for y in found[np.argsort(-matches, kind="stable")].tolist():  # the likeliest first
                if labels[y] not in done and _linked(sets[x], sets[y], percent):
                    done.add(labels[y])
                    u.append(int(ids[x]))
                    v.append(int(ids[y]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _blocks(tables: DataFrame, blocks: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of tables (key, doc, label) for each task (key, m, s): a table of one block is one task (side -1); of a larger
    one every block of rows (side 0) meets every block of the rows outside the largest component (side 1).
    blocks: (key, top, blocks)."""
    planned = tables.join(blocks, "key")
    zero = F.lit(0).cast("long")
    whole = planned.filter("blocks = 1").select(*columns, F.lit(-1).alias("side"), zero.alias("m"), zero.alias("s"))
    several = planned.filter("blocks > 1").withColumn("_own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    sides = F.when(F.col("label") == F.col("top"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    met = several.withColumn("side", F.explode(sides)).withColumn("_other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    m, s = (F.when(F.col("side") == k, F.col("_own")).otherwise(F.col("_other")) for k in (0, 1))
    return whole.unionByName(met.select(*columns, "side", m.alias("m"), s.alias("s")))


def _open_tables(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, a, b, doc, label, n) of the tensored tables with members of several components.

    A task forms the tables of one band of A itself, from the bands of B that its rows have (b is 0), as long as the rows
    that have the band fit in a block; bands of A with more rows are dealt by pairs of bands."""
    marked = _labelled(entries, labels, "doc", "label")
    several = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select(*keys, "n")
    marked = materialize(marked.join(several(marked, "band").select("band"), "band", "left_semi"), "open_entries")
    in_b = F.col("band").bitwiseAND(F.lit(1)) == 1
    of_b = marked.filter(in_b).select("doc", F.col("band").alias("b"))
    of_a = marked.filter(~in_b).select(F.col("band").alias("a"), "doc", "label").join(of_b.select("doc").distinct(), "doc", "left_semi")
    of_a = materialize(of_a.join(several(of_a, "a"), "a"), "bands_of_a")
    whole = of_a.filter(F.col("n") <= BLOCK_ROWS).select(F.col("a").alias("key"), "a", F.lit(0).cast("long").alias("b"), "doc", "label", "n")
    large = of_a.filter(F.col("n") > BLOCK_ROWS)
    if not large.head(1):
        return whole
    pairs = materialize(large.drop("n").join(of_b, "doc").select(F.xxhash64("a", "b").alias("key"), "a", "b", "doc", "label"), "pairs_of_bands")
    return whole.unionByName(materialize(pairs.join(several(pairs, "key"), "key").select(whole.columns), "tables"))


def _resolved(tables: DataFrame, facts: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components within tables (key, a, b, doc, label, n). Tables of less than a block go to tasks together."""
    rows = tables.count()
    group = F.pmod(F.xxhash64("key"), F.lit(1 + rows // TABLE_ROWS_PER_TASK))
    small = tables.filter(F.col("n") <= SMALL_TABLE).join(facts, "doc").withColumn("g", group)
    pairs = small.groupBy("g").applyInArrow(_small_pairs(percent), LINKS)
    links = _verified(pairs, facts, texts, k, percent, alike=True)
    large = tables.filter(F.col("n") > SMALL_TABLE)
    if not large.head(1):
        return links
    columns = ["key", "a", "b", "doc", "label"]
    sizes = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    top = materialize(sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("_t"), F.sum("c").alias("n")).select("key", F.col("_t.label").alias("top"), "n"), "largest")
    plan = top.select("key", "top", (1 + F.floor(F.col("n") / (BLOCK_ROWS + 1))).alias("blocks"))
    tasks = _blocks(large.select(*columns), plan, [*columns, "top", "blocks"]).join(facts, "doc")
    tasks = tasks.withColumn("g", F.when(F.col("blocks") > 1, F.col("key")).otherwise(group)).withColumn("whole", F.col("blocks") == 1)
    possible = tasks.groupBy("whole", "g", "m", "s").applyInArrow(_possible(percent), "key long, doc long").distinct()
    possible = materialize(possible.join(large.select(*columns), ["key", "doc"]).join(facts, "doc"), "possible")
    sums = possible.groupBy("key").agg((1 + F.floor(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count(F.lit(1)) / (BLOCK_TEXTS + 1)))).alias("blocks"))
    plan = materialize(sums.join(top.select("key", "top"), "key"), "plan")
    tasks = _blocks(possible, plan, [*columns, "top", "n_shingles", "sketch", "bands"]).join(texts.select(F.col("_key").alias("doc"), "_text"), "doc")
    return links.unionByName(materialize(tasks.groupBy("key", "m", "s").applyInArrow(_exact_block(k, percent), LINKS), "resolved"))


def _near(docs: DataFrame, k: int, percent: int, side: int, rows: int) -> DataFrame:
    """(doc, n_shingles, component) of documents (_key, _text) with keys of their own; a component is its smallest key."""
    signed = materialize(docs.select("_key", "_text").mapInArrow(_signature_batches(k, side, rows), SIGNATURES), "signatures")

    # Classes of equal sets; the bands of one member stand for all.
    filled = signed.filter("n_shingles > 0")
    classes = materialize(filled.groupBy("s1", "s2", "n_shingles").agg(F.min("doc").alias("rep")), "classes")
    reps = filled.join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi").select("doc", "n_shingles", "bands", "sketch")
    reps = materialize(reps, "representatives")

    # Bands that several classes have, with the least of these as centre; members that have such bands on both sides.
    entries = reps.select(F.explode("bands").alias("band"), "doc")
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("centre")).filter("n > 1").select("band", "centre")
    entries = materialize(entries.join(materialize(shared, "shared_bands"), "band"), "entries")
    in_b = F.col("band").bitwiseAND(F.lit(1))
    sides = (F.min(in_b).alias("_lo"), F.max(in_b).alias("_hi"))
    involved = materialize(entries.groupBy("doc").agg(*sides).filter("_lo < _hi").select("doc"), "involved")
    facts = materialize(reps.join(involved, "doc", "left_semi").select("doc", "n_shingles", "sketch", "bands"), "facts")
    texts = materialize(docs.join(involved, docs["_key"] == involved["doc"], "left_semi").select("_key", "_text"), "texts")

    # Stars: a centre that agrees on both sides, one for each document; then those of other components.
    stars = entries.filter("doc <> centre").groupBy("doc", "centre").agg(*sides).filter("_lo < _hi")
    stars = materialize(stars.select("doc", "centre"), "stars")
    first = stars.groupBy("doc").agg(F.min("centre").alias("v")).select(F.col("doc").alias("u"), "v")
    links = _verified(first, facts, texts, k, percent)
    labels = components(links)
    others = _labelled(_labelled(stars, labels, "doc", "_cu"), labels, "centre", "_cv").filter("_cu <> _cv").select(F.col("doc").alias("u"), F.col("centre").alias("v"))
    tested = first.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    others = others.join(tested, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")), "left_anti")
    links = links.unionByName(_verified(others, facts, texts, k, percent))
    labels = components(links)

    links = links.unionByName(_resolved(_open_tables(entries.select("band", "doc"), labels), facts, texts, k, percent))
    labels = components(links)

    # Back to all documents: class -> representative -> component.
    found = _labelled(classes, labels, "rep", "component").select("s1", "s2", "n_shingles", "component")
    empty = signed.filter("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("component"))
    members = filled.join(found, ["s1", "s2", "n_shingles"]).select("doc", "n_shingles", "component")
    return members.unionByName(empty)


def _documents(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str, DataFrame]:
    """df, its key column, and (_key, _id, _text)."""
    prepare(df.sparkSession)
    rows, key = keyed(df, id_col)
    return rows, key, rows.select(F.col(key).cast("long").alias("_key"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))


def _members(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, n_shingles, component, _id, _least): where keys are not ids, each row with the least id of its component and
    the row that stands for it."""
    own = materialize(found.join(docs.select(F.col("_key").alias("doc"), "_id"), "doc"), "members")
    best = own.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "doc")).alias("_least"))
    return own.join(best, "component")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", side: int = SIDE, rows: int = ROWS_PER_BAND) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    _, key, docs = _documents(df.select(id_col, text), id_col, text)
    found = settle(df.sparkSession, "near", lambda: _near(docs, k, percent, side, rows))
    if key == id_col:
        return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
    least = F.col("_least.id")
    return _members(docs, found).select(F.col("_id").alias("doc_id"), "n_shingles", least.alias("component_id"), F.col("_id").eqNullSafe(least).alias("kept"))


def drop_near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", side: int = SIDE, rows: int = ROWS_PER_BAND) -> DataFrame:
    """One row of each component, that of the smallest id, with df's columns."""
    whole, key, docs = _documents(df, id_col, text)
    found = settle(df.sparkSession, "near", lambda: _near(docs, k, percent, side, rows))
    stays = F.col("doc") == F.col("component") if key == id_col else F.col("doc") == F.col("_least.doc")
    gone = (found if key == id_col else _members(docs, found)).filter(~stays).select(F.col("doc").alias("_gone"))
    gone = materialize(gone, "gone")
    out = whole.join(gone, whole[key] == gone["_gone"], "left_anti")
    return out if key == id_col else out.drop(key)
