"""Tables and forms: cell texts, grids, key-value pairs, framed table text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.sources.shared import ship

CELL_END = "`"
NO_TABLE = "<b> NO Table FOUND </b>"


def cell_texts(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, ord, text, selected) -> text of a cell: each word, or an X for a ticked box, with a blank after it."""
    word = F.when(F.col("selected"), F.lit("X")).otherwise(F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", word.alias("t")))), lambda x: F.concat(x["t"], F.lit(" ")))
    return words.groupBy(*keys).agg(F.array_join(ordered, "").alias("cell"))


def row_texts(cells: DataFrame) -> DataFrame:
    """(table_id, row, line): a row's cells, each with the end mark."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: F.concat(F.coalesce(x["value"], F.lit("")), F.lit(CELL_END)))
    return cells.groupBy("table_id", "row").agg(F.array_join(ordered, "").alias("line"))


def table_texts(cells: DataFrame) -> DataFrame:
    """(table_id, content): the rows of each table under a banner."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")
    return row_texts(cells).groupBy("table_id").agg(F.concat(F.lit("Table: "), F.first("table_id"), F.lit("\n\n"), lines, F.lit("\n\n\n")).alias("content"))


def parse_table_text(files: DataFrame) -> DataFrame:
    """files (file_id, content) -> cells (file_id, table_num, row, col, header, value).

    A table ends at a blank line after a blank line; banners do not count; an unterminated table, an empty one and one
    with a row longer than its header are left out before numbering; columns and rows without any value go."""
    lines = files.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    order = W.partitionBy("file_id").orderBy("n")
    blank, banner = F.trim("line").isin("", '""'), F.col("line").contains("Table: Table")
    content = ~blank & ~banner
    ended = blank & F.coalesce(F.lag(blank).over(order), F.lit(False))
    marked = lines.withColumn("_c", content).withColumn("_e", ended.cast("int"))
    block = F.coalesce(F.sum("_e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    closed = F.max("_e").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)) == 1
    rows = marked.withColumn("_t", block).withColumn("_closed", closed).filter("_c and _closed")
    in_table = W.partitionBy("file_id", "_t")
    rows = rows.withColumn("row", F.row_number().over(in_table.orderBy("n")) - 1).withColumn("_v", F.split(F.regexp_replace("line", f"{CELL_END}$", ""), CELL_END))
    head = F.max(F.when(F.col("row") == 0, F.col("_v"))).over(in_table)
    rows = rows.withColumn("_h", head).withColumn("_bad", F.max((F.size("_v") > F.size("_h")).cast("int")).over(in_table)).withColumn("_n", F.count(F.lit(1)).over(in_table)).filter("_bad = 0 and _n > 1")
    rows = rows.withColumn("table_num", F.dense_rank().over(W.partitionBy("file_id").orderBy("_t")))
    cell = rows.select("file_id", "table_num", "row", "_h", F.posexplode("_v").alias("_i", "value")).withColumn("header", F.trim(F.get("_h", F.col("_i")))).withColumn("value", F.nullif(F.trim("value"), F.lit("")))
    body = cell.filter("row > 0")
    by_col, by_row = W.partitionBy("file_id", "table_num", "_i"), W.partitionBy("file_id", "table_num", "row")
    full = body.withColumn("_nc", F.count("value").over(by_col)).withColumn("_nr", F.count("value").over(by_row)).filter("_nc > 0 and _nr > 0")
    return full.select("file_id", "table_num", F.col("row").cast("long").alias("row"), (F.col("_i") + 1).cast("long").alias("col"), "header", "value")


class Cells:
    """A table function over the lines of one file in order: the cells of each table once it has ended. Its state is one
    table's lines; a table without an end is left out."""

    def __init__(self) -> None:
        self.rows: list[str] = []
        self.tables, self.blank = 0, False

    def eval(self, row) -> Iterator[tuple]:
        line = row["line"]
        if line.strip(" ") in ("", '""'):
            if self.blank:
                yield from self._table(row["file_id"])
            self.blank = True
            return
        self.blank = False
        if "Table: Table" not in line:
            self.rows.append(line)

    def _table(self, file_id) -> Iterator[tuple]:
        grid, self.rows = [line.removesuffix("`").split("`") for line in self.rows], []
        if len(grid) < 2 or any(len(r) > len(grid[0]) for r in grid):
            return
        self.tables += 1
        head, body = [h.strip(" ") for h in grid[0]], [[v.strip(" ") or None for v in r] for r in grid[1:]]
        filled = {k for r in body for k, v in enumerate(r) if v is not None}
        for n, r in enumerate(body, 1):
            if any(v is not None for v in r):
                for k, v in enumerate(r):
                    if k in filled:
                        yield file_id, self.tables, n, k + 1, head[k], v


def cells_of_lines(lines: DataFrame) -> DataFrame:
    """The cells of `parse_table_text` from lines (file_id, n, line), by the table function: a file's lines pass it in
    order, so no window over a file and no file is held."""
    ship(lines.sparkSession)
    found = F.udtf(Cells, returnType="file_id string, table_num bigint, row bigint, col bigint, header string, value string")
    return found(lines.select("file_id", "n", "line").asTable().partitionBy("file_id").orderBy("n"))


#: What a file without tables holds.
NO_TABLES = "[NO TABLES]"


def selected_tables(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cells of the tables that a prediction chose. chosen (file_id, table_num)."""
    return cells.join(chosen.select("file_id", "table_num").distinct(), ["file_id", "table_num"], "left_semi")


def table_files(cells: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file_id, content): a file's tables as comma-separated text, each under a banner and with a blank line after it,
    numbered anew from 1. files (file_id): those without a table hold a mark that says so."""
    quoted = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    keys = ["file_id", "table_num"]
    heads = cells.select(*keys, F.lit(0).cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("header").alias("value")).distinct()
    every = heads.unionByName(cells.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"))
    cell = F.struct("col", quoted(F.col("value")).alias("v"))
    rows = every.groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["v"]), ",").alias("line"))
    tables = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    ordered = F.array_sort(F.collect_list(F.struct("table_num", "body")))
    text = F.transform(ordered, lambda x, i: F.concat(F.lit("Table: Table "), (i + 1).cast("string"), F.lit("\n"), x["body"], F.lit('\n""\n')))
    whole = tables.groupBy("file_id").agg(F.array_join(text, "").alias("content"))
    if files is None:
        return whole
    return files.select("file_id").distinct().join(whole, "file_id", "left").withColumn("content", F.coalesce("content", F.lit(NO_TABLES + "\n")))


def table_similarity(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, other_row, other_col, similarity) of all pairs of cells of a table, header row included: cosine
    of character counts."""

    def pairs(met: _Met) -> Iterator[pa.RecordBatch]:
        yield met.batch(met.similarity(), met.in_order())

    return _meet(cells, pairs, f"{_PLACES}, similarity double")


def table_similarity_summary(cells: DataFrame) -> DataFrame:
    """(table_id, n_pairs, closest, average) of the pairs of `table_similarity`, which are summed up where they are found."""

    def sums(met: _Met) -> Iterator[pa.RecordBatch]:
        found = met.similarity()[met.in_order()]
        if len(found):
            yield pa.RecordBatch.from_arrays([met.table(1), pa.array([len(found)]), pa.array([found.max()]), pa.array([found.sum()])], names=["table_id", "n", "closest", "total"])

    parts = _meet(cells, sums, "n bigint, closest double, total double").groupBy("table_id")
    return parts.agg(F.sum("n").alias("n_pairs"), F.max("closest").alias("closest"), (F.sum("total") / F.sum("n")).alias("average"))


def key_values(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (keys, key, ord, value): the last value of each key."""
    return pairs.groupBy(*keys, "key").agg(F.max_by("value", "ord").alias("value"))


def search_key(pairs: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Value of the first key that matches, ignoring case."""
    return pairs.filter(F.col("key").rlike(f"(?i){pattern}")).groupBy(*keys).agg(F.min_by("value", "ord").alias("value"))


def content_tokens(cells: DataFrame) -> DataFrame:
    """(table_id, content): headers and cells that begin with a letter, except unnamed and empty ones."""
    heads = cells.select("table_id", F.lit(0).cast("long").alias("row"), "col", F.col("header").alias("value")).distinct()
    every = heads.unionByName(cells.select("table_id", "row", "col", "value"))
    fine = every.filter(F.col("value").rlike(r"^[A-z]+") & ~F.col("value").contains("Unnamed:") & (F.col("value") != "nan"))
    return fine.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda x: x["value"]), " ").alias("content"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def neighbours(cells: DataFrame, klass: Column, key: Column) -> DataFrame:
    """For key cells, the first cell to the right and the first below whose class is not empty-like.

    (table_id, row, col, value, right_value, right_class, right_next, down_value, down_class, down_next); next is the
    cell right of the found one."""
    in_row = W.partitionBy("table_id", "row").orderBy("col")
    marked = cells.withColumn("_k", klass).withColumn("_x", F.when(F.lead("col").over(in_row) == F.col("col") + 1, F.lead("value").over(in_row)))
    good = F.when(~F.col("_k").endswith("nan"), F.struct(F.col("value").alias("v"), F.col("_k").alias("k"), F.col("_x").alias("x")))
    right = F.first(good, True).over(in_row.rowsBetween(1, W.unboundedFollowing))
    down = F.first(good, True).over(W.partitionBy("table_id", "col").orderBy("row").rowsBetween(1, W.unboundedFollowing))
    found = marked.withColumn("_r", right).withColumn("_d", down).filter(key)
    both = [F.col(f"_{d[0]}.{f}").alias(f"{d}_{name}") for d in ("right", "down") for f, name in (("v", "value"), ("k", "class"), ("x", "next"))]
    return found.select("table_id", "row", "col", "value", *both)


def char_counts(text: Column) -> Column:
    """How often each character occurs, as a map."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.map_from_arrays(F.array_distinct(chars), F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double")))


def vector_length(n: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(n), F.lit(0.0), lambda a, x: a + x * x))


def count_cosine() -> Column:
    """Of the counts n and m of lengths s and t."""
    dot = F.aggregate(F.map_entries("n"), F.lit(0.0), lambda a, x: a + x["value"] * F.coalesce(F.try_element_at("m", x["key"]), F.lit(0.0)))
    return F.when((F.col("s") > 0) & (F.col("t") > 0), dot / (F.col("s") * F.col("t"))).otherwise(F.lit(0.0))


def line_similarity(cells: DataFrame) -> DataFrame:
    """(table_id, line, row, col, other_row, other_col, similarity): cosine of character counts of all pairs of cells in
    a row or in a column (`line`), each pair once; the header is row 0. Letter case and the length of white space do not
    count; pairs without a common character, empty cells among them, have 0."""

    def pairs(met: _Met) -> Iterator[pa.RecordBatch]:
        similarity, order = met.similarity(), met.in_order()
        same_col = (met.cols[:, None] == met.cols) & np.logical_and.outer(met.known, met.known)
        for line, which in (("row", met.rows[:, None] == met.rows), ("column", same_col)):
            yield met.batch(similarity, which & order, line)

    return _meet(cells, pairs, f"line string, {_PLACES}, similarity double").select("table_id", "line", "row", "col", "other_row", "other_col", "similarity")


#: Cells of a block. Tables of more cells have several; each two blocks of a table meet, in any task.
BLOCK = 512
_PLACES = "row bigint, col bigint, other_row bigint, other_col bigint"


@dataclass(frozen=True)
class _Met:
    """The cells of one block of a table or of two, whose own pairs are found elsewhere; known: which have a column."""

    tables: pa.Array
    two: bool
    blocks: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    known: np.ndarray
    texts: list[bytes]

    def similarity(self) -> np.ndarray:
        """Cosine of the character counts of each two cells; 0 for empty ones."""
        texts = [t.decode("utf-8", "replace") for t in self.texts]
        letters, at = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        n = np.bincount(owner * len(letters) + at, minlength=len(texts) * len(letters)).reshape(len(texts), len(letters)).astype(float)
        size = np.sqrt((n * n).sum(1))
        both = np.outer(size, size)
        return np.divide(n @ n.T, both, out=np.zeros_like(both), where=both > 0)

    def in_order(self) -> np.ndarray:
        """Which pairs meet here: the first cell is above the second, or left of it in its row."""
        above, level = self.rows[:, None] < self.rows, (self.rows[:, None] == self.rows) & np.logical_and.outer(self.known, self.known)
        order = above | level & (self.cols[:, None] < self.cols)
        return order & (self.blocks[:, None] != self.blocks) if self.two else order

    def table(self, n: int) -> pa.Array:
        return self.tables.take(pa.array(np.zeros(n, np.int32)))

    def batch(self, similarity: np.ndarray, which: np.ndarray, *line: str) -> pa.RecordBatch:
        a, b = np.nonzero(which)
        col = lambda k: pa.array(self.cols[k], mask=~self.known[k])
        given = [pa.array([x]).take(pa.array(np.zeros(len(a), np.int32))) for x in line]
        names = ["table_id", *["line" for _ in line], "row", "col", "other_row", "other_col", "similarity"]
        return pa.RecordBatch.from_arrays([self.table(len(a)), *given, pa.array(self.rows[a]), col(a), pa.array(self.rows[b]), col(b), pa.array(similarity[a, b])], names=names)


def _meet(cells: DataFrame, found: Callable[[_Met], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `found` gives for all blocks of cells of a table, headers as row 0. A block has BLOCK cells or so, and a task
    holds two of them at a time: counts are arrays there, and no pair of cells is a row before it is compared."""
    spark = cells.sparkSession
    ship(spark)
    body = cells.select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")
    header = cells.select("table_id", F.lit(0).cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("header").alias("value")).distinct()
    text = F.regexp_replace(F.lower(F.coalesce("value", F.lit(""))), r"\s\s+", " ").cast("binary")
    every = body.unionByName(header).filter("table_id is not null and row is not null").select("table_id", "row", "col", text.alias("text"))
    blocks = F.ceil(F.count(F.lit(1)).over(W.partitionBy("table_id")) / BLOCK).cast("int")
    dealt = every.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64("row", "col"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    key = ("table_id", "_i", "_j")
    dealt = dealt.select("table_id", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "row", "col", "text")
    # pairs take time, not bytes: partitions are not put together for their few bytes
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "row", "col")

    def met(rows: pa.Table) -> _Met:
        number = lambda c: rows.column(c).to_numpy()
        col = rows.column("col")
        return _Met(rows.column("table_id").slice(0, 1).combine_chunks(), rows.column("_i")[0] != rows.column("_j")[0], number("_b"), number("row"), col.fill_null(0).to_numpy(), col.is_valid().to_numpy(), rows.column("text").to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, at = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            start = 0
            for k in range(len(keys)):
                if keys[k] != at:
                    if k > start:
                        open_.append(batch.slice(start, k - start))
                    if open_:
                        yield from found(met(pa.Table.from_batches(open_)))
                    open_, at, start = [], keys[k], k
            if len(keys) > start:
                open_.append(batch.slice(start))
        if open_:
            yield from found(met(pa.Table.from_batches(open_)))

    return dealt.mapInArrow(run, T.StructType([cells.schema["table_id"], *T._parse_datatype_string(schema).fields]))


def row_similarity(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, other_col, similarity): cosine of character counts of the cells of each row that share a
    character, each pair once. A row's cells meet in one array, so nothing is joined: characters are not shuffled, and no
    table is taken for small by the size of its file and broadcast."""
    known = cells.filter("table_id is not null and row is not null and col is not null")
    whole = known.groupBy("table_id", "row", "col").agg(F.array_join(F.collect_list(F.coalesce("value", F.lit(""))), "").alias("t"))
    rows = whole.groupBy("table_id", "row").agg(F.collect_list(F.struct("col", "t")).alias("_c"))

    def sized(c: Column) -> Column:
        n = char_counts(c["t"])
        return F.struct(c["col"].alias("col"), n.alias("n"), vector_length(n).alias("s"))

    rows = rows.select("table_id", "row", F.transform("_c", sized).alias("_c"))
    each = rows.select("table_id", "row", "_c", F.explode("_c").alias("a")).select("table_id", "row", F.col("a.col").alias("col"), "a.n", "a.s", F.filter("_c", lambda b: b["col"] > F.col("a.col")).alias("_c"))
    pairs = each.select("table_id", "row", "col", "n", "s", F.explode("_c").alias("b")).select("table_id", "row", "col", F.col("b.col").alias("other_col"), "n", "s", F.col("b.n").alias("m"), F.col("b.s").alias("t"))
    return pairs.select("table_id", "row", "col", "other_col", count_cosine().alias("similarity")).filter("similarity > 0")
