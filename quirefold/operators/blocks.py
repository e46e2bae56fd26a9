"""The block graph of OCR responses: pages to lines, tables to cells to words, form keys to values.

Blocks are rows (keys, ord, id, block_type, text, row_index, col_index, selection_status, entity_types, relationships);
`keys` tell documents apart (the report and its file, where there is a file number), `ord` is a block's place among all
result pages of the response. A walk joins blocks by document and id, so it
shuffles by a key that is nearly unique; only references of the kinds of blocks that it needs are sent. Missing blocks are ignored, as are references to blocks of another kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.operators.keys import document_keys
from quirefold.operators.tables import CELL_END, NO_TABLE

#: Places of a result page: a response's pages follow each other by this step.
PAGE_STEP = 1 << 32


def in_file(blocks: DataFrame, page: str = "response", place: str = "place") -> DataFrame:
    """blocks with `ord`, their place in the whole file, out of the result page and the place within it."""
    return blocks.withColumn("ord", F.col(page).cast("long") * PAGE_STEP + F.col(place)).drop(page, place)


def from_response(blocks: DataFrame) -> DataFrame:
    """Blocks of `readers.ocr_blocks` under the names used here."""
    names = {"Id": "id", "BlockType": "block_type", "Text": "text", "RowIndex": "row_index", "ColumnIndex": "col_index", "SelectionStatus": "selection_status", "EntityTypes": "entity_types", "Relationships": "relationships", "Page": "page_num", "Confidence": "confidence"}
    box = [F.col(f"Geometry.BoundingBox.{n}").alias(n.lower()) for n in ("Left", "Top", "Width", "Height")]
    kinds = F.transform("Relationships", lambda r: F.struct(r["Type"].alias("type"), r["Ids"].alias("ids")))
    return blocks.select("doc_id", "file_num", "ord", *[(kinds if k == "Relationships" else F.col(k)).alias(n) for k, n in names.items()], *box)


def edges(blocks: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, src, type, place, dst): the references in their order."""
    keys = keys or document_keys(blocks)
    rel = blocks.select(*keys, F.col("id").alias("src"), F.posexplode("relationships").alias("_r", "_e"))
    return rel.select(*keys, "src", F.col("_e.type").alias("type"), "_r", F.posexplode("_e.ids").alias("_i", "dst")).select(*keys, "src", "type", F.struct("_r", "_i").alias("place"), "dst")


def of_kind(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.filter(F.col("block_type") == kind)


def page_blocks(blocks: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """The PAGE block of each page, the last one where several claim it."""
    keys = keys or document_keys(blocks)
    rest = [c for c in blocks.columns if c not in (*keys, "page_num")]
    return of_kind(blocks, "PAGE").groupBy(*keys, "page_num").agg(F.max_by(F.struct(*rest), "ord").alias("_b")).select(*keys, "page_num", "_b.*")


def page_lines(blocks: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """LINE blocks that are among the first children of their page's block, with line_num from 1."""
    keys = keys or document_keys(blocks)
    pages = page_blocks(blocks, keys).select(*keys, "page_num", F.explode(F.when(F.get("relationships", F.lit(0))["type"].contains("CHILD"), F.get("relationships", F.lit(0))["ids"])).alias("id")).distinct()
    lines = of_kind(blocks, "LINE").join(pages, [*keys, "page_num", "id"], "left_semi")
    return lines.withColumn("line_num", F.row_number().over(W.partitionBy(*keys, "page_num").orderBy("ord")).cast("long"))


def _texts(blocks: DataFrame, links: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, src, text): each child word with a blank after it, an X for a ticked box."""
    piece = F.when(F.col("block_type") == "WORD", F.concat(F.coalesce("text", F.lit("")), F.lit(" "))).when((F.col("block_type") == "SELECTION_ELEMENT") & (F.col("selection_status") == "SELECTED"), F.lit("X "))
    words = blocks.select(*keys, F.col("id").alias("dst"), piece.alias("_t")).filter("_t is not null")
    met = links.filter(F.col("type") == "CHILD").join(words, [*keys, "dst"])
    return met.groupBy(*keys, "src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_t"))), lambda x: x["_t"]), "").alias("text"))


def table_cells(blocks: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, table_num, row, col, place, text) of all tables; table_num counts a document's tables from 1.

    Of cells that claim one row and column the last counts, at the place of the first."""
    keys = keys or document_keys(blocks)
    # a table's number goes with its own references, and only cells' references go to words
    tables = of_kind(blocks, "TABLE").select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy("ord")).cast("long").alias("table_num"), F.col("id"), "relationships")
    named = edges(tables, (*keys, "table_num")).filter(F.col("type") == "CHILD").select(*keys, "table_num", "place", "dst")
    cells = of_kind(blocks, "CELL").select(*keys, F.col("id").alias("dst"), F.col("row_index").cast("long").alias("row"), F.col("col_index").cast("long").alias("col"))
    found = named.join(cells, [*keys, "dst"])
    texts = _texts(blocks, edges(of_kind(blocks, "CELL"), keys), keys).select(*keys, F.col("src").alias("dst"), "text")
    full = found.join(texts, [*keys, "dst"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return full.groupBy(*keys, "table_num", "row", "col").agg(F.min("place").alias("place"), F.max_by("text", "place").alias("text"))


def key_values(blocks: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, key, value) of forms: a key's text and that of its last VALUE block; of equal keys the last counts.

    A key without a value block has an empty value."""
    keys = keys or document_keys(blocks)
    sets = of_kind(blocks, "KEY_VALUE_SET")
    links = edges(sets, keys)
    texts = _texts(blocks, links, keys)
    is_key = F.array_contains("entity_types", "KEY")
    values = sets.filter(~F.coalesce(is_key, F.lit(False))).select(*keys, F.col("id").alias("dst"))
    chosen = links.filter(F.col("type") == "VALUE").join(values, [*keys, "dst"], "left_semi").groupBy(*keys, "src").agg(F.max_by("dst", "place").alias("dst"))
    of = lambda node, name: texts.select(*keys, F.col("src").alias(node), F.col("text").alias(name))
    named = sets.filter(is_key).select(*keys, "ord", F.col("id").alias("src")).join(chosen, [*keys, "src"], "left").join(of("src", "key"), [*keys, "src"], "left").join(of("dst", "value"), [*keys, "dst"], "left")
    full = named.fillna("", ["key", "value"])
    return full.groupBy(*keys, "key").agg(F.max_by("value", "ord").alias("value"))


def table_files(blocks: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, content): the framed text of a document's tables, or the mark that it has none. Rows and cells stand in the
    order in which the response names them."""
    keys = keys or document_keys(blocks)
    cells = table_cells(blocks, keys)
    lines = cells.groupBy(*keys, "table_num", "row").agg(F.min("place").alias("place"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: F.concat(x["text"], F.lit(CELL_END))), "").alias("line"))
    one = lines.groupBy(*keys, "table_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("rows"))
    framed = F.concat(F.lit("Table: Table_"), F.col("table_num").cast("string"), F.lit("\n\n"), F.col("rows"), F.lit("\n\n\n\n\n"))
    whole = one.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_num", framed.alias("t")))), lambda x: x["t"]), "").alias("content"))
    return blocks.select(*keys).distinct().join(whole, list(keys), "left").withColumn("content", F.coalesce("content", F.lit(NO_TABLE)))
