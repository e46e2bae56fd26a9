"""Text lines: filters, reconstruction from boxes, line features."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions import text as X
from quirefold.operators.keys import document_keys, page_keys
from quirefold.sources.shared import parts_of

# Margins of scanning noise, and tolerances of line reconstruction, in page units.
NOISE_LEFT, NOISE_WIDTH = 0.04, 0.02
SAME_LINE, SLOPE = 0.0075, 0.014
SEPARATOR = " \t"


def drop_margin_noise(boxes: DataFrame) -> DataFrame:
    """Without narrow boxes at the very left."""
    return boxes.filter(~((F.col("left") < NOISE_LEFT) & (F.col("width") < NOISE_WIDTH)))


def child_lines(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """LINE blocks that are children of a PAGE, numbered within their page. edges: (src, type, ord, dst), and the keys of
    the document where ids are not unique among documents."""
    own = [k for k in document_keys(blocks) if k in edges.columns]
    pages = blocks.filter(F.col("block_type") == "PAGE").select(*own, F.col("id").alias("src"))
    kids = edges.filter(F.col("type") == "CHILD").join(pages, [*own, "src"], "left_semi").select(*own, F.col("dst").alias("id")).distinct()
    found = blocks.filter(F.col("block_type") == "LINE").join(kids, [*own, "id"], "left_semi")
    return found.withColumn("line_num", F.row_number().over(W.partitionBy(*page_keys(blocks)).orderBy("ord")))


def assign_lines(boxes: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """boxes (keys of a page, ord, left, top, width, ...) with the line (line_num) and place (pos) that reconstruction gives.

    Boxes of a page are taken in order. A box joins the line if it is at the height of the line's first box (before it,
    if it starts left of the last one) or on a slight slope to its right; else it begins a new line. Each box needs the
    one before, so pages are sorted and read once, with a state of a few numbers: a page's boxes are never held together."""
    keys = keys or page_keys(boxes)
    same, slight = SAME_LINE, SLOPE
    schema = T.StructType([*boxes.schema.fields, T.StructField("line_num", T.LongType()), T.StructField("pos", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, n, first, left_of, width_of, lo, hi = None, 0, None, None, None, 0, 0
        for batch in batches:
            numbers, places = [], []
            for *own, left, top, width in zip(*(batch.column(c).to_pylist() for c in (*keys, "left", "top", "width")), strict=True):
                if own != page:
                    page, n = own, 0
                level = sloping = False
                if n and first is not None and top is not None:
                    level = first - same <= top <= first + same
                    end = None if left_of is None or width_of is None else left_of + width_of
                    sloping = not level and left is not None and end is not None and left > end and abs(first - top) / (left - end) < slight
                if level and left is not None and left_of is not None and left < left_of:
                    lo -= 1
                    place = lo
                elif level or sloping:
                    hi += 1
                    place, left_of, width_of = hi, left, width
                else:
                    n, first, left_of, width_of, lo, hi, place = n + 1, top, left, width, 0, 0, 0
                numbers.append(n)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "line_num", "pos"])

    in_order = boxes.repartition(*keys).sortWithinPartitions(*keys, "ord", "left", "top", "width")
    return in_order.mapInArrow(fold, schema)


def merge_lines(placed: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """One row per reconstructed line, from `assign_lines`."""
    keys = keys or page_keys(placed)
    last = F.max_by(F.struct("left", "width"), F.when(F.col("pos") >= 0, F.col("pos")))
    merged = placed.groupBy(*keys, "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), SEPARATOR).alias("text"),
        F.avg("confidence").alias("confidence"),
        F.sum("width").alias("words_width"),
        F.max("height").alias("height"),
        F.min("left").alias("left"),
        F.avg("top").alias("top"),
        F.count(F.lit(1)).alias("n_boxes"),
        last.alias("_last"),
    )
    return merged.withColumn("width", F.col("_last.left") + F.col("_last.width") - F.col("left")).drop("_last")


def min_max(value: Column, *keys: str) -> Column:
    """A value's place between the least and the greatest of its group; 0 where these are equal."""
    w = W.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low))


def line_features(lines: DataFrame) -> DataFrame:
    """The line dataset: widths, centrality within the document, place within the page, text flags."""
    centre = F.lit(0.5) - F.abs(F.col("left") + F.col("width") / 2 - 0.5)
    return lines.select(
        "*",
        F.try_divide("words_width", "width").alias("words2width"),
        min_max(centre, *document_keys(lines)).alias("centrality"),
        min_max(F.col("line_num"), *page_keys(lines)).alias("normed_line_num"),
        *text_flags(F.col("text")),
    )


def text_flags(text: Column) -> list[Column]:
    return [
        X.word_count(text).cast("long").alias("word_count"),
        X.contains_number_token(text).alias("contains_num"),
        X.starts_numbered(text).alias("starts_num"),
        X.contains_tab(text).alias("contains_tab"),
        X.contains_word(text, "page").alias("contains_page"),
    ]


#: Rows of a task where only ids meet.
IDS_PER_TASK = 500_000


def with_ids(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose id is listed, by tasks of a number of rows that does not grow with the tables. The join is not a semi-join,
    which would be put before the exchange."""
    n = max(parts_of(rows, IDS_PER_TASK), parts_of(listed, IDS_PER_TASK))
    return rows.repartition(n, key).join(listed.select(key).repartition(n, key).distinct().hint("merge"), key)


def without(lines: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Lines whose keys are not among other's (marginal lines, contents pages, excluded documents)."""
    return lines.join(other.select(*keys).distinct(), keys, "left_anti")
