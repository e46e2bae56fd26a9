"""Page features, contents pages, and the spine of all pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import text as X

# Words by which contents pages are known.
CONTENTS_WORDS, CONTENTS_PHRASES, LIST_PHRASES = ("contents",), ("table of contents",), ("list of",)


def contents_features(lines: DataFrame, words=CONTENTS_WORDS, phrases=CONTENTS_PHRASES, lists=LIST_PHRASES) -> DataFrame:
    has = lambda of: F.max(X.contains_word(F.col("text"), *of))
    return lines.groupBy("doc_id", "page_num").agg(
        F.count(F.lit(1)).alias("num_children"), has(words).alias("contains_contents_word"), has(phrases).alias("contains_toc_phrase"), has(lists).alias("contains_list_of")
    )


def figure_features(boxes: DataFrame, word: str = "figure") -> DataFrame:
    """Spread of confidence, text length, figure words and the place of the figure line, per page."""
    loose, strict = F.lower("text").contains(word), X.figure_line(F.col("text")) == 1
    c = F.col("confidence")
    quart = lambda q: F.percentile(c, F.lit(q))
    place = F.coalesce(F.max(F.when(strict, F.col("ord"))), F.min(F.when(loose, F.col("ord"))), F.lit(-1).cast("long"))
    return boxes.groupBy("doc_id", "page_num").agg(
        F.median(c).alias("med_confidence"), F.avg(c).alias("avg_confidence"), (F.max(c) - F.min(c)).alias("range_confidence"), (quart(0.75) - quart(0.25)).alias("iqr_confidence"),
        F.median(F.length("text")).alias("med_line_len"), F.max(X.flag(loose)).alias("contains_fig_word"), F.max(X.flag(strict)).alias("contains_fig_ln"), place.alias("fig_pos"),
    )


def page_spine(lines: DataFrame) -> DataFrame:
    """Every page of a document up to its last, with the number of its lines (0 where it has none)."""
    counts = lines.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("n_lines"))
    spine = counts.groupBy("doc_id").agg(F.max("page_num").alias("_last")).select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_last"))).alias("page_num"))
    return spine.join(counts, ["doc_id", "page_num"], "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def best_page(pages: DataFrame, predicted: Column, score: Column) -> DataFrame:
    """The predicted page of the highest score of each document, the first of equals."""
    return pages.filter(predicted).groupBy("doc_id").agg(F.max(F.struct(score.alias("s"), (-F.col("page_num")).alias("p"))).alias("_b")).select("doc_id", (-F.col("_b.p")).alias("page_num"), F.col("_b.s").alias("score"))


def carry(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_num, f0, f1) -> is_toc: f1 where the page before came out 1, else f0, page after page.

    A page either fixes the state (f0 = f1), keeps it, or turns it round (f0 = 1, f1 = 0), so the state is that of the
    last page that fixed it, turned round as often as pages since then say: running sums, no fold."""
    order = W.partitionBy("doc_id").orderBy("page_num").rowsBetween(W.unboundedPreceding, W.currentRow)
    turns = F.sum(F.when((F.col("f0") == 1) & (F.col("f1") == 0), 1).otherwise(0)).over(order)
    marked = pages.withColumn("_t", turns)
    fixed = F.last(F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").alias("s"), F.col("_t").alias("t"))), True).over(order)
    state = (F.coalesce(F.col("_f.s"), F.lit(0)) + F.col("_t") - F.coalesce(F.col("_f.t"), F.lit(0))) % 2
    return marked.withColumn("_f", fixed).select("doc_id", "page_num", state.cast("int").alias("is_toc"))


def tag_after_contents(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_num, toc): prev_toc is 1 on the page after a contents page (pages may be missing).

    Where pages have a tag_method, an automatic label 0 of such a page is unset, to be given anew."""
    after = pages.filter("toc = 1").select("doc_id", (F.col("page_num") + 1).alias("page_num"), F.lit(1).alias("_after")).distinct()
    out = pages.join(after, ["doc_id", "page_num"], "left").withColumn("prev_toc", F.coalesce("_after", F.lit(0))).drop("_after")
    if "tag_method" not in pages.columns:
        return out
    again = (F.col("prev_toc") == 1) & F.coalesce(F.col("tag_method") == "auto", F.lit(False)) & (F.col("toc") == 0)
    return out.withColumn("toc", F.when(~F.coalesce(again, F.lit(False)), F.col("toc")))
