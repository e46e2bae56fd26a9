"""Composed steps of a report: clean lines from responses, the models' feature frames, contents, in-text headings, links,
and the whole report as one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import blocks as B
from quirefold.operators import headings as H
from quirefold.operators import lines as L
from quirefold.operators.keys import page_keys


def clean_lines(blocks: DataFrame) -> DataFrame:
    """Reconstructed lines of documents from their blocks: the page's own lines, without margin noise, put together."""
    boxes = L.drop_margin_noise(B.page_lines(blocks)).withColumn("ord", F.col("line_num"))
    return L.merge_lines(L.assign_lines(boxes.select(*page_keys(blocks), "ord", "text", "confidence", "left", "top", "width", "height")))


def toc_lines(lines: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """The lines of each document's contents page. toc_pages (doc_id, page_num)."""
    return lines.join(toc_pages.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")


def body_lines(lines: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """All other lines, those of documents without a contents page among them."""
    return lines.join(toc_pages.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_anti")


def marginal_frame(dataset: DataFrame) -> DataFrame:
    """Features of lines for the model of headers and footers."""
    t = F.col("text")
    flags = {"contains_num": X.contains_number_token(t), "contains_tab": X.contains_tab(t), "contains_page": X.contains_word(t, "page")}
    return dataset.drop("word_count", *flags).select("*", *[c.alias(n) for n, c in flags.items()])


def coded_heading(text: Column) -> Column:
    """A contents line with its section number and its page as coded numbers."""
    body, page = X.split_page_number(text)
    prefix, rest = X.split_prefix(body)
    return F.concat(X.coded_number(prefix), rest, X.coded_number(page))


def toc_heading_frame(dataset: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """(doc_id, line_num, left, top, text) of contents lines, with their section prefix, text, page and coded text."""
    rows = toc_lines(dataset, toc_pages).select("doc_id", "line_num", "left", "top", "text")
    body, page = X.split_page_number(F.col("text"))
    prefix, rest = X.split_prefix(body)
    return rows.select("*", prefix.alias("section_prefix"), rest.alias("section_text"), page.alias("section_page"), coded_heading(F.col("text")).alias("processed"))


def contents(predicted: DataFrame) -> DataFrame:
    """Headings of contents pages (doc_id, heading_id, level, heading, line_num): lines that the model gave class 1 or 2.
    The id is the line's number."""
    return predicted.filter(F.col("heading").isin(1, 2)).select("doc_id", F.col("line_num").alias("heading_id"), F.col("heading").cast("long").alias("level"), F.col("text").alias("heading"), "line_num")


def intext_frame(dataset: DataFrame, toc_pages: DataFrame, headings: DataFrame) -> DataFrame:
    """Features of body lines for the model of in-text headings: number flag, and the best heading of the contents
    (matches_heading, matches_type, matches_id; all 0 where none shares a word)."""
    rows = body_lines(dataset, toc_pages)
    best = H.best_heading(H.similarities(rows, headings.select("doc_id", "heading_id", "level", "heading")))
    named = best.select("doc_id", "line_num", F.col("similarity").alias("matches_heading"), F.col("level").alias("matches_type"), F.col("heading_id").alias("matches_id"))
    out = rows.drop("contains_num").join(named, ["doc_id", "line_num"], "left").fillna(0, ["matches_heading", "matches_type", "matches_id"])
    return out.withColumn("contains_num", X.starts_numbered(F.col("text")))


def intext_headings(with_toc: DataFrame, without_toc: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """Predicted headings of the text: of documents with a contents page those lines that also match one of its headings,
    of the others what the model without match features gives. Both frames: (doc_id, line_num, heading, ...)."""
    docs = toc_pages.select("doc_id").distinct()
    matched = with_toc.filter("heading > 0 and matches_heading > 0").join(docs, "doc_id", "left_semi")
    return matched.unionByName(without_toc.filter("heading > 0").join(docs, "doc_id", "left_anti"), allowMissingColumns=True)


def toc_link_boxes(headings: DataFrame, found: DataFrame, lines: DataFrame, width: float, height: float) -> DataFrame:
    """Links from contents lines to the places of their headings: (doc_id, heading_id, page_num, x0, y0, x1, y1).

    headings (doc_id, heading_id, page_num and line_num on the contents page), found (doc_id, heading_id, page_num of the
    text's heading), lines with their boxes."""
    places = headings.select("doc_id", "heading_id", F.col("page_num").alias("_toc"), "line_num")
    boxes = H.link_rectangles(lines.select("doc_id", F.col("page_num").alias("_toc"), "line_num", "left", "top", "width", "height"), width, height)
    return found.select("doc_id", "heading_id", "page_num").join(places, ["doc_id", "heading_id"]).join(boxes, ["doc_id", "_toc", "line_num"]).select("doc_id", "heading_id", "page_num", "x0", "y0", "x1", "y1")


def boxes_at_pages(lines: DataFrame, marks: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_num", "line_num")) -> DataFrame:
    """Lines that are marked (marginals, headings), with the mark's columns: what an overlay draws on each page."""
    return lines.join(marks, list(keys))


def report_objects(sections: DataFrame, tree: DataFrame, toc_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, report): each document as one JSON object with its contents page, number of pages, sections in order
    and bookmarks. sections (doc_id, heading_id, n_lines, content), tree as `bookmarks` gives it."""
    listed = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("heading_id", "n_lines", "content"))).alias("sections"))
    marks = tree.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "parent", "heading_id", "page_num"))).alias("bookmarks"))
    count = pages.groupBy("doc_id").agg(F.max("page_num").alias("n_pages"))
    toc = toc_pages.groupBy("doc_id").agg(F.min("page_num").alias("toc_page"))
    whole = count.join(toc, "doc_id", "left").join(listed, "doc_id", "left").join(marks, "doc_id", "left")
    return whole.select("doc_id", F.to_json(F.struct("doc_id", "n_pages", "toc_page", "sections", "bookmarks")).alias("report"))


def page_id_rows(marginals: DataFrame) -> DataFrame:
    """Rows of the page-number models from header and footer lines: token shapes, once with small numbers as they are."""
    t = F.col("text")
    return marginals.select("doc_id", "page_num", "line_num", "text", X.token_shapes(t).alias("shapes"), X.token_shapes(t, literal_small=True).alias("transformed"), X.page_number(t).alias("page_text"))


def training_frames(dataset: DataFrame, toc_pages: DataFrame, headings: DataFrame) -> dict[str, DataFrame]:
    """The line datasets of all models by model card."""
    return {"marginal_lines": marginal_frame(dataset), "heading_id_toc": toc_heading_frame(dataset, toc_pages), "heading_id_intext": intext_frame(dataset, toc_pages, headings)}
