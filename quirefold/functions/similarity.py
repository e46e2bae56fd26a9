"""Multiset similarities, by counts rather than by expanded multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import tokens


def word_counts(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, word, n, size): how often each word occurs in a row's text, and the number of its words."""
    words = df.select(*keys, F.transform(tokens(F.lower(text)), lambda w: w).alias("_w"))
    return words.select(*keys, F.size("_w").cast("long").alias("size"), F.explode("_w").alias("word")).groupBy(*keys, "size", "word").agg(F.count(F.lit(1)).alias("n"))


def multiset_jaccard(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], same: list[str] | None = None) -> DataFrame:
    """(left keys, right keys, similarity) of pairs that share a word: an inverted-index join, no cross join.

    same: columns of both sides that must agree too, part of the left keys or not."""
    same = same or []
    keys = [*left_keys, *[k for k in right_keys if k not in left_keys]]
    r = right.select(*same, *[k for k in right_keys if k not in same], "word", F.col("n").alias("_n"), F.col("size").alias("_size"))
    shared = left.join(r, [*same, "word"]).groupBy(*keys, "size", "_size").agg(F.sum(F.least("n", "_n")).alias("_both"))
    return shared.select(*keys, (F.col("_both") / (F.col("size") + F.col("_size") - F.col("_both"))).alias("similarity"))
