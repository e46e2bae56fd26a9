"""Exact duplicates by progressive refinement, in native expressions only.

Texts are equal when they are after deletion of white space. Three passes, each over what the one before left:

1. normalised length - a row with a length of its own is unique;
2. a hash of the first characters, for rows that share a length - again lone ones drop out;
3. SHA-256 of the whole content, for the surviving rows only.

Counts are aggregated before they are shuffled. Group tables go back to the rows by joins that adaptive execution can
split, and texts are only ever joined by row key, so a length, prefix or text that a third of all rows has does not
land in one task. Small tables between the passes are written to the shared folder, which cuts lineage.

Defined results: a null text counts as empty; empty texts equal each other; of equal texts the row with the most code
points in its original text stays, then the one with the smallest id (null ids last); rows that repeat both id and text
are one document: each is reported, and `drop_duplicates` leaves one of them; rows that repeat an id with another text
are judged by their text, the one with the most code points stays also where white space alone differs; very long texts
are compared whole; an empty table gives an empty result; other columns are passed on unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.store import keyed, materialize, settle

#: The white space that does not count.
WHITE = " \t\n\x0b\x0c\r"
#: Characters under the second pass's hash.
PREFIX_CHARS = 256


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def content_sha(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def _several(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that two rows or more have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)


def _finalists(rows: DataFrame) -> DataFrame:
    """(_key, _id, _points, _sha) of the rows (_key, _id, _text) that share length and prefix hash with another row."""
    norm = normalized(F.col("_text"))
    lengths = materialize(_several(rows.select(F.length(norm).alias("_len")), "_len"), "lengths")
    prefixed = rows.select("_key", F.length(norm).alias("_len"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("_prefix"))
    prefixed = materialize(prefixed.join(lengths, "_len", "left_semi"), "prefixed")
    prefixes = materialize(_several(prefixed, "_len", "_prefix"), "prefixes")
    keys = materialize(prefixed.join(prefixes, ["_len", "_prefix"], "left_semi").select("_key"), "survivors")
    points = F.length(F.coalesce(F.col("_text"), F.lit("")))
    surviving = rows.join(keys, "_key", "left_semi")
    return materialize(surviving.select("_key", "_id", points.alias("_points"), F.sha2(norm, 256).alias("_sha")), "finalists")


def _groups(finalists: DataFrame) -> DataFrame:
    """(_sha, keep_id, keep_key, group_size): most code points first, then the smallest id, null ids last."""
    rank = F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_key").alias("k"))
    found = finalists.groupBy("_sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("_best")).filter("group_size > 1")
    return materialize(found.select("_sha", F.col("_best.i").alias("keep_id"), F.col("_best.k").alias("keep_key"), "group_size"), "groups")


def _rows(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str, DataFrame]:
    """df, the name of its key column, and (_key, _id, _text)."""
    whole, key = keyed(df, id_col)
    return whole, key, whole.select(F.col(key).alias("_key"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text that several rows have: (text_sha256, keep_id, group_size)."""
    rows = _rows(df.select(id_col, text), id_col, text)[2]
    return settle(df.sparkSession, "groups", lambda: _groups(_finalists(rows))).select(F.col("_sha").alias("text_sha256"), "keep_id", "group_size")


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with df's columns. Only the keys of rows that go meet df again, so texts are
    neither hashed nor compared a second time, and not moved unless those keys are too many to be sent to every task."""
    whole, key, rows = _rows(df, id_col, text)

    def losers() -> DataFrame:
        finalists = _finalists(rows)
        members = finalists.join(_groups(finalists).select("_sha", "keep_key"), "_sha")
        return members.filter("_key <> keep_key").select(F.col("_key").alias("_gone"))

    gone = settle(df.sparkSession, "gone", losers)
    out = whole.join(gone, whole[key] == gone["_gone"], "left_anti")
    return out if key == id_col else out.drop(key)
