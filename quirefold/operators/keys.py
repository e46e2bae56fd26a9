"""What tells documents and pages apart."""

from __future__ import annotations

from pyspark.sql import DataFrame


def document_keys(df: DataFrame) -> tuple[str, ...]:
    """A report may have several files, each with pages, tables and forms of its own: where rows have a file number, a
    document is a report's file."""
    return ("doc_id", "file_num") if "file_num" in df.columns else ("doc_id",)


def page_keys(df: DataFrame) -> tuple[str, ...]:
    return (*document_keys(df), "page_num")
