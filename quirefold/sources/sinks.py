"""Sinks: text renderings and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.operators.keys import document_keys
from quirefold.sources.shared import materialize


def page_text(blocks: DataFrame) -> DataFrame:
    """(document's keys, content): the text of LINE blocks, an empty line for each PAGE, in block order."""
    keys = document_keys(blocks)
    line = F.when(F.col("BlockType") == "LINE", F.coalesce("Text", F.lit(""))).when(F.col("BlockType") == "PAGE", F.lit(""))
    kept = blocks.select(*keys, "ord", line.alias("_l")).filter("_l is not null")
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_l"))), lambda x: x["_l"]), "\n").alias("content"))


def section_text(sections: DataFrame) -> DataFrame:
    """(doc_id, content): headings and their content in order, a blank line between sections."""
    part = F.concat("heading", F.lit("\n"), "content")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("t")))), lambda x: x["t"])
    return sections.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("content"))


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a dataset. Every part file has the header, as a reader of the folder expects it; `single_csv` renders
    one file with one header."""
    df.write.mode("append").option("header", "true").csv(path)


def single_csv(df: DataFrame, order: list[str]) -> DataFrame:
    """(part, content): comma-separated text in order, in parts whose contents make one file one after the other; only the
    first has the header."""
    quoted = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = F.concat_ws(",", *[quoted(F.col(c).cast("string")) for c in df.columns])
    parts = materialize(df.repartitionByRange(*order).select(F.spark_partition_id().alias("part"), F.struct(*order, line.alias("_line")).alias("_r")), "csv_parts")
    text = parts.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda x: F.concat(x["_line"], F.lit("\n"))), "").alias("content"))
    head = df.sparkSession.createDataFrame([(-1, ",".join(df.columns) + "\n")], "part int, content string")
    return head.unionByName(text)


def pair_text(pairs: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, content): form entries, a key and its value a line."""
    keys = keys or document_keys(pairs)
    line = F.concat("key", F.lit(","), "value", F.lit("\n"))
    return pairs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("_l")))), lambda x: x["_l"]), "").alias("content"))


def line_maps(lines: DataFrame) -> DataFrame:
    """(document's keys, content): a document's lines as JSON, a list of lines for each page; lines of no page are left out."""
    keys = document_keys(lines)
    fields = [c for c in lines.columns if c not in (*keys, "page_num")]
    pages = lines.filter("page_num is not null").groupBy(*keys, "page_num").agg(F.array_sort(F.collect_list(F.struct("line_num", *[c for c in fields if c != "line_num"]))).alias("_l"))
    return pages.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page_num").cast("string"), "_l"))))).alias("content"))


def write_dataset(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrite a dataset; it must not be one that df reads."""
    if any(f.rstrip("/").removeprefix("file://").startswith(path.rstrip("/").removeprefix("file://") + "/") for f in df.inputFiles()):
        raise ValueError("a dataset cannot overwrite its own input")
    writer = df.write.mode("overwrite")
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)


#: Folders over which lines are spread.
LINE_BUCKETS = 256


def write_lines(lines: DataFrame, path: str, buckets: int = LINE_BUCKETS) -> None:
    """Lines as JSON in a fixed number of folders by a hash of the document, whatever the number of documents."""
    spread = lines.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    spread.repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def unprocessed(inputs: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Inputs that have no output yet; all of them if forced."""
    return inputs if force else inputs.join(done.select(*keys).distinct(), keys, "left_anti")
