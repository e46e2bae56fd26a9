"""Sources: OCR responses, reconstructed lines, table text, datasets, metadata, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.operators.blocks import in_file
from quirefold.operators.tables import parse_table_text

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("Width", "Height", "Left", "Top")])
BLOCK = T.StructType(
    [
        T.StructField("Id", T.StringType()), T.StructField("BlockType", T.StringType()), T.StructField("Page", T.IntegerType()), T.StructField("Text", T.StringType()),
        T.StructField("Confidence", T.DoubleType()), T.StructField("RowIndex", T.IntegerType()), T.StructField("ColumnIndex", T.IntegerType()), T.StructField("SelectionStatus", T.StringType()),
        T.StructField("EntityTypes", T.ArrayType(T.StringType())), T.StructField("Geometry", T.StructType([T.StructField("BoundingBox", BOX)])),
        T.StructField("Relationships", T.ArrayType(T.StructType([T.StructField("Type", T.StringType()), T.StructField("Ids", T.ArrayType(T.StringType()))]))),
    ]
)
RESPONSE = T.StructType([T.StructField("JobStatus", T.StringType()), T.StructField("NextToken", T.StringType()), T.StructField("Blocks", T.ArrayType(BLOCK))])
LINE = T.StructType(
    [
        T.StructField("LineNum", T.IntegerType()), T.StructField("Text", T.StringType()), T.StructField("Confidence", T.DoubleType()), T.StructField("OriginalLines", T.ArrayType(T.IntegerType())),
        T.StructField("WordsWidth", T.DoubleType()), T.StructField("BoundingBox", BOX), T.StructField("OriginalBBs", T.ArrayType(BOX)),
    ]
)
PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("key", "label", "value")])
COMPONENT = T.StructType([T.StructField(n, T.StringType()) for n in ("compID", "type", "title", "sizeKB", "docType", "link", "download", "file")])

NAME = r"cr_([0-9]+)_([0-9]+)"


def with_ids(df: DataFrame, path: str = "_path") -> DataFrame:
    """doc_id and file_num out of a file's path; null where the name has another form."""
    number = lambda k: F.expr(f"try_cast(nullif(regexp_extract({path}, '{NAME}', {k}), '') as bigint)")
    return df.withColumn("doc_id", number(1)).withColumn("file_num", number(2))


def ocr_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per block of stored OCR responses (lists of result pages, or one page), with its place among all blocks of
    its file. A file is read whole, as the order of its result pages is that of a JSON list."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), "value")
    pages = with_ids(raw).select("doc_id", "file_num", F.posexplode(F.from_json("value", T.ArrayType(RESPONSE))).alias("response", "_r"))
    found = pages.select("doc_id", "file_num", "response", F.posexplode("_r.Blocks").alias("place", "b"))
    return in_file(found).select("doc_id", "file_num", "ord", "b.*")


def block_edges(blocks: DataFrame) -> DataFrame:
    """(doc_id, file_num, src, type, ord, dst) of the block graph."""
    edges = blocks.select("doc_id", "file_num", F.col("Id").alias("src"), F.explode("Relationships").alias("r"))
    return edges.select("doc_id", "file_num", "src", F.col("r.Type").alias("type"), F.posexplode("r.Ids").alias("ord", "dst"))


def reconstructed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stored line maps (page -> lines) in long form."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), "value")
    pages = with_ids(raw).select("doc_id", "file_num", F.explode(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(LINE)))).alias("page", "lines"))
    return pages.select("doc_id", "file_num", F.expr("try_cast(page as bigint)").alias("page_num"), F.explode("lines").alias("l")).select("doc_id", "file_num", "page_num", "l.*")


def table_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of framed table text files; the file's path is its id."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("content"))
    return parse_table_text(files)


def dataset(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A dataset with a header; quoted fields may hold line ends and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def report_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc key columns) one row per metadata file: its key-value list as a map; of a repeated key the last value counts."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_path"), F.posexplode(F.from_json("value", T.ArrayType(PAIR))).alias("_ord", "_p"))
    last = raw.filter("_p.key is not null").groupBy("_path", F.col("_p.key").alias("key")).agg(F.max_by("_p.value", "_ord").alias("value"))
    return last.groupBy("_path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))


def components(spark: SparkSession, path: str) -> DataFrame:
    """Component lists, the size as an integer where it is one."""
    return spark.read.schema(COMPONENT).json(path, multiLine=True).withColumn("size_kb", F.expr("try_cast(sizeKB as int)"))


def listing(spark: SparkSession, path: str, glob: str = "*", kinds: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, doc_id, file_num, extension) of files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("_path"), "length")
    named = with_ids(files).withColumn("extension", F.lower(F.regexp_extract("_path", r"\.([^./]*)$", 1)))
    return (named.filter(F.col("extension").isin(*kinds)) if kinds else named).withColumnRenamed("_path", "path")


def report_numbers(keys: DataFrame) -> DataFrame:
    """keys (key) with the file number in its name: what stands between the last underscore and the extension."""
    return keys.withColumn("report_num", F.regexp_extract("key", r"_([^_.]*)\.[^_]*$", 1))


def first_with_prefix(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(prefix, key): the first key, in key order, that begins with a wanted prefix and a full stop. Keys meet prefixes by
    what stands before one of their stops, so there is no comparison of all with all."""
    stops = F.split("key", r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(stops) - 1), lambda i: F.array_join(F.slice(stops, 1, i), "."))
    cut = keys.filter(F.col("key").contains(".")).select("key", F.explode(starts).alias("prefix"))
    return cut.join(wanted.select("prefix").distinct(), "prefix").groupBy("prefix").agg(F.min("key").alias("key"))


def numbered_names(keys: DataFrame) -> DataFrame:
    """(doc_id, file_num) of file names such as cr_12_3.docx; names whose numbers hold letters are left out."""
    stem = F.regexp_extract("key", r"([^/]*?)(\.[^./]*)?$", 1)
    parts = F.split(stem, "_")
    named = keys.select(F.try_element_at(parts, F.lit(2)).alias("doc_id"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("1")).alias("file_num"))
    return named.filter(F.col("doc_id").rlike("^[0-9]+$") & F.col("file_num").rlike("^[0-9]+$"))


def file_path(folder: str, kind: str, ending: str, mode: str | None = None) -> Column:
    """Where a document's file of a kind lies: folder/[mode/]kind/cr_<doc_id>_<file_num><ending>."""
    parts = [p for p in (folder.rstrip("/"), mode, kind) if p]
    return F.concat(F.lit("/".join(parts) + "/cr_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("file_num").cast("string"), F.lit(ending))


# Headers of the delimited files of drilling data, by kind of file.
DRILLING = {
    "collar": {"site": ("HOLEID", "HOLE_ID", "HOLE"), "east": ("EAST", "EASTING"), "north": ("NORTH", "NORTHING"), "level": ("RL", "ELEVATION", "LEVEL")},
    "lithology": {"site": ("HOLEID", "HOLE_ID", "HOLE"), "from": ("FROM", "SAMPFROM", "DEPTH_FROM"), "to": ("TO", "SAMPTO", "DEPTH_TO"), "rock": ("LITH", "LITHOLOGY", "ROCK")},
    "assay": {"site": ("HOLEID", "HOLE_ID", "HOLE"), "from": ("FROM", "SAMPFROM", "DEPTH_FROM"), "to": ("TO", "SAMPTO", "DEPTH_TO"), "sample": ("SAMPLE", "SAMPLEID", "SAMPLE_NO")},
}


def drilling(spark: SparkSession, path: str, kind: str, sep: str = ",") -> DataFrame:
    """Delimited drilling data under common names, all other columns as they are, texts trimmed; numbers where they are."""
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    upper = {c.strip().upper(): c for c in raw.columns}
    found = {name: next((upper[h] for h in headers if h in upper), None) for name, headers in DRILLING[kind].items()}
    texts = ("site", "rock", "sample")
    value = lambda name, c: F.trim(F.col(f"`{c}`")) if name in texts else F.trim(F.col(f"`{c}`")).try_cast("double")
    known = [(value(n, c) if c else F.lit(None).cast("string" if n in texts else "double")).alias(n) for n, c in found.items()]
    return raw.select(*known, *[F.trim(F.col(f"`{c}`")).alias(c) for c in raw.columns if c not in found.values() and c.strip().lower() not in found])
