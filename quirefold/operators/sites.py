"""Named sites (boreholes) and their coordinates out of table cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators.tables import neighbours, parse_table_text

# Header and key terms by kind, as comma lists (a comma inside brackets also separates).
SITE_TERMS = (
    "Hole ID, borehole nu, drillhole, no. hole, hole no., Hole No. (Site No.), bore, hole, well, drill hole, hole #, bore or well reference number, "
    "bore or well reference nu, borehole, uphole, holeid, bh_id, well name, bore no, borehole number, hole name, bore site, hole number",
    "hole number, drill hole, well name and, well no, borehole no, well number, Identifying name of the petroleum well, well name and number, well, well name, hole name",
)
GEO_TERMS = ("latitude, longitude", "Latitude, longitude, lat, long")
GRID_TERMS = (
    "Survey ea, survey no, surveyed ea, surveyed no, collar (local easting, coordinates grid) northing, northing, easting, Easting AMG (Local), Northing AMG (Local), "
    "Co-ords, collar, Local E & N, Co-Ordinates North/East, collar east, collar north, AMG east, AMG north, East AGD66 Zone 54, North AGD66 Zone 54, AMGEASTIN, "
    "AMGNORTH, east, north, Easting (m), Northing (m), surveyed easting, surveyed northing, Easting AGD84 Zone 54, Northing AGD84 Zone 54, e m mga n m mga,amg coordinates",
    "northing, easting, grid (amg), grid location, surveyed location, location, field location",
)
VOCABULARY = {"site": SITE_TERMS, "geo": GEO_TERMS, "grid": GRID_TERMS}
#: Kinds in order of priority.
KINDS = ("site", "geo", "grid")
LEAST_SIMILARITY = 0.8


def vocabulary(spark: SparkSession, terms: dict[str, tuple[str, ...]] = VOCABULARY) -> DataFrame:
    """(kind, term), normalised and distinct."""
    rows = [(kind, t) for kind, lists in terms.items() for text in lists for t in text.split(",")]
    return spark.createDataFrame(rows, "kind string, term string").select("kind", X.normalized_header(F.col("term")).alias("term")).filter("term <> ''").distinct()


#: Terms of a vocabulary, which every task holds.
MAX_TERMS = 10_000


def match_headers(headers: DataFrame, vocab: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """headers (header) -> (header, kind, similarity): the best term of each kind by character multisets, if good enough.

    Texts whose lengths differ too much cannot be that similar: a header only meets terms of like length. The vocabulary
    is sent to all tasks; its size is checked."""
    if vocab.limit(MAX_TERMS + 1).count() > MAX_TERMS:
        raise ValueError(f"a vocabulary has more than {MAX_TERMS} terms")
    norm = headers.select("header", X.normalized_header(F.col("header")).alias("_n")).distinct().filter("_n <> 'nan' and not contains(_n, 'unnamed') and _n <> ''")
    size = F.length("term")
    reach = F.sequence(F.ceil(size * F.lit(least)).cast("int"), F.floor(size / F.lit(least)).cast("int"))
    terms = F.broadcast(vocab.select("kind", "term", F.explode(reach).alias("_size")))
    met = norm.withColumn("_size", F.length("_n")).join(terms, "_size")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    both = F.aggregate(F.array_distinct(chars(F.col("term"))), F.lit(0), lambda acc, x: acc + F.least(count(chars(F.col("_n")), x), count(chars(F.col("term")), x)))
    pairs = met.select("header", "kind", (both / (F.col("_size") + size - both)).alias("similarity"))
    return pairs.groupBy("header", "kind").agg(F.max("similarity").alias("similarity")).filter(F.col("similarity") >= least)


def header_roles(matches: DataFrame) -> DataFrame:
    """(header, role): the kind of highest priority."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return matches.groupBy("header").agg(F.min_by("kind", rank).alias("role"))


LOCATIONS = ("grid_loc_1", "grid_loc_2", "geo_loc_1", "geo_loc_2")
VALUES = ("site_name", *LOCATIONS)
SOURCES = tuple(f"{v}_source" for v in VALUES)


def extract_columns(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """Column mode: body rows with a valid site name in the last site column, and two columns of either kind of location;
    the sources are the columns' headers."""
    known = cells.join(roles, "header")
    columns = known.select("table_id", "role", "col").distinct()
    order = F.row_number().over(W.partitionBy("table_id", "role").orderBy("col"))
    last = F.max("col").over(W.partitionBy("table_id", "role"))
    slots = columns.withColumn("_o", order).withColumn("_last", last)
    slot = F.when(F.col("role") == "site", F.when(F.col("col") == F.col("_last"), F.lit("site_name"))).when(F.col("_o") <= 2, F.concat("role", F.lit("_loc_"), F.col("_o").cast("string")))
    slots = slots.select("table_id", "col", slot.alias("slot")).filter("slot is not null")
    values = known.join(slots, ["table_id", "col"])
    pick = lambda c, s: F.max(F.when(F.col("slot") == s, F.col(c)))
    rows = values.groupBy("table_id", "row").agg(*[pick("value", v).alias(v) for v in VALUES], *[pick("header", v).alias(f"{v}_source") for v in VALUES])
    return rows.filter(X.site_name_class(F.col("site_name")) == "valid")


def with_header_row(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, value) of body cells, and of headers as row 0."""
    head = cells.select("table_id", F.lit(0).cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("header").alias("value")).distinct()
    return head.unionByName(cells.select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"))


def extract_keys(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """Key mode: the last cell, headers included, that is a site key, and the first two keys of either kind of location,
    each with the value to its right or else below; the sources are the keys.

    A name without digits takes the number in the cell right of it. Without a site there is no row."""
    marked = with_header_row(cells).join(roles.select(F.col("header").alias("value"), "role"), "value", "left")
    found = neighbours(marked, X.site_name_class(F.col("value")), F.col("role") == "site")

    def named(d: str):
        number = F.when(X.number_class(F.col(f"{d}_next")) == "valid", F.concat(F.col(f"{d}_value"), F.lit(" "), F.col(f"{d}_next")))
        return F.when(F.col(f"{d}_class") == "valid", F.col(f"{d}_value")).when(F.col(f"{d}_class") == "invalid_no_num", number)

    value = F.coalesce(named("right"), named("down"))
    site = found.withColumn("site_name", value).groupBy("table_id").agg(F.max_by(F.struct("site_name", F.col("value").alias("site_name_source")), F.struct("row", "col")).alias("_t"))
    site = site.select("table_id", "_t.*").filter("site_name is not null")
    placed = neighbours(marked, X.location_class(F.col("value")), F.col("role").isin("geo", "grid"))
    valid = lambda d: F.when(F.col(f"{d}_class") == "valid", F.col(f"{d}_value"))
    placed = placed.join(roles.select(F.col("header").alias("value"), "role"), "value").withColumn("_v", F.coalesce(valid("right"), valid("down")))
    slot = F.row_number().over(W.partitionBy("table_id", "role").orderBy("row", "col"))
    placed = placed.withColumn("slot", F.concat("role", F.lit("_loc_"), slot.cast("string")))
    pick = lambda c, s: F.max(F.when(F.col("slot") == s, F.col(c)))
    wide = placed.groupBy("table_id").agg(*[pick("_v", v).alias(v) for v in LOCATIONS], *[pick("value", v).alias(f"{v}_source") for v in LOCATIONS])
    return site.join(wide, "table_id", "left").select("table_id", *VALUES, *SOURCES)


def extract_sites(cells: DataFrame, spark_vocabulary: DataFrame) -> DataFrame:
    """All tables' sites, by columns and by keys, each row once: (table_id, values, sources). cells: (table_id, row, col,
    header, value); every distinct header and cell is classified once."""
    names = cells.select("header").unionByName(cells.select(F.col("value").alias("header"))).filter("header is not null").distinct()
    roles = header_roles(match_headers(names, spark_vocabulary))
    return finalize(extract_columns(cells, roles).drop("row").unionByName(extract_keys(cells, roles)))


def extract_from_files(files: DataFrame, vocab: DataFrame) -> DataFrame:
    """(file_id, table_num, values, sources) of framed table text files (file_id, content): the per-file driver for any
    number of files."""
    cells = parse_table_text(files).withColumn("table_id", F.struct("file_id", "table_num"))
    return extract_sites(cells, vocab).select("table_id.file_id", "table_id.table_num", *VALUES, *SOURCES)


def finalize(rows: DataFrame) -> DataFrame:
    """Distinct rows that have a site name."""
    return rows.dropDuplicates().dropna(subset=["site_name"])
