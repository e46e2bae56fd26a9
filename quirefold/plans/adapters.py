"""The driver's tables as logical inputs of the engine, each in Spark and as a SQL table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions.text import rule_heading, tokens, word_count
from quirefold.operators.blocks import in_file
from quirefold.sources.shared import spread

LINES_PER_PAGE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), spread over the cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_num, line_num of the document, line_on_page, text)."""
    docs = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "text"))
    line = F.col("_p") + 1
    return docs.select("doc_id", F.ceil(line / LINES_PER_PAGE).cast("long").alias("page_num"), line.cast("long").alias("line_num"), (F.col("_p") % LINES_PER_PAGE + 1).cast("long").alias("line_on_page"), "text")


LINES = f"""lines as (select doc_id, ((ord - 1) // {LINES_PER_PAGE} + 1)::bigint page_num, ord::bigint line_num, ((ord - 1) % {LINES_PER_PAGE} + 1)::bigint line_on_page, line as text
    from documents, unnest(string_split(documents.text, chr(10))) with ordinality t(line, ord))"""


#: Boxes of a page, headings' words, and rows of a table: what one page, heading or table holds does not grow with the data.
BOXES_PER_PAGE, HEADING_WORDS, ROWS_PER_TABLE = 50, 5, 40


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes of pages: (doc_id, page_num, ord, text, confidence, left, top, width, height)."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.col("event_id")
    numbered = e.withColumn("_n", F.row_number().over(order) - 1)
    page, place = F.floor(F.col("_n") / BOXES_PER_PAGE).cast("long") + 1, (F.col("_n") % BOXES_PER_PAGE).cast("long") + 1
    boxed = numbered.select(F.col("user_id").alias("doc_id"), page.alias("page_num"), place.alias("ord"), F.col("event_type").alias("text"), F.col("value").alias("confidence"), ((k % 2) * F.lit(0.8) + (k % 10) / F.lit(100.0)).alias("left"), ((1 + k % 7) / F.lit(100.0)).alias("width"), F.lit(0.01).alias("height"))
    return boxed.withColumn("top", F.col("ord") * F.lit(0.004))


BOXES = f"""boxes as (select * exclude (n), ord * 0.004::double as top from (select user_id doc_id, n, (n // {BOXES_PER_PAGE} + 1)::bigint page_num, (n % {BOXES_PER_PAGE} + 1)::bigint ord,
    event_type as text, value confidence, (event_id % 2) * 0.8::double + (event_id % 10) / 100.0::double as left, (1 + event_id % 7) / 100.0::double width, 0.01::double height
    from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 n from events)))"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's contents: (doc_id, heading_id, level, heading), the first words of the first line of each page."""
    first = lines(spark, sf_dir).filter("line_on_page = 1")
    words = F.slice(tokens(F.col("text")), 1, HEADING_WORDS)
    return first.select("doc_id", F.col("page_num").alias("heading_id"), (1 + F.col("page_num") % 2).alias("level"), F.array_join(words, " ").alias("heading")).filter("heading <> ''")


HEADINGS = f"""headings as (select * from (select doc_id, page_num heading_id, 1 + page_num % 2 as level,
    array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:{HEADING_WORDS}], ' ') heading from lines where line_on_page = 1) where heading <> '')"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report metadata: (repno, rstatus, rtype, repdate, submitby)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("repno"), F.col("o_orderstatus").alias("rstatus"), F.col("o_orderpriority").alias("rtype"), F.to_date("o_orderdate").alias("repdate"), F.col("c_mktsegment").alias("submitby"))


REPORTS = "reports as (select o_orderkey repno, o_orderstatus rstatus, o_orderpriority rtype, o_orderdate::date repdate, c_mktsegment submitby from orders join customer on o_custkey = c_custkey)"

COLUMNS = ("p_name", "p_type", "p_size", "p_retailprice")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in long form: (table_id, row, col, header, value); a table is a stretch of parts of one brand."""
    p = table(spark, sf_dir, "part").withColumn("table_id", F.concat("p_brand", F.lit("-"), F.floor(F.col("p_partkey") / (25 * ROWS_PER_TABLE)).cast("string")))
    p = p.withColumn("row", F.row_number().over(W.partitionBy("table_id").orderBy("p_partkey")).cast("long"))
    values = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("col"), F.lit(c).alias("header"), (F.round(c, 0).cast("long") if c == "p_retailprice" else F.col(c)).cast("string").alias("value")) for i, c in enumerate(COLUMNS)])
    return p.select("table_id", "row", F.explode(values).alias("c")).select("table_id", "row", "c.col", "c.header", "c.value")


CELLS = f"""part_rows as (select *, row_number() over (partition by brand order by p_partkey) as row from (select *, p_brand || '-' || (p_partkey // {25 * ROWS_PER_TABLE})::varchar brand from part)),
    cells as (select brand table_id, row, 1::bigint col, 'p_name' header, p_name as value from part_rows
        union all select brand, row, 2, 'p_type', p_type from part_rows union all select brand, row, 3, 'p_size', p_size::varchar from part_rows
        union all select brand, row, 4, 'p_retailprice', round(p_retailprice, 0)::bigint::varchar from part_rows)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled set: (doc_id, y, tag_method)."""
    k = F.col("doc_id") % 3
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("y"), F.when(k == 0, "manual").when(k == 1, "auto").alias("tag_method"))


LABELLED = "labelled as (select doc_id, quality::bigint y, case doc_id % 3 when 0 then 'manual' when 1 then 'auto' end tag_method from labels)"


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents-like lines with numbers and tabs: (line_id, text)."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.when(k % 3 == 0, F.concat((k % 9 + 1).cast("string"), F.lit("."), (c % 10).cast("string"))).when(k % 3 == 1, F.concat((k % 12).cast("string"), F.lit("."))).otherwise(F.lit(""))
    name = F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" Of "), F.col("o_orderstatus"))
    page = F.when(k % 2 == 0, F.concat(F.lit(" \t"), (k % 100).cast("string"))).otherwise(F.lit(" page 1998 may"))
    return o.select(k.alias("line_id"), F.concat(number, name, page).alias("text"))


NUMBERED = """numbered as (select o_orderkey line_id, (case o_orderkey % 3 when 0 then (o_orderkey % 9 + 1)::varchar || '.' || (o_custkey % 10)::varchar when 1 then (o_orderkey % 12)::varchar || '.' else '' end)
    || ' ' || lower(o_orderpriority) || ' Of ' || o_orderstatus || case when o_orderkey % 2 = 0 then ' ' || chr(9) || (o_orderkey % 100)::varchar else ' page 1998 may' end as text from orders)"""


def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the lines of a contents page: (doc_id, line_num, text, left, heading). A line with a number
    has the level of its number and is indented by it, one without belongs to the level above it, so the level depends on
    the lines before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey").join(numbered_lines(spark, sf_dir), F.col("o_orderkey") == F.col("line_id"))
    order = W.partitionBy("doc_id").orderBy("line_id")
    level = F.nullif(rule_heading(F.col("text")), F.lit(0))
    known = F.last(level, True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return o.select("doc_id", F.row_number().over(order).cast("long").alias("line_num"), "text", F.when(level.isNull(), 0.12).otherwise(0.06 + level * 0.04).alias("left"), F.coalesce(known, F.lit(0)).cast("int").alias("heading"))


def marginal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and footers in eight layouts: (line_id, text, position: that of the page number from the end, from 0; null
    where there is none). Layouts have the same tokens in other places."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))
    page, year, name = (F.col("o_orderkey") % 90 + 1).cast("string"), (F.lit(1950) + F.col("o_custkey") % 60).cast("string"), F.lower(F.regexp_replace("o_orderpriority", "[0-9]-| ", ""))
    # the places of page number (p), year (y), name (n) and other words in each layout
    layouts = ["page p", "p \t n", "n p \t y", "p of n y", "p \t n y may", "n \t y", "report n p may", "y n of n"]
    what = {"p": page, "y": year, "n": name}
    texts = F.array(*[F.array_join(F.array(*[what.get(w, F.lit(w)) for w in x.split(" ")]), " ") for x in layouts])
    places = F.array(*[F.lit(x.split(" ")[::-1].index("p") if "p" in x.split(" ") else None).cast("int") for x in layouts])
    k = (F.xxhash64("o_orderkey") % len(layouts) + len(layouts)) % len(layouts)
    return o.select(F.col("o_orderkey").alias("line_id"), F.get(texts, k.cast("int")).alias("text"), F.get(places, k.cast("int")).alias("position"))


#: Part of a page's width that a character takes in print, left margin, and the longest line.
CHARACTER, MARGIN, LONGEST = 0.008, 0.1, 0.8


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with the box that their text would have in print."""
    t = F.col("text")
    width = F.least(F.greatest(F.length(t) * CHARACTER, F.lit(CHARACTER)), F.lit(LONGEST))
    ink = F.least(F.length(F.regexp_replace(t, r"\s", "")) * CHARACTER, F.lit(LONGEST))
    return lines(spark, sf_dir).select("doc_id", "page_num", "line_num", "text", word_count(t).alias("word_count"), (ink / width).alias("words2width"), width.alias("width"), F.lit(0.01).alias("height"), F.when(t.rlike("^[a-z]"), MARGIN).otherwise(F.lit(MARGIN / 2)).alias("left"))


def pdfs(counts: DataFrame) -> DataFrame:
    """counts (doc_id, n_pages) -> (doc_id, content): a PDF file of empty pages for each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for n in batch.column("n_pages").to_pylist():
                kids = b" ".join(b"%d 0 R" % (3 + k) for k in range(n))
                objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[%s]/Count %d>>" % (kids, n)] + [b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]>>"] * n
                data, places = bytearray(b"%PDF-1.4\n"), []
                for k, o in enumerate(objects):
                    places.append(len(data))
                    data += b"%d 0 obj\n%s\nendobj\n" % (k + 1, o)
                table = b"".join(b"%010d 00000 n \n" % p for p in places)
                data += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, table, len(places) + 1, len(data))
                out.append(bytes(data))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return counts.select("doc_id", "n_pages").mapInArrow(run, "doc_id bigint, content binary")


#: Orders whose blocks one result page holds.
ORDERS_PER_RESPONSE = 3


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block graph of two files a customer: a table per order status but P, a row an order, and a form entry and a
    line an order. As in stored responses, ids repeat from file to file and places from result page to result page."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 2 + 1).alias("file_num"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    file = W.partitionBy("doc_id", "file_num")
    o = o.withColumn("row", F.row_number().over(W.partitionBy("doc_id", "file_num", "s").orderBy("k"))).withColumn("n", F.row_number().over(file.orderBy("k")) - 1)
    none, key = F.lit(None).cast("string"), F.col("k").cast("string")
    name = lambda prefix: F.concat(F.lit(prefix), key)
    rel = lambda kind, *ids: F.struct(F.lit(kind).alias("type"), F.array(*ids).alias("ids"))
    no_rel = F.array().cast("array<struct<type:string,ids:array<string>>>")

    def block(kind, page, place, ident, text=none, row=None, col=None, ticked=none, entity=None, rels=no_rel, box=(None,) * 4):
        whole = lambda x: (F.lit(None) if x is None else x).cast("long")
        size = [(F.lit(None) if x is None else x).cast("double").alias(c) for c, x in zip(("left", "top", "width", "height"), box, strict=True)]
        return F.struct(
            page.cast("long").alias("response"), place.cast("long").alias("place"), ident.alias("id"), F.lit(kind).alias("block_type"), text.alias("text"), whole(row).alias("row_index"), whole(col).alias("col_index"),
            ticked.alias("selection_status"), (F.array(F.lit(entity)) if entity else F.array().cast("array<string>")).alias("entity_types"), rels.alias("relationships"), F.lit(1).cast("long").alias("page_num"),
            F.lit(90.0).alias("confidence"), *size,
        )

    page = F.floor(F.col("n") / ORDERS_PER_RESPONSE)
    at = lambda i: F.col("n") % ORDERS_PER_RESPONSE * 20 + 10 + i
    noise = F.col("k") % 11 == 0
    box = (F.when(noise, 0.01).otherwise(0.1 + F.col("k") % 3 * 0.3), F.floor(F.col("n") / 2) * 0.02, F.when(noise, 0.01).otherwise(0.2), F.lit(0.01))
    of_order = F.array(
        block("WORD", page, at(1), name("w1-"), F.col("p")),
        block("WORD", page, at(2), name("w2-"), key),
        block("SELECTION_ELEMENT", page, at(3), name("s-"), ticked=F.when(F.col("k") % 5 == 0, "SELECTED").otherwise("NOT_SELECTED")),
        block("CELL", page, at(4), name("c1-"), row=F.col("row"), col=F.lit(1), rels=F.array(rel("CHILD", name("w1-"), name("w2-")))),
        block("CELL", page, at(5), name("c2-"), row=F.col("row"), col=F.lit(2), rels=F.array(rel("CHILD", name("s-"), name("w2-")))),
        block("KEY_VALUE_SET", page, at(6), name("k-"), entity="KEY", rels=F.array(rel("VALUE", name("v-")), rel("CHILD", name("w1-")))),
        block("KEY_VALUE_SET", page, at(7), name("v-"), entity="VALUE", rels=F.array(rel("CHILD", name("w2-"), name("s-")))),
        block("LINE", page, at(8), name("l-"), F.concat(F.col("p"), F.lit(" "), key), box=box),
    )
    own = ("doc_id", "file_num")
    every = o.select(*own, F.explode(of_order).alias("b")).select(*own, "b.*")
    ids = lambda cond, *parts: F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("k")))), lambda k: F.array(*[F.concat(F.lit(x), k.cast("string")) for x in parts]))
    tables = o.filter("s <> 'P'").groupBy(*own, "s").agg(F.flatten(ids(F.lit(True), "c1-", "c2-")).alias("_ids"))
    # the table of F is the first block of the second result page, that of O stands later on the first
    late = F.col("s") == "F"
    tables = tables.select(*own, block("TABLE", late.cast("int"), F.when(late, 0).otherwise(5), F.concat(F.lit("t-"), "s"), rels=F.array(F.struct(F.lit("CHILD").alias("type"), F.col("_ids").alias("ids")))).alias("b")).select(*own, "b.*")
    pages = o.groupBy(*own).agg(F.flatten(ids(F.col("k") % 7 != 0, "l-")).alias("_ids"))
    pages = pages.select(*own, block("PAGE", F.lit(0), F.lit(1), F.lit("p-1"), rels=F.array(F.struct(F.lit("CHILD").alias("type"), F.col("_ids").alias("ids")))).alias("b")).select(*own, "b.*")
    return in_file(every.unionByName(tables).unionByName(pages))


BLOCK_CELLS = """block_rows as (select o_custkey doc_id, o_orderkey % 2 + 1 file_num, o_orderkey k, o_orderpriority p, o_orderstatus s,
        row_number() over (partition by o_custkey, o_orderkey % 2, o_orderstatus order by o_orderkey) as row, row_number() over (partition by o_custkey, o_orderkey % 2 order by o_orderkey) - 1 as n from orders),
    block_tables as (select doc_id, file_num, s, row_number() over (partition by doc_id, file_num order by s desc) table_num from (select distinct doc_id, file_num, s from block_rows where s <> 'P')),
    block_cells as (select doc_id, file_num, table_num, row, k, p || ' ' || k::varchar || ' ' c1, case when k % 5 = 0 then 'X ' else '' end || k::varchar || ' ' c2 from block_rows join block_tables using (doc_id, file_num, s))"""
