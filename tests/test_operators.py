"""Operators on small inputs: order and partitions do not matter, sources and sinks round-trip, streams equal batches."""

import json
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.operators import headings as H
from quirefold.operators import learning as N
from quirefold.operators import lines as L
from quirefold.operators import metadata as M
from quirefold.operators import pages as P
from quirefold.operators import sites as S
from quirefold.operators.tables import line_similarity, neighbours
from quirefold.operators.textmodel import classify_texts
from quirefold.plans import adapters as A
from quirefold.sources import office, readers, sinks
from quirefold.streaming import ingest


def sequential(boxes):
    """Line reconstruction as a plain loop over one page's boxes."""
    out, cur = [], None
    for o, left, top, width, text in boxes:
        if cur and abs(top - cur["fy"]) <= 0.0075 + 1e-15 and cur["fy"] - 0.0075 <= top <= cur["fy"] + 0.0075:
            if left < cur["pl"]:
                cur["t"].insert(0, text)
            else:
                cur["t"].append(text)
                cur["pl"], cur["pw"] = left, width
        elif cur and left > cur["pl"] + cur["pw"] and abs(cur["fy"] - top) / (left - (cur["pl"] + cur["pw"])) < 0.014:
            cur["t"].append(text)
            cur["pl"], cur["pw"] = left, width
        else:
            cur = {"fy": top, "pl": left, "pw": width, "t": [text]}
            out.append(cur)
    return [" \t".join(c["t"]) for c in out]


def test_reconstruction_equals_a_loop_for_any_partitions(spark, data):
    boxes = A.boxes(spark, data).withColumn("text", F.concat("text", F.col("ord").cast("string")))
    expected = {}
    for r in boxes.orderBy("doc_id", "page_num", "ord").collect():
        expected.setdefault((r.doc_id, r.page_num), []).append((r.ord, r.left, r.top, r.width, r.text))
    for n in (1, 8):
        got = {}
        for r in L.merge_lines(L.assign_lines(boxes.repartition(n))).orderBy("doc_id", "page_num", "line_num").collect():
            got.setdefault((r.doc_id, r.page_num), []).append(r.text)
        assert got == {k: sequential(v) for k, v in expected.items()}


def test_cell_walk(spark):
    rows = [("t", 1, 1, "hole name"), ("t", 1, 2, None), ("t", 1, 3, "BH 7"), ("t", 2, 1, "X9"), ("t", 3, 1, "end")]
    cells = spark.createDataFrame(rows, "table_id string, row long, col long, value string").withColumn("header", F.lit("h"))
    from quirefold.functions import text as X

    r = neighbours(cells, X.site_name_class(F.col("value")), F.col("value") == "hole name").first()
    assert (r.right_value, r.down_value) == ("BH 7", "X9")
    roles = S.header_roles(S.match_headers(cells.select(F.col("value").alias("header")), S.vocabulary(spark)))
    assert [(x.site_name, x.site_name_source) for x in S.extract_keys(cells, roles).collect()] == [("BH 7", "hole name")]
    apart = spark.createDataFrame([("t", 1, 1, "hole name"), ("t", 1, 2, "Mary"), ("t", 1, 3, "12")], "table_id string, row long, col long, value string").withColumn("header", F.lit("h"))
    assert [x.site_name for x in S.extract_keys(apart, roles).collect()] == ["Mary 12"]


def test_carry_and_spine(spark):
    pages = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 1, 0), (1, 3, 0, 1), (1, 4, 0, 0)], "doc_id long, page_num long, f0 int, f1 int")
    assert [r.is_toc for r in P.carry(pages).orderBy("page_num").collect()] == [0, 1, 1, 0]
    lines = spark.createDataFrame([(1, 1), (1, 3)], "doc_id long, page_num long")
    assert [(r.page_num, r.n_lines) for r in P.page_spine(lines).orderBy("page_num").collect()] == [(1, 1), (2, 0), (3, 1)]


def test_filters(spark):
    reports = spark.createDataFrame([(1, None, "A B"), (2, "C", "A"), (3, "O", "A"), (4, "O", "B")], "repno long, rstatus string, rtype string")
    assert {r.repno for r in M.open_reports(reports).collect()} == {3, 4}
    assert {r.repno for r in M.filter_reports(reports, include=["A", "B"]).collect()} == {1, 2, 3, 4}
    assert {r.repno for r in M.filter_reports(reports, include=["A", "B"], legacy=True).collect()} == {1}
    assert {r.repno for r in M.filter_reports(reports, exclude=["B"]).collect()} == {2, 3}


def test_sources_and_sinks(spark, tmp_path):
    def block(i, kind, text=None, kids=()):
        return {"Id": i, "BlockType": kind, "Page": 1, "Text": text, "Geometry": {"BoundingBox": {"Width": 0.1, "Height": 0.1, "Left": 0.1, "Top": 0.1}}, "Relationships": [{"Type": "CHILD", "Ids": list(kids)}] if kids else None}

    response = [{"JobStatus": "SUCCEEDED", "Blocks": [block("p", "PAGE", kids=["a", "b"]), block("a", "LINE", "one")]}, {"Blocks": [block("b", "LINE", "two")]}]
    (tmp_path / "cr_12_3_fulljson.json").write_text(json.dumps(response))
    blocks = readers.ocr_blocks(spark, str(tmp_path / "cr_12_3_fulljson.json"))
    assert {(r.doc_id, r.file_num, r.Text) for r in blocks.filter("BlockType = 'LINE'").collect()} == {(12, 3, "one"), (12, 3, "two")}
    assert {(r.src, r.ord, r.dst) for r in readers.block_edges(blocks).collect()} == {("p", 0, "a"), ("p", 1, "b")}
    lines = {"1": [{"LineNum": 1, "Text": "x"}], "2": [{"LineNum": 1, "Text": "y"}]}
    (tmp_path / "cr_5_1_lines.json").write_text(json.dumps(lines))
    assert {(r.doc_id, r.page_num, r.Text) for r in readers.reconstructed_lines(spark, str(tmp_path / "cr_5_1_lines.json")).collect()} == {(5, 1, "x"), (5, 2, "y")}
    text = "Table: Table_1\n\nA`B`\n1`2`\n``\n\n\n\nTable: Table_2\n\nonly`\n\n\n\nTable: Table_3\n\nC`\n9`\n\n\n\nlast`\n1`\n"
    (tmp_path / "cr_1_1_tables.txt").write_text(text)
    cells = readers.table_cells(spark, str(tmp_path / "cr_1_1_tables.txt")).orderBy("table_num", "row", "col").collect()
    assert [(c.table_num, c.row, c.col, c.header, c.value) for c in cells] == [(1, 1, 1, "A", "1"), (1, 1, 2, "B", "2"), (2, 1, 1, "C", "9")]
    listed = readers.listing(spark, str(tmp_path), kinds=("json",)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.file_num, r.extension) for r in listed] == [(5, 1, "json"), (12, 3, "json")]
    frame = spark.createDataFrame([(1, 'say "x"\nnow')], "a long, b string")
    sinks.write_dataset(frame, str(tmp_path / "ds"), "csv")
    sinks.append_rows(frame.filter("false"), str(tmp_path / "more"))
    assert readers.dataset(spark, str(tmp_path / "ds"), "a long, b string").count() >= 1
    inputs, done = frame.select("a"), frame.select("a").filter("a > 1")
    assert sinks.unprocessed(inputs, done, ["a"]).count() == 1
    texts = sinks.page_text(blocks.withColumn("ord", F.monotonically_increasing_id()))
    assert texts.first().content.splitlines()[-1] in ("one", "two")


def test_office_sources(spark, tmp_path):
    import zipfile

    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "reports.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>REPNO</t></si><si><t>RTITLE</t></si><si><t>Well A</t></si></sst>")
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>17</v></c><c r="B2" t="s"><v>2</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "cr_1_2.docx", "w") as z:
        table = f"<w:tbl><w:tr><w:tc>{para('Hole')}</w:tc><w:tc>{para('East')}</w:tc></w:tr><w:tr><w:tc>{para('B1')}</w:tc><w:tc>{para('9')}</w:tc></w:tr></w:tbl>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{para('Intro')}{table}</w:body></w:document>")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "a.pdf").write_bytes(b"%PDF /Type /Pages /Type /Page x /Type/Page>>")
    (tmp_path / "b.tif").write_bytes(b"II*\0" + (8).to_bytes(4, "little") + (0).to_bytes(2, "little") + (14).to_bytes(4, "little") + (0).to_bytes(2, "little") + (0).to_bytes(4, "little"))
    assert [tuple(r) for r in office.spreadsheet(spark, str(tmp_path), ["REPNO", "RTITLE"]).collect()] == [("17", "Well A")]
    parts = [(r.kind, r.table_num, r.row, r.col, r.text) for r in office.word_documents(spark, str(tmp_path)).collect()]
    assert parts == [("paragraph", None, 1, 1, "Intro"), ("cell", 1, 0, 1, "Hole"), ("cell", 1, 0, 2, "East"), ("cell", 1, 1, 1, "B1"), ("cell", 1, 1, 2, "9")]
    assert {(r.extension, r.pages, r.readable) for r in office.page_counts(spark, str(tmp_path)).collect()} >= {("pdf", 2, True), ("tif", 2, True), ("docx", 1, False)}


def test_models_predict_held_out_rows(spark):
    rows = spark.createDataFrame([(i, i % 7, (i * 5) % 11, float(i % 2), float(i % 3), float(i % 2), i % 2) for i in range(600)], "doc_id long, page_num long, num_children long, contains_toc_phrase double, contains_contents_word double, contains_list_of double, toc_page int")
    train, test = N.hold_out(rows, "doc_id")
    out = N.classify(N.fit(N.CARDS["toc"], train), test, "toc_page").join(test.select("doc_id", F.col("toc_page").alias("y")), "doc_id")
    assert out.agg(F.avg((F.col("toc_page") == F.col("y")).cast("int"))).first()[0] > 0.95
    text = spark.createDataFrame([(i, "hole bore depth" if i % 2 else "budget cost year", float(i % 2)) for i in range(80)], "id long, content string, class double")
    predicted = N.classify(N.fit(N.CARDS["tables"], text), text, "class").join(text.select("id", F.col("class").alias("y")), "id")
    assert predicted.filter("class <> y").count() == 0


def test_stream_equals_batch(spark, tmp_path, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    stream = ingest.line_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_page_features(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    lines = spark.read.parquet(str(tmp_path / "in")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "text"))
    expected = P.contents_features(lines.withColumn("page_num", F.floor(F.col("_p") / 5) + 1))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_windowed_stream(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = ingest.windowed_confidence(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    expected = events.groupBy(F.window("ts", "1 day"), "event_type").count().count()
    assert spark.sql("select * from w").count() == expected


def test_text_models_keep_every_term(spark):
    """More terms than a vectoriser's default vocabulary of 262144."""
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(70_000)), i % 2) for i in range(4)]
    rows = spark.createDataFrame(texts, "id long, content string, class int")
    model = N.fit(N.CARDS["tables"], rows)
    assert model.stages[0].table.count() == 4 * (70_000 + 69_999)


def test_classify_texts_against_plain_loops(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choice(["Ash", "birch", "cedar", "elm", "fir", "oak"][i % 2 :: 1 + i % 3]) + rnd.choice(["", "s"]) for _ in range(rnd.randint(1, 30)))) for i in range(90)] + [(90, None), (91, "unknown terms")]
    labels = {i: int(rnd.random() < 0.5 if i % 5 == 0 else i % 2) for i in range(60)}

    def terms(t):
        w = re.findall(r"\b\w\w+\b", (t or "").lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    counts = {i: terms(t) for i, t in docs}
    df = Counter(t for i in labels for t in counts[i])
    idf = {t: math.log((1 + len(labels)) / (1 + n)) + 1 for t, n in df.items() if n >= 2}

    def vector(i):
        v = {t: n * idf[t] for t, n in counts[i].items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    rest = {y: {t: 0.2 for t in idf} for y in (0, 1)}
    for i, y in labels.items():
        for t, x in vector(i).items():
            rest[1 - y][t] += x
    total = {y: sum(r.values()) for y, r in rest.items()}
    score = lambda i, y: round(sum(-x * math.log(rest[y][t] / total[y]) for t, x in vector(i).items()), 9)
    want = {i: int(score(i, 1) > score(i, 0)) for i, _ in docs}
    got = classify_texts(spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(list(labels.items()), "id long, y int"), "id", "t", min_df=2)
    assert {r.id: r.predicted for r in got.collect()} == want and set(want.values()) == {0, 1}


def test_cells_are_compared_in_rows_and_columns_with_the_header(spark):
    cells = spark.createDataFrame([("t", 1, 1, "Ab", "ab"), ("t", 1, 2, "c", "xy"), ("t", 2, 1, "Ab", None), ("t", 2, 2, "c", "c  c")], "table_id string, row long, col long, header string, value string")
    got = {(r.line, r.row, r.col, r.other_row, r.other_col): round(r.similarity, 6) for r in line_similarity(cells).collect()}
    assert len(got) == 3 * 1 + 2 * 3
    assert got["column", 0, 1, 1, 1] == 1 and got["row", 1, 1, 1, 2] == 0 and got["row", 2, 1, 2, 2] == 0
    assert got["column", 0, 2, 2, 2] == round(2 / 5**0.5, 6)


def test_pairs_of_a_least_similarity(spark):
    """The same rows as all pairs filtered, and fewer joined."""
    rnd = random.Random(12)
    words = [f"w{min(int(rnd.expovariate(0.15)), 40)}" for _ in range(4000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    lines = [(d, n, rnd.choice([text(rnd.randrange(1, 12)), text(60), "", " ", "Z z Z " + text(2)])) for d in range(4) for n in range(60)]
    heads = [(d, h, 1 + h % 2, rnd.choice([text(rnd.randrange(1, 7)), "z z", lines[rnd.randrange(240)][2] + "\t12"])) for d in range(3) for h in range(25)]
    a = spark.createDataFrame(lines, "doc_id int, line_num int, text string")
    b = spark.createDataFrame(heads, "doc_id int, heading_id int, level int, heading string")
    key = lambda df: sorted((r.doc_id, r.line_num, r.heading_id, r.level, round(r.similarity, 9)) for r in df.collect())
    for least in (0.05, 0.3, 1 / 3, 0.5, 0.8, 1.0):
        every = H.similarities(a, b).filter(F.col("similarity") >= least)
        found = H.similar_at_least(a, b, least)
        assert key(found) == key(every) and found.count() == every.count()
    assert H.similar_at_least(a, b, 0.5).count() > 5
    assert H.similar_at_least(a.limit(0), b, 0.5).count() == H.similar_at_least(a, b.limit(0), 0.5).count() == 0
