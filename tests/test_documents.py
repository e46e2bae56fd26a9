"""The block graph, composed report steps, the learning loop, and the sources and sinks around them."""

import json
import time
import random
import statistics
import zlib

import pytest
from pyspark.sql import functions as F

from quirefold.operators import blocks as B
from quirefold.operators import learning as N
from quirefold.operators import lines as L
from quirefold.operators import metadata as M
from quirefold.operators import pages as P
from quirefold.operators import report as RP
from quirefold.operators import sites as S
from quirefold.operators import tables as T
from quirefold.sources import office, readers, shared, sinks


def block(i, kind, rels=(), **more):
    box = {"Width": more.pop("width", 0.2), "Height": 0.01, "Left": more.pop("left", 0.1), "Top": more.pop("top", 0.1)}
    return {"Id": i, "BlockType": kind, "Page": more.pop("page", 1), "Confidence": 90.0, "Geometry": {"BoundingBox": box}, "Relationships": [{"Type": t, "Ids": list(ids)} for t, ids in rels] or None, **more}


RESPONSE = [
    {
        "JobStatus": "SUCCEEDED",
        "Blocks": [
            block("p1", "PAGE", [("CHILD", ["l1", "l2", "l3", "t1"])]),
            block("l1", "LINE", Text="Total", left=0.1, top=0.1),
            block("l2", "LINE", Text="12", left=0.6, top=0.101),
            block("l3", "LINE", Text="~", left=0.01, width=0.01, top=0.5),
            block("l9", "LINE", Text="of no page", top=0.9),
            block("t1", "TABLE", [("CHILD", ["c21", "c22", "c11", "gone", "c12", "c12b"])]),
            block("c11", "CELL", [("CHILD", ["w1", "w2"])], RowIndex=1, ColumnIndex=1),
            block("c12", "CELL", RowIndex=1, ColumnIndex=2),
            block("c12b", "CELL", [("CHILD", ["s1", "s2", "w3"])], RowIndex=1, ColumnIndex=2),
            block("c21", "CELL", [("CHILD", ["w3"])], RowIndex=2, ColumnIndex=1),
            block("c22", "CELL", [("CHILD", ["w1"])], RowIndex=2, ColumnIndex=2),
        ],
    },
    {
        "Blocks": [
            *(block(i, "WORD", Text=t) for i, t in (("w1", "hole"), ("w2", "id"), ("w3", "B7"))),
            block("s1", "SELECTION_ELEMENT", SelectionStatus="SELECTED"),
            block("s2", "SELECTION_ELEMENT", SelectionStatus="NOT_SELECTED"),
            block("k1", "KEY_VALUE_SET", [("VALUE", ["v1", "v2"]), ("CHILD", ["w1"])], EntityTypes=["KEY"]),
            block("k2", "KEY_VALUE_SET", [("CHILD", ["w2"])], EntityTypes=["KEY"]),
            block("v1", "KEY_VALUE_SET", [("CHILD", ["w1"])], EntityTypes=["VALUE"]),
            block("v2", "KEY_VALUE_SET", [("CHILD", ["w3", "s1"])], EntityTypes=["VALUE"]),
        ]
    },
]


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ocr")
    (folder / "cr_7_1_full.json").write_text(json.dumps(RESPONSE))
    (folder / "cr_8_1_full.json").write_text(json.dumps([{"Blocks": [block("p1", "PAGE")]}]))
    return B.from_response(readers.ocr_blocks(spark, str(folder)))


def test_block_graph(blocks):
    cells = {(r.doc_id, r.table_num, r.row, r.col): r.text for r in B.table_cells(blocks).collect()}
    assert cells == {(7, 1, 1, 1): "hole id ", (7, 1, 1, 2): "X B7 ", (7, 1, 2, 1): "B7 ", (7, 1, 2, 2): "hole "}
    assert {(r.key, r.value) for r in B.key_values(blocks).collect()} == {("hole ", "B7 X "), ("id ", "")}
    files = {r.doc_id: r.content for r in B.table_files(blocks).collect()}
    assert files == {7: "Table: Table_1\n\nB7 `hole `\nhole id `X B7 `\n\n\n\n\n\n", 8: T.NO_TABLE}
    assert [(r.doc_id, r.page_num, r.id) for r in B.page_blocks(blocks).orderBy("doc_id").collect()] == [(7, 1, "p1"), (8, 1, "p1")]
    assert [(r.id, r.line_num) for r in B.page_lines(blocks).orderBy("line_num").collect()] == [("l1", 1), ("l2", 2), ("l3", 3)]
    assert sinks.pair_text(B.key_values(blocks)).first().content == "hole ,B7 X \nid ,\n"


def test_clean_lines_of_a_response(blocks):
    r = RP.clean_lines(blocks).collect()
    assert [(x.doc_id, x.page_num, x.line_num, x.text, x.n_boxes) for x in r] == [(7, 1, 1, "Total \t12", 2)]


def test_result_pages_and_files_of_a_report(spark, tmp_path):
    """Order within a file goes over its result pages; files of a report do not meet, though their ids repeat."""
    word = lambda i, t: block(i, "WORD", Text=t)

    def pages(names, top):
        first = [
            block("p1", "PAGE", [("CHILD", ["l1", "l2", "l3", "l4"])]), block("l1", "LINE", Text=names[0], top=top), block("l2", "LINE", Text=names[1], top=top + 0.1),
            block("t1", "TABLE", [("CHILD", ["c1"])]), block("c1", "CELL", [("CHILD", ["w1"])], RowIndex=1, ColumnIndex=1), word("w1", names[0]),
            block("k1", "KEY_VALUE_SET", [("VALUE", ["v1"]), ("CHILD", ["w9"])], EntityTypes=["KEY"]), block("v1", "KEY_VALUE_SET", [("CHILD", ["w1"])], EntityTypes=["VALUE"]),
        ]
        second = [
            block("t2", "TABLE", [("CHILD", ["c2"])]), block("c2", "CELL", [("CHILD", ["w2"])], RowIndex=1, ColumnIndex=1), word("w2", names[2]), word("w9", "hole"),
            block("l3", "LINE", Text=names[2], top=top + 0.2), block("l4", "LINE", Text=names[3], top=top + 0.3),
            block("k2", "KEY_VALUE_SET", [("VALUE", ["v2"]), ("CHILD", ["w9"])], EntityTypes=["KEY"]), block("v2", "KEY_VALUE_SET", [("CHILD", ["w2"])], EntityTypes=["VALUE"]),
        ]
        return [{"Blocks": first}, {"NextToken": None}, {"Blocks": second}]

    names = {1: ["first", "second", "third", "fourth"], 2: ["one", "two", "three", "four"]}
    for n, x in names.items():
        (tmp_path / f"cr_7_{n}_full.json").write_text(json.dumps(pages(x, 0.1 * n), indent=1))
    (tmp_path / "cr_9_1_full.json").write_text(json.dumps({"JobStatus": "SUCCEEDED", "Blocks": [block("p1", "PAGE", [("CHILD", ["l1"])]), block("l1", "LINE", Text="alone")]}))
    (tmp_path / "cr_9_2_full.json").write_text("no json")
    blocks = B.from_response(readers.ocr_blocks(spark, str(tmp_path))).cache()
    for n, x in names.items():
        flat = [b["Id"] for page in pages(x, 0) for b in page.get("Blocks", [])]
        assert [r.id for r in blocks.filter(F.col("file_num") == n).filter("doc_id = 7").orderBy("ord").collect()] == flat
    lines = {}
    for r in RP.clean_lines(blocks).orderBy("doc_id", "file_num", "page_num", "line_num").collect():
        lines.setdefault((r.doc_id, r.file_num), []).append(r.text)
    assert lines == {(7, 1): names[1], (7, 2): names[2], (9, 1): ["alone"]}
    cells = sorted((r.file_num, r.table_num, r.text) for r in B.table_cells(blocks).collect())
    assert cells == [(1, 1, "first "), (1, 2, "third "), (2, 1, "one "), (2, 2, "three ")]
    assert sorted((r.file_num, r.key, r.value) for r in B.key_values(blocks).collect()) == [(1, "hole ", "third "), (2, "hole ", "three ")]
    assert sorted((r.file_num, r.content) for r in sinks.pair_text(B.key_values(blocks)).collect()) == [(1, "hole ,third \n"), (2, "hole ,three \n")]
    text = {(r.doc_id, r.file_num): r.content for r in sinks.page_text(readers.ocr_blocks(spark, str(tmp_path))).collect()}
    assert text[7, 2] == "\none\ntwo\nthree\nfour"
    numbered = {(r.file_num, r.id): r.line_num for r in L.child_lines(blocks.filter("doc_id = 7"), B.edges(blocks).withColumn("ord", F.lit(0))).collect()}
    assert numbered == {(n, f"l{k}"): k for n in (1, 2) for k in (1, 2, 3, 4)}


def test_a_page_of_very_many_boxes(spark):
    """Lines are folded in one pass: 100,000 boxes of one page, three a line, each starting left of the one before."""
    n = 100_000
    k = F.col("id")
    boxes = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(2).alias("file_num"), F.lit(1).alias("page_num"), k.alias("ord"), (0.7 - k % 3 * 0.3).alias("left"), F.floor(k / 3).alias("top"), F.lit(0.1).alias("width"), F.lit("extra").alias("n"))
    began = time.time()
    found = L.assign_lines(boxes)
    assert found.columns == [*boxes.columns, "line_num", "pos"]
    wrong = found.filter((F.col("line_num") != F.floor(F.col("ord") / 3) + 1) | (F.col("pos") != -(F.col("ord") % 3)))
    assert wrong.count() == 0 and found.count() == n
    assert time.time() - began < 60
    odd = spark.createDataFrame([(1, 1, 1, 0.1, None, 0.1), (1, 1, 2, 0.5, 0.1, 0.1), (1, 1, 3, None, 0.1, 0.1), (1, None, 1, 0.1, 0.1, 0.1)], "doc_id int, page_num int, ord int, left double, top double, width double")
    assert sorted((str(r.page_num), r.ord, r.line_num, r.pos) for r in L.assign_lines(odd).collect()) == [("1", 1, 1, 0), ("1", 2, 2, 0), ("1", 3, 2, 1), ("None", 1, 1, 0)]
    assert L.assign_lines(odd.limit(0)).count() == 0


def test_repeated_metadata_keys(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(json.dumps([{"key": "a", "value": "1"}, {"key": "b", "label": "x"}, {"key": "a", "value": "2"}, {"value": "no key"}]))
    assert readers.report_metadata(spark, str(tmp_path)).first().fields == {"a": "2", "b": None}


def test_sites_of_files(spark):
    by_key = "Table: Table_1\n\nReport`of`1999`\nHole name`Mary`12`\nEasting`` 5000 `\nNorthing`6000`x`\nLatitude`20 deg S`x`\n\n\n\n"
    by_column = "Table: Table_2\n\nHole No`East`North`RL`\nA1`10`20`3`\nnone`11`21`3`\nA2`12``3`\n\n\n\n"
    files = spark.createDataFrame([("f1", by_key + by_column), ("f2", ""), ("f3", None)], "file_id string, content string")
    found = sorted(map(str, ((r.file_id, r.table_num, r.site_name, r.grid_loc_1, r.grid_loc_2, r.geo_loc_1, r.site_name_source, r.grid_loc_2_source) for r in S.extract_from_files(files, S.vocabulary(spark)).collect())))
    assert found == sorted(map(str, [("f1", 1, "Mary 12", "5000", "6000", None, "Hole name", "Northing"), ("f1", 2, "A1", "10", "20", None, "Hole No", "North"), ("f1", 2, "A2", "12", None, None, "Hole No", "North")]))


def test_header_similarity_is_the_multisets(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("holeidnam ") for _ in range(rnd.randint(1, 12))) for _ in range(200)]
    vocab = spark.createDataFrame([("a", t) for t in names[:60] if t.strip()], "kind string, term string").select("kind", F.trim("term").alias("term")).distinct()
    terms = [r.term for r in vocab.collect()]

    def similarity(x, y):
        both = sum(min(x.count(c), y.count(c)) for c in set(x))
        return both / (len(x) + len(y) - both)

    got = {r.header: r.similarity for r in S.match_headers(spark.createDataFrame([(n,) for n in names], "header string"), vocab).collect()}
    expected = {n: max(similarity(n.strip(" "), t) for t in terms) for n in set(names) if n.strip(" ")}
    assert got == {n: pytest.approx(s) for n, s in expected.items() if s >= 0.8}


def test_carry_equals_a_loop(spark):
    rnd = random.Random(1)
    rows = [(d, p, rnd.randint(0, 1), rnd.randint(0, 1)) for d in range(30) for p in range(1, rnd.randint(2, 25))]
    expected, state = {}, {}
    for d, p, f0, f1 in rows:
        state[d] = expected[d, p] = f1 if state.get(d) else f0
    got = P.carry(spark.createDataFrame(rows, "doc_id long, page_num long, f0 int, f1 int").repartition(5))
    assert {(r.doc_id, r.page_num): r.is_toc for r in got.collect()} == expected


def toc_rows(spark, n=400):
    rnd, rows = random.Random(2), []
    for d in range(n // 10):
        before = 0
        for p in range(1, 11):
            word = int(rnd.random() < 0.15)
            label = int(word or (before and rnd.random() < 0.9))
            rows.append((d, p, 5 + 20 * label, 0, word, 0, before, label))
            before = label
    return spark.createDataFrame(rows, "doc_id long, page_num long, num_children long, contains_toc_phrase int, contains_contents_word int, contains_list_of int, prev_toc int, toc_page int")


def test_carried_pages_equal_a_loop_over_the_model(spark):
    rows = toc_rows(spark)
    card = N.CARDS["toc_carried"]
    model = N.fit(card, rows)
    got = {(r.doc_id, r.page_num): r.is_toc for r in N.carried_pages(model, rows, card.label).collect()}
    sides = {}
    for flag in (0, 1):
        for r in model.transform(rows.withColumn("prev_toc", F.lit(flag))).collect():
            sides[r.doc_id, r.page_num, flag] = int(r.prediction)
    for d, p in got:
        assert got[d, p] == sides[d, p, got.get((d, p - 1), 0)]
    truth = {(r.doc_id, r.page_num): r.toc_page for r in rows.collect()}
    assert sum(got[k] == truth[k] for k in truth) > 0.9 * len(truth)


def test_learning_round(spark):
    card = N.CARDS["toc"]
    rows = toc_rows(spark).withColumn("_key", F.col("doc_id") * 100 + F.col("page_num")).withColumn("truth", F.col("toc_page"))
    part = rows.withColumn("toc_page", F.when(F.col("doc_id") % 4 == 0, F.col("toc_page"))).withColumn("tag_method", F.when(F.col("doc_id") % 4 == 0, "legacy"))
    first = N.round_of_learning(card, part, "_key", 15)
    asked = first["queue"].select("_key").collect()
    assert len(asked) == 15 and part.filter(F.col("_key").isin([r[0] for r in asked]) & F.col("toc_page").isNotNull()).count() == 0
    answers = first["queue"].select("_key").join(rows.select("_key", F.col("truth").alias("answer")), "_key")
    second = N.round_of_learning(card, part, "_key", 15, answers)
    assert second["rows"].filter("tag_method = 'manual'").count() == 15
    assert sum(r.n for r in second["confusion"].collect()) == part.filter("toc_page is not null").count() + 15
    whole = N.round_of_learning(card, rows.withColumn("tag_method", F.when(F.col("doc_id") < 5, "manual").otherwise("auto")), "_key", 0)
    assert whole["queue"] is None and sum(r.n for r in whole["confusion"].collect()) == 50
    all_auto = rows.withColumn("tag_method", F.when(F.col("doc_id") < 30, "manual").otherwise("auto"))
    reset, n = N.training_plan(all_auto, "toc_page", 7)
    assert n == 7 and reset.filter("toc_page is null").count() == 100
    few, n = N.training_plan(part.filter("doc_id in (0, 1)"), "toc_page", 70)
    assert n == 10 and few.count() == 20
    assert set(N.features_only(part, "truth", "no such").columns) == {"page_num", "num_children", "contains_toc_phrase", "contains_contents_word", "contains_list_of", "prev_toc", "toc_page", "_key"}


def test_intext_headings_fall_back(spark):
    schema = "doc_id long, line_num long, heading int, matches_heading double"
    with_toc = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 1, 0.0), (1, 3, 0, 0.9), (2, 1, 1, 0.5)], schema)
    without = spark.createDataFrame([(1, 5, 1), (2, 4, 2), (2, 6, 0)], "doc_id long, line_num long, heading int")
    toc = spark.createDataFrame([(1, 3)], "doc_id long, page_num long")
    assert {(r.doc_id, r.line_num) for r in RP.intext_headings(with_toc, without, toc).collect()} == {(1, 1), (2, 4)}
    predicted = spark.createDataFrame([(1, 4, "1 A", 1), (1, 5, "1.1 B", 2), (1, 6, "x", 0)], "doc_id long, line_num long, text string, heading int")
    assert {(r.heading_id, r.level, r.heading) for r in RP.contents(predicted).collect()} == {(4, 1, "1 A"), (5, 2, "1.1 B")}


def test_codes_are_ranks_over_all_partitions(spark):
    rows = spark.createDataFrame([(f"l{(i * 7919) % 503}", i) for i in range(2000)] + [(None, 0)], "label string, place long").repartition(7)
    first = {}
    for i in range(2000):
        first.setdefault(f"l{(i * 7919) % 503}", len(first))
    assert {r.label: r.code for r in N.first_seen_codes(rows, "label", "place").collect()} == first


def test_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'say "{i}"' if i % 3 else None, "a,b") for i in range(50)], "k long, t string, u string")
    parts = sinks.single_csv(rows.repartition(4), ["k"]).orderBy("part").collect()
    path = tmp_path / "one.csv"
    path.write_text("".join(p.content for p in parts))
    again = readers.dataset(spark, str(path), "k long, t string, u string").orderBy("k").collect()
    assert [(r.k, r.t, r.u) for r in again] == [(i, f'say "{i}"' if i % 3 else None, "a,b") for i in range(50)]
    lines = spark.createDataFrame([(d, 1 + d % 2, 1, f"x{d}") for d in range(300)], "doc_id long, page_num long, line_num long, text string")
    sinks.write_lines(lines, str(tmp_path / "lines"), buckets=8)
    assert len(list((tmp_path / "lines").glob("bucket=*"))) == 8 and spark.read.json(str(tmp_path / "lines")).count() == 300
    content = {r.doc_id: json.loads(r.content) for r in sinks.line_maps(lines).collect()}
    assert content[3] == {"2": [{"line_num": 1, "text": "x3"}]}
    cells = spark.createDataFrame([("f", 2, 1, 1, "H", 'a "q"'), ("f", 5, 1, 1, "I", None)], "file_id string, table_num long, row long, col long, header string, value string")
    files = spark.createDataFrame([("f",), ("g",)], "file_id string")
    assert {r.file_id: r.content for r in T.table_files(cells, files).collect()} == {"f": 'Table: Table 1\nH\n"a ""q"""\n""\nTable: Table 2\nI\n\n""\n', "g": "[NO TABLES]\n"}


def test_key_sources(spark, tmp_path):
    keys = spark.createDataFrame([("a/cr_1.pdf",), ("a/cr_1.txt",), ("a/cr_12.pdf",), ("b",), ("a/cr_1.x.y",)], "key string")
    wanted = spark.createDataFrame([("a/cr_1",), ("a/cr_1.x",), ("a/cr",)], "prefix string")
    assert {r.prefix: r.key for r in readers.first_with_prefix(keys, wanted).collect()} == {"a/cr_1": "a/cr_1.pdf", "a/cr_1.x": "a/cr_1.x.y"}
    names = spark.createDataFrame([("w/cr_12_3.docx",), ("w/cr_x1_3.docx",), ("cr_5.docx",), ("cr_5_a.docx",), ("other",)], "key string")
    assert {(r.doc_id, r.file_num) for r in readers.numbered_names(names).collect()} == {("12", "3"), ("5", "1")}
    assert spark.createDataFrame([(3, 4)], "doc_id long, file_num long").select(readers.file_path("/d/", "tables", ".txt", "training")).first()[0] == "/d/training/tables/cr_3_4.txt"
    (tmp_path / "collar.txt").write_text("HOLEID,EAST,Northing,RL,NOTE\nBH1, 100.5,200,x,a\nBH2,,201,3,\n")
    r = readers.drilling(spark, str(tmp_path / "collar.txt"), "collar").orderBy("site").collect()
    assert [(x.site, x.east, x.north, x.level, x.NOTE) for x in r] == [("BH1", 100.5, 200.0, None, "a"), ("BH2", None, 201.0, 3.0, None)]
    (tmp_path / "assay.txt").write_text("HOLEID\tSAMPFROM\tSAMPTO\tAU\nBH1\t0\t1.5\t0.2\n")
    assert readers.drilling(spark, str(tmp_path / "assay.txt"), "assay", sep="\t").first().asDict() == {"site": "BH1", "from": 0.0, "to": 1.5, "sample": None, "AU": "0.2"}
    reports = spark.createDataFrame([(1, "O", "A", "Coal report"), (2, "O", "A", "Journal")], "repno long, rstatus string, rtype string, rtitle string")
    assert [x.repno for x in M.filter_reports(reports, exclude_titles=["Journal"]).collect()] == [1]


def test_shared_tables_are_released(spark):
    path = shared.fresh_path(spark, "x")
    assert path.startswith(shared.own_folder(spark))
    df = shared.materialize(spark.range(5), "five")
    assert df.count() == 5


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        applicationId, master = "a", "spark://host:7077"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_pages_of_compressed_pdfs():
    plain = b"%PDF-1.4 1 0 obj <</Type /Pages /Count 2>> <</Type /Page>> <</Type/Page /x 1>>"
    packed = zlib.compress(b"5 0 6 20 <</Type/Page/Parent 1 0 R>> <</Type /Page>> <</Type/Pages>>")
    streams = b"7 0 obj <</Type /ObjStm /N 3 /First 8 /DecodeParms <</X 1>> /Filter /FlateDecode>> stream\r\n" + packed + b"\nendstream"
    assert office.page_count("a.pdf", plain) == 2 and office.page_count("a.pdf", plain + streams) == 4
    assert office.page_count("a.pdf", streams.replace(packed, b"damaged")) is None and office.page_count("a.pdf", b"") is None


def test_quantiles_and_modes(spark):
    rnd = random.Random(4)
    rows = [(k, float(rnd.choice([rnd.randint(0, 5), rnd.random() * 100]))) for k in "abc" for _ in range(501 if k == "a" else 200)] + [("d", 1.5), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: (r.lo, r.mid, r.hi) for r in M.exact_quantiles(df, "k", "v", {"lo": 0.0, "mid": 0.5, "hi": 0.9}).collect()}
    for k, own in got.items():
        values = sorted(v for key, v in rows if key == k and v is not None)
        place = 0.9 * (len(values) - 1)
        hi = values[int(place)] + (place - int(place)) * (values[min(int(place) + 1, len(values) - 1)] - values[int(place)])
        assert own == pytest.approx((values[0], statistics.median(values), hi))
    assert set(got) == {"a", "b", "c", "d"}
    assert {r.k: r.mode for r in M.modes(df, "k", "v").collect()} == {k: min(statistics.multimode(sorted(v for key, v in rows if key == k))) for k in "abcd"}


def test_text_models_learn_their_labels(spark, data):
    from quirefold.plans import adapters as A
    from quirefold.plans import learning

    topics = {r.repno: r.rtype for r in A.reports(spark, data).collect()}
    got = {r.repno: r.heading_class for r in learning.heading_topic_model(spark, data).collect()}
    assert sum(got[k] == int(v[0]) - 1 for k, v in topics.items()) > 0.98 * len(topics)


def test_sections_leave_marginals_out(spark):
    from quirefold.operators import headings as H

    lines = spark.createDataFrame([(1, n, f"l{n}") for n in range(1, 8)], "doc_id long, line_num long, text string")
    matched = spark.createDataFrame([(1, 2, 10, 1.0, 1), (1, 5, 11, 1.0, 2)], "doc_id long, line_num long, heading_id long, similarity double, level long")
    marginals = spark.createDataFrame([(1, 4), (1, 7)], "doc_id long, line_num long")
    assigned = H.section_lines(lines, matched, marginals)
    assert sorted((r.line_num, r.heading_id) for r in assigned.collect()) == [(3, 10), (6, 11)]
    sections = H.section_texts(assigned).withColumn("heading", F.concat(F.lit("h"), "heading_id")).withColumn("ord", F.col("heading_id"))
    assert sinks.section_text(sections).first().content == "h10\nl3\n\nh11\nl6"


def test_frames_of_all_line_models(spark):
    dataset = spark.createDataFrame([(1, 1, 1, "1.1 Geology \t4", 0.1, 0.2), (1, 2, 2, "1.1 Geology", 0.1, 0.2), (1, 2, 3, "page 12", 0.1, 0.9), (2, 1, 1, "free text", 0.1, 0.2)], "doc_id long, page_num long, line_num long, text string, left double, top double")
    toc = spark.createDataFrame([(1, 1)], "doc_id long, page_num long")
    headings = spark.createDataFrame([(1, 1, 2, "1.1 Geology \t4")], "doc_id long, heading_id long, level long, heading string")
    frames = RP.training_frames(dataset, toc, headings)
    assert {(r.line_num, r.contains_num, r.contains_tab, r.contains_page) for r in frames["marginal_lines"].filter("doc_id = 1").collect()} == {(1, 1, 1, 0), (2, 0, 0, 0), (3, 1, 0, 1)}
    assert [(r.section_prefix, r.section_text, r.section_page) for r in frames["heading_id_toc"].collect()] == [("1.1", " Geology ", "\t4")]
    assert {(r.doc_id, r.line_num, r.contains_num, r.matches_heading, r.matches_type, r.matches_id) for r in frames["heading_id_intext"].collect()} == {(1, 2, 1, 1.0, 2, 1), (1, 3, 0, 0.0, 0, 0), (2, 1, 0, 0.0, 0, 0)}
    r = RP.page_id_rows(dataset.filter("line_num = 3")).first()
    assert (r.shapes, r.transformed, r.page_text) == ("page smallNum ", "page 12 ", "12")


def test_metadata_sources(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(json.dumps([{"key": "RTITLE", "label": "Title", "value": "Coal"}, {"key": "EMPTY", "label": "x"}]))
    (tmp_path / "components.json").write_text(json.dumps([{"compID": "1", "type": "BODY", "sizeKB": "12", "docType": "pdf"}, {"compID": "2", "sizeKB": "n/a"}]))
    assert readers.report_metadata(spark, str(tmp_path / "metadata.json")).first().fields == {"RTITLE": "Coal", "EMPTY": None}
    assert [(r.compID, r.size_kb) for r in readers.components(spark, str(tmp_path / "components.json")).orderBy("compID").collect()] == [("1", 12), ("2", None)]
    keys = spark.createDataFrame([("x/cr_7_12.pdf",), ("x/cr_7_3.tar.gz",)], "key string")
    assert [r.report_num for r in readers.report_numbers(keys).orderBy("key").collect()][0] == "12"


def test_settle_keeps_only_the_result(spark):
    from pathlib import Path

    def inner():
        shared.materialize(spark.range(3), "a")
        return shared.settle(spark, "b", lambda: shared.materialize(spark.range(4), "c").filter("id > 0"))

    before = set(Path(shared.own_folder(spark).removeprefix("file://")).glob("*/*")) if Path(shared.own_folder(spark).removeprefix("file://")).exists() else set()
    out = shared.settle(spark, "d", lambda: inner().filter("id > 1"))
    assert sorted(r.id for r in out.collect()) == [2, 3]
    assert [p.name for p in set(Path(shared.own_folder(spark).removeprefix("file://")).glob("*/*")) - before] == ["d"]
    with pytest.raises(ZeroDivisionError):
        shared.settle(spark, "e", lambda: 1 // 0)
    assert not shared._scopes
