"""Data sets and files that the library writes: appended CSV, Word files, PDF marks."""

import csv
import io
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quirefold.operators import tables as T
from quirefold.sources import appended, office, pdf_marks, readers, word


def content(path):
    return "".join(open(f, newline="").read() for f in appended.files(path))


def test_two_appends_and_a_failed_one(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = [(i, f'a "{i}", b\nc' if i % 3 else None, "é") for i in range(50)]
    frame = spark.createDataFrame(rows, "id int, text string, more string")
    appended.append(frame.filter("id < 30").repartition(4), path)
    broken = frame.filter("id >= 30").repartition(3).withColumn("more", F.expr("if(id = 41, raise_error('no'), more)"))
    with pytest.raises(Exception, match="no"):
        appended.append(broken, path)
    appended.append(frame.filter("id >= 30").repartition(3), path)
    appended.append(frame.limit(0), path)
    table = list(csv.reader(io.StringIO(content(path))))
    assert table[0] == ["id", "text", "more"] and sum(r == table[0] for r in table) == 1
    assert sorted(table[1:], key=lambda r: int(r[0])) == [[str(i), t or "", m] for i, t, m in rows]
    got = appended.read(spark, path, "id int, text string, more string").collect()
    assert len(got) == 50 and {r.id: r.text for r in got} == {i: t for i, t, _ in rows}
    with pytest.raises(Exception, match="other columns"):
        appended.append(frame.select("text", "id", "more"), path)
    assert len(list(csv.reader(io.StringIO(content(path))))) == 51
    appended.register(spark)
    frame.filter("id = 7").write.format("appended_csv").mode("overwrite").save(path)
    assert [r.id for r in appended.read(spark, path, "id int, text string, more string").collect()] == [7]
    assert appended.read(spark, str(tmp_path / "none"), "id int").count() == 0


def test_a_repeated_task_and_an_interrupted_commit(tmp_path, monkeypatch):
    import pyarrow as pa

    path = str(tmp_path / "set")
    batch = lambda *ids: pa.RecordBatch.from_pydict({"id": list(ids)})
    w = appended.Writer(path, ["id"], False)
    w.write(iter([batch(1, 2)]))  # an attempt whose result is lost
    messages = [w.write(iter([batch(1), batch(2)])), w.write(iter([])), None]
    with monkeypatch.context() as m:
        m.setattr(appended, "recover", lambda path: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            w.commit(messages)
    assert content(path) == '"id"\n1\n2\n' or content(path) == "id\n1\n2\n"  # readers finish what the record promises
    assert json.loads((tmp_path / "set" / "_records" / "00000001.json").read_text())["number"] == 1
    assert not (tmp_path / "set" / "_staging" / w.job).exists()


def test_sections_as_word_files(spark, tmp_path):
    rows = [
        (1, 1, 0, "Intro & aims", 1, 1, "first <line>"), (1, 1, 0, "Intro & aims", 1, 2, "second\x01line"), (1, 1, 0, "Intro & aims", 1, 2, "second\x01line"),
        (1, 1, 1, "Empty", 2, None, None), (1, 1, 2, None, None, 9, None), (1, 2, 0, "Other file", 1, 1, "x"), (2, 1, 0, "Two", 1, 3, "é" * 70_000),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, file_num long, ord int, heading string, level int, line_num int, text string").repartition(3)
    out = {(r.doc_id, r.file_num): (r.path, r.n_sections, r.n_lines) for r in word.write_sections(frame, str(tmp_path / "w")).collect()}
    assert {k: v[1:] for k, v in out.items()} == {(1, 1): (3, 4), (1, 2): (1, 1), (2, 1): (1, 1)}
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == ["cr_1_1.docx", "cr_1_2.docx", "cr_2_1.docx"]
    read = readers.with_ids(office.word_documents(spark, str(tmp_path / "w")), "path")
    texts = {}
    for r in read.filter("kind = 'paragraph'").orderBy("doc_id", "file_num", "row").collect():
        texts.setdefault((r.doc_id, r.file_num), []).append(r.text)
    flat = {k: [t for t in v if t and t.strip()] for k, v in texts.items()}
    assert [t.replace("\n", "") for t in flat[1, 1]] == ["Intro & aims", "first <line>second linesecond line", "Empty"]
    assert [t.replace("\n", "") for t in flat[2, 1]] == ["Two", "é" * 70_000]
    word.write_sections(frame, str(tmp_path / "w")).collect()  # again, over the same files
    assert word.write_sections(frame.limit(0), str(tmp_path / "w")).count() == 0


def plain_pdf(n):
    """A file of n pages with a cross-reference table; the first page has an annotation, the second an array elsewhere."""
    annots = {0: b"/Annots [%d 0 R] " % (3 + n), 1: b"/Annots %d 0 R " % (4 + n)}
    objects = [b"<</Type/Catalog/Pages 2 0 R/Lang (a\\) b(c))>>", b"<</Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + k) for k in range(n)) + b"] /Count %d>>" % n]
    objects += [b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842] % note\n" + annots.get(k, b"") + b">>" for k in range(n)]
    objects += [b"<</Type/Annot/Subtype/Text/Rect[1 2.5 -3 .5]/Contents <FEFF0041>>>", b"[]"]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n" % (k + 1) + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start))


def packed_pdf(n, predictor):
    """The same with its objects in a deflated object stream and a cross-reference stream."""
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (3 + k) for k in range(n)) + b"]/Count %d>>" % n]
    objects += [b"<</Type/Page/Parent 2 0 R>>" for _ in range(n)]
    at, index = 0, []
    for k, o in enumerate(objects):
        index += [k + 1, at]
        at += len(o) + 1
    first = b" ".join(b"%d" % x for x in index) + b" "
    body = zlib.compress(first + b" ".join(objects))
    holder = len(objects) + 1
    out = bytearray(b"%PDF-1.5\n")
    place = len(out)
    out += b"%d 0 obj\n<</Type/ObjStm/N %d/First %d/Length %d/Filter/FlateDecode>>\nstream\n" % (holder, len(objects), len(first), len(body)) + body + b"\nendstream\nendobj\n"
    start = len(out)
    entries = [bytes([2]) + holder.to_bytes(3, "big") + bytes([k]) for k in range(len(objects))] + [bytes([1]) + x.to_bytes(3, "big") + b"\0" for x in (place, start)]
    entries.insert(0, bytes(5))
    if predictor:
        above, rows = bytes(5), b""
        for e in entries:
            rows += b"\x02" + bytes((x - y) & 255 for x, y in zip(e, above))
            above = e
    else:
        rows = b"".join(entries)
    data = zlib.compress(rows)
    parms = b"/DecodeParms<</Predictor 12/Columns 5>>" if predictor else b""
    out += b"%d 0 obj\n<</Type/XRef/Size %d/W[1 3 1]/Root 1 0 R/Length %d/Filter/FlateDecode%s>>\nstream\n" % (holder + 1, holder + 2, len(data), parms) + data + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def outline(file, ref):
    """The bookmarks below an outline's node as (title, page, those below)."""
    out, pages = [], file.pages()
    node = file.get(ref)
    at, before = node.get("First"), None
    while at is not None:
        item = file.get(at)
        assert item["Parent"] == ref and item.get("Prev") == before
        title = bytes.fromhex(bytes(item["Title"])[1:-1].decode()).decode("utf-16")
        out.append((title, pages.index(item["Dest"][0]) + 1, outline(file, at)))
        before, at = at, item.get("Next")
    assert node.get("Last") == before
    return out


def size_of(tree):
    return sum(1 + size_of(x[2]) for x in tree)


MARKS = [{"ord": 0, "parent": None, "title": "Title Page", "page_num": 1}, {"ord": 2, "parent": None, "title": "Größe (1)", "page_num": 2}, {"ord": 3, "parent": 2, "title": "Sub", "page_num": 3}, {"ord": 4, "parent": 2, "title": None, "page_num": 3}, {"ord": 5, "parent": None, "title": "gone", "page_num": 9}, {"ord": 6, "parent": None, "title": "End", "page_num": 3}]
LINKS = [{"page_num": p, "x0": 10.0, "y0": 700.5, "x1": 200.0, "y1": 690.0, "to_page": t} for p, t in ((1, 2), (1, 3), (2, 1), (2, 7), (8, 1))]


@pytest.mark.parametrize("data", [plain_pdf(3), packed_pdf(3, False), packed_pdf(3, True)], ids=["table", "stream", "predictor"])
def test_outline_and_links_in_a_pdf(data):
    out = pdf_marks.marked(data, [dict(m) for m in MARKS], LINKS)
    assert out.startswith(data) and len(out) > len(data)
    file = pdf_marks.File(out)
    root = file.get(file.trailer["Root"])
    tree = outline(file, root["Outlines"])
    assert tree == [("Title Page", 1, []), ("Größe (1)", 2, [("Sub", 3, []), ("", 3, [])]), ("End", 3, [])]
    assert file.get(root["Outlines"])["Count"] == size_of(tree) and root["PageMode"] == "UseOutlines"
    pages = file.pages()
    had = pdf_marks.File(data)
    for n, want in ((1, [2, 3]), (2, [1]), (3, [])):
        before = had.get(had.get(had.pages()[n - 1]).get("Annots")) or []
        annots = file.get(file.get(pages[n - 1]).get("Annots")) or []
        assert annots[: len(before)] == before
        links = [file.get(a) for a in annots[len(before) :]]
        assert [pages.index(a["Dest"][0]) + 1 for a in links] == want and all(a["Rect"] == [10, 690, 200, 700.5] for a in links)
    again = pdf_marks.marked(out, [dict(m) for m in MARKS[:1]], [])  # an update of an update
    second = pdf_marks.File(again)
    assert again.startswith(out) and outline(second, second.get(second.trailer["Root"])["Outlines"]) == [("Title Page", 1, [])]
    assert len(second.get(second.get(second.pages()[0])["Annots"])) >= 2
    assert pdf_marks.marked(data, [], LINKS[3:]) == data


def test_marks_of_many_files(spark):
    encrypted = plain_pdf(1).replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 9 0 R")
    pdfs = spark.createDataFrame([(1, bytearray(plain_pdf(3))), (2, bytearray(packed_pdf(2, True))), (3, bytearray(b"no pdf")), (4, bytearray(encrypted)), (5, None), (6, bytearray(plain_pdf(1)))], "doc_id long, content binary")
    marks = spark.createDataFrame([(d, 0, None, f"doc {d}", 1) for d in range(1, 6)], "doc_id long, ord long, parent long, title string, page_num long")
    links = spark.createDataFrame([(1, 1, 1.0, 9.0, 2.0, 8.0, 3)], "doc_id long, page_num long, x0 double, y0 double, x1 double, y1 double, to_page long")
    got = {r.doc_id: r for r in pdf_marks.add_marks(pdfs, marks, links).collect()}
    assert len(got) == 6 and {d for d, r in got.items() if r.reason} == {3, 4, 5}
    assert bytes(got[3].marked) == b"no pdf" and "encrypted" in got[4].reason and bytes(got[6].marked) == plain_pdf(1)
    for d in (1, 2):
        file = pdf_marks.File(bytes(got[d].marked))
        assert outline(file, file.get(file.trailer["Root"])["Outlines"]) == [(f"doc {d}", 1, [])]
    assert pdf_marks.add_marks(pdfs.limit(0), marks, links).count() == 0


def test_values_written_and_read_again():
    rnd = random.Random(1)

    def value(depth):
        k = rnd.randrange(9 if depth else 7)
        return [lambda: rnd.randrange(-99, 999), lambda: rnd.randrange(999) / 8, lambda: pdf_marks.Name("Ab#20-c"), lambda: pdf_marks.Text(rb"(a\)(b)\\)"), lambda: pdf_marks.Ref((rnd.randrange(1, 50), 0)), lambda: None, lambda: rnd.random() < 0.5,
                lambda: [value(depth - 1) for _ in range(rnd.randrange(4))], lambda: {pdf_marks.Name(f"K{i}"): value(depth - 1) for i in range(rnd.randrange(4))}][k]()

    for _ in range(300):
        v = value(3)
        assert pdf_marks.parse(pdf_marks.written(v))[0] == v
    for broken in (b"", b"<</A", b"[1", b"(a", b">>", b"<<1 2>>"):
        with pytest.raises(pdf_marks.Unreadable):
            pdf_marks.parse(broken)


def test_table_function_equals_the_parser(spark):
    rnd = random.Random(7)
    content = []
    for f in range(12):
        lines = []
        for t in range(rnd.randrange(4)):
            lines += [f"Table: Table_{t + 1}", ""] if rnd.random() < 0.8 else []
            width = rnd.randrange(1, 4)
            for _ in range(rnd.randrange(1, 5)):
                lines.append("".join(rnd.choice(["a", " b ", "", "7"]) + "`" for _ in range(width + (rnd.random() < 0.05))))
                lines += [rnd.choice(["", '""'])] if rnd.random() < 0.15 else []
            lines += [""] * rnd.choice([1, 2, 3, 4])
        content.append((f"f{f}", "\n".join(lines)))
    files = spark.createDataFrame([*content, ("empty", ""), ("null", None)], "file_id string, content string")
    want = sorted(map(str, T.parse_table_text(files).collect()))
    got = T.cells_of_lines(files.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "line")).repartition(2))
    assert sorted(map(str, got.select("file_id", "table_num", "row", "col", "header", "value").collect())) == want and len(want) > 20
