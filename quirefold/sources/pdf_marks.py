"""Bookmarks and links put into PDF files by incremental updates: the input's bytes stay as they are, new objects follow.

A file is read as far as its cross-references, its page tree and the pages that get links; what is added is an outline
tree, a link annotation for each rectangle, new versions of the catalogue and of these pages, and a cross-reference
section of the kind that the file ends with (a table, or a stream). Objects within object streams are read; streams are
taken plain or deflated, with or without a PNG predictor.

Defined results: an encrypted file and one whose cross-references cannot be followed come out as they are, with the
reason; marks of pages that the file lacks are left out; a file without marks comes out as it is; repeated marks are
marks of their own, in order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.sources.shared import ship


#: What tasks hand on together: bytes of files, rows of bookmarks.
BATCH_BYTES, BATCH_ROWS = 1 << 22, 4000


class Name(str):
    __slots__ = ()


class Ref(tuple):
    """An object's number and generation."""

    __slots__ = ()


class Text(bytes):
    """A string, as it stands in the file."""

    __slots__ = ()


_TOKEN = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*(?:(<<|>>|\[|\])|(/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(<[0-9A-Fa-f\s]*>)|(\()|([+-]?[0-9]*\.?[0-9]+|[+-]?[0-9]+\.)|([A-Za-z]+))")
_REF = re.compile(rb"\s+([0-9]+)\s+R(?![A-Za-z])")


class Unreadable(ValueError):
    pass


def parse(data: bytes, at: int = 0):
    """The value that stands at this place, and the place behind it."""
    m = _TOKEN.match(data, at)
    if not m:
        raise Unreadable("no value")
    mark, name, hexa, string, number, word = m.groups()
    if mark == b"<<":
        out, at = {}, m.end()
        while (end := _TOKEN.match(data, at)) and end.group(1) != b">>":
            key, at = parse(data, at)
            if not isinstance(key, Name):
                raise Unreadable("a key that is no name")
            out[key], at = parse(data, at)
        if not end:
            raise Unreadable("an open dictionary")
        return out, end.end()
    if mark == b"[":
        items, at = [], m.end()
        while (end := _TOKEN.match(data, at)) and end.group(1) != b"]":
            item, at = parse(data, at)
            items.append(item)
        if not end:
            raise Unreadable("an open array")
        return items, end.end()
    if mark:
        raise Unreadable("an end without a beginning")
    if name is not None:
        return Name(name[1:].decode("latin-1")), m.end()
    if hexa is not None:
        return Text(hexa), m.end()
    if string is not None:
        depth, k = 1, m.end()
        while depth:
            c = data[k : k + 1]
            if not c:
                raise Unreadable("an open string")
            k += 2 if c == b"\\" else 1
            depth += (c == b"(") - (c == b")")
        return Text(data[m.end() - 1 : k]), k
    if number is not None:
        ref = _REF.match(data, m.end()) if number.isdigit() else None
        if ref:
            return Ref((int(number), int(ref.group(1)))), ref.end()
        return (float(number) if b"." in number else int(number)), m.end()
    return {b"true": True, b"false": False, b"null": None}.get(word, Name(f"?{word.decode()}")), m.end()


def written(value) -> bytes:
    if isinstance(value, dict):
        return b"<<" + b" ".join(written(Name(k)) + b" " + written(v) for k, v in value.items()) + b">>"
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, Name):
        return b"/" + value.encode("latin-1")
    if isinstance(value, bytes):
        return bytes(value)
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    return (b"%d" % value) if isinstance(value, int) else (f"{value:.4f}".rstrip("0").rstrip(".") or "0").encode()


def text_string(s: str) -> Text:
    return Text(b"<" + (b"\xfe\xff" + s.encode("utf-16-be", "replace")).hex().encode() + b">")


class File:
    """Cross-references and objects of a PDF file."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.places: dict[int, tuple[int, int, int]] = {}  # object -> (1, offset, generation) or (2, object stream, index)
        self.trailer: dict = {}
        self.held: dict[int, list] = {}
        found = list(re.finditer(rb"startxref\s+([0-9]+)", data))
        if not found:
            raise Unreadable("no cross-references")
        self.start = at = int(found[-1].group(1))
        self.by_stream = False
        seen: set[int] = set()
        ways = [at]
        while ways:
            at = ways.pop(0)
            if at in seen or not 0 <= at < len(data):
                continue
            seen.add(at)
            trailer = self._table(at) if data[at : at + 20].lstrip().startswith(b"xref") else self._stream(at, at == self.start)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            ways += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]
        if "Encrypt" in self.trailer:
            raise Unreadable("encrypted")
        if not isinstance(self.trailer.get("Root"), Ref):
            raise Unreadable("no catalogue")

    def _table(self, at: int) -> dict:
        at = self.data.index(b"xref", at) + 4
        while m := re.compile(rb"\s*([0-9]+)\s+([0-9]+)[ \t]*\r?\n?").match(self.data, at):
            first, count, at = int(m.group(1)), int(m.group(2)), m.end()
            for k in range(count):
                e = re.compile(rb"\s*([0-9]{10}) ([0-9]{5}) ([nf])\s*").match(self.data, at)
                if not e:
                    raise Unreadable("a cross-reference table that is broken")
                at = e.end()
                if e.group(3) == b"n":
                    self.places.setdefault(first + k, (1, int(e.group(1)), int(e.group(2))))
                else:
                    self.places.setdefault(first + k, (0, 0, 0))
        m = re.compile(rb"\s*trailer").match(self.data, at)
        if not m:
            raise Unreadable("no trailer")
        return parse(self.data, m.end())[0]

    def _stream(self, at: int, last: bool) -> dict:
        head, body = self._stream_at(at)
        if head.get("Type") != "XRef":
            raise Unreadable("no cross-reference stream")
        self.by_stream |= last
        w = head["W"]
        index, row, k = head.get("Index", [0, head["Size"]]), sum(w), 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for n in range(first, first + count):
                entry, fields, p = body[k : k + row], [], 0
                for size in w:
                    fields.append(int.from_bytes(entry[p : p + size], "big") if size else 1)
                    p += size
                self.places.setdefault(n, (fields[0], fields[1], fields[2] if w[2] else 0))
                k += row
        return head

    def _stream_at(self, at: int) -> tuple[dict, bytes]:
        m = re.compile(rb"\s*[0-9]+\s+[0-9]+\s+obj").match(self.data, at)
        if not m:
            raise Unreadable("no object where one should be")
        head, end = parse(self.data, m.end())
        s = re.compile(rb"\s*stream\r?\n").match(self.data, end)
        if not s or not isinstance(head, dict):
            raise Unreadable("no stream")
        length = head.get("Length")
        length = self.get(length) if isinstance(length, Ref) else length
        body = self.data[s.end() : s.end() + length]
        filters = head.get("Filter")
        filters = [filters] if isinstance(filters, Name) else filters or []
        if [f for f in filters if f != "FlateDecode"] or len(filters) > 1:
            raise Unreadable("a stream of another kind")
        if filters:
            body = zlib.decompress(body)
            parms = head.get("DecodeParms") or {}
            parms = parms[0] if isinstance(parms, list) else parms
            if parms.get("Predictor", 1) >= 10:
                body = _unpredicted(body, parms.get("Columns", 1))
        return head, body

    def get(self, ref):
        """The object of a reference; another value is itself."""
        if not isinstance(ref, Ref):
            return ref
        kind, a, b = self.places.get(ref[0], (0, 0, 0))
        if kind == 1:
            m = re.compile(rb"\s*([0-9]+)\s+[0-9]+\s+obj").match(self.data, a)
            if not m or int(m.group(1)) != ref[0]:
                raise Unreadable("no object where one should be")
            return parse(self.data, m.end())[0]
        if kind == 2:
            if a not in self.held:
                head, body = self._stream_at(self.places[a][1])
                numbers = body[: head["First"]].split()
                self.held[a] = [parse(body, head["First"] + int(at))[0] for at in numbers[1::2]]
            return self.held[a][b]
        return None

    def pages(self) -> list[Ref]:
        """The pages in order."""
        out, seen = [], set()
        ways = [self.get(self.trailer["Root"]).get("Pages")]
        while ways:
            ref = ways.pop()
            if not isinstance(ref, Ref) or ref in seen:
                continue
            seen.add(ref)
            node = self.get(ref)
            if isinstance(node, dict):
                kids = self.get(node.get("Kids"))
                if kids is not None:
                    ways += reversed(kids)
                else:
                    out.append(ref)
        return out


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Rows of bytes behind a mark of how they follow from the row above."""
    out, above = bytearray(), bytearray(columns)
    for k in range(0, len(data) - columns, columns + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + columns])
        if kind == 2:
            row = bytearray((x + y) & 255 for x, y in zip(row, above, strict=True))
        elif kind == 1:
            for i in range(1, columns):
                row[i] = (row[i] + row[i - 1]) & 255
        elif kind:
            raise Unreadable("a predictor of another kind")
        out += row
        above = row
    return bytes(out)


def marked(data: bytes, bookmarks: list[dict], links: list[dict]) -> bytes:
    """data and an update with the bookmarks (ord, parent: ord of a bookmark before or None, title, page_num from 1) as its
    outline, and the links (page_num, x0, y0, x1, y1, to_page)."""
    file = File(data)
    pages = file.pages()
    page = lambda n: pages[n - 1] if n is not None and 0 < n <= len(pages) else None
    bookmarks = [b for b in sorted(bookmarks, key=lambda b: b["ord"]) if page(b["page_num"])]
    links = [x for x in links if page(x["page_num"]) and page(x["to_page"])]
    if not bookmarks and not links:
        return data
    size = max([file.trailer.get("Size", 0), *(n + 1 for n in file.places)])
    objects: dict[Ref, bytes] = {}

    def new(value=None) -> Ref:
        nonlocal size
        ref = Ref((size, 0))
        size += 1
        objects[ref] = written(value)
        return ref

    target = lambda n: [page(n), Name("XYZ"), None, None, None]
    if bookmarks:
        root, ref_of, kids = new(), {}, {}
        for b in bookmarks:
            b["_ref"] = new()
            above = ref_of.get(b["parent"], root)
            b["_above"] = above
            kids.setdefault(above, []).append(b)
            ref_of[b["ord"]] = b["_ref"]
        count = lambda ref: sum(1 + count(b["_ref"]) for b in kids.get(ref, []))
        ends = lambda ref: {"First": kids[ref][0]["_ref"], "Last": kids[ref][-1]["_ref"], "Count": count(ref)} if ref in kids else {}
        for level in kids.values():
            for k, b in enumerate(level):
                near = {"Prev": level[k - 1]["_ref"]} if k else {}
                near |= {"Next": level[k + 1]["_ref"]} if k + 1 < len(level) else {}
                objects[b["_ref"]] = written({"Title": text_string(b["title"] or ""), "Parent": b["_above"], **near, **ends(b["_ref"]), "Dest": target(b["page_num"])})
        objects[root] = written({"Type": Name("Outlines"), **ends(root)})
        objects[file.trailer["Root"]] = written(file.get(file.trailer["Root"]) | {"Outlines": root, "PageMode": Name("UseOutlines")})
    by_page: dict[Ref, list[Ref]] = {}
    for x in links:
        ref = new({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [float(x[c]) for c in ("x0", "y1", "x1", "y0")], "Border": [0, 0, 0], "Dest": target(x["to_page"])})
        by_page.setdefault(page(x["page_num"]), []).append(ref)
    for ref, added in by_page.items():
        node = dict(file.get(ref))
        node["Annots"] = [*(file.get(node.get("Annots")) or []), *added]
        objects[ref] = written(node)
    return data + _update(file, objects, size)


def _update(file: File, objects: dict[Ref, bytes], size: int) -> bytes:
    out, places = bytearray(b"\n"), {}
    for ref, value in sorted(objects.items()):
        places[ref] = len(file.data) + len(out)
        out += b"%d %d obj\n" % ref + value + b"\nendobj\n"
    start = len(file.data) + len(out)
    trailer = {k: file.trailer[k] for k in ("Root", "Info", "ID") if k in file.trailer} | {"Prev": file.start}
    if file.by_stream:
        own = Ref((size, 0))
        places[own] = start
        rows = b"".join(b"\x01" + places[r].to_bytes(8, "big") + r[1].to_bytes(2, "big") for r in sorted(places))
        index = [x for r in sorted(places) for x in (r[0], 1)]
        head = {"Type": Name("XRef"), "Size": size + 1, "W": [1, 8, 2], "Index": index, "Length": len(rows), **trailer}
        out += b"%d 0 obj\n" % size + written(head) + b"\nstream\n" + rows + b"\nendstream\nendobj\n"
    else:
        out += b"xref\n" + b"".join(b"%d 1\n%010d %05d n \n" % (r[0], places[r], r[1]) for r in sorted(places))
        out += b"trailer\n" + written(trailer | {"Size": size}) + b"\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def add_marks(pdfs: DataFrame, bookmarks: DataFrame, links: DataFrame, key: str = "doc_id") -> DataFrame:
    """pdfs (key, content) with `marked`, the file with its marks, and `reason` where it could not be read.

    bookmarks (key, ord, parent, title, page_num), links (key, page_num, x0, y0, x1, y1, to_page)."""
    ship(pdfs.sparkSession)
    gather = lambda df, name, *columns: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    # files take time, not bytes: Spark would deal marks of a few bytes to few tasks
    spark = pdfs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pdfs.select(key, "content").repartition(tasks, key).join(gather(bookmarks, "_b", "ord", "parent", "title", "page_num"), key, "left").join(gather(links, "_l", "page_num", "x0", "y0", "x1", "y1", "to_page"), key, "left")
    schema = T.StructType([pdfs.schema[key], T.StructField("marked", T.BinaryType()), T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size = [], 0
            for i in range(batch.num_rows):
                own, content, b, x = (batch.column(c)[i].as_py() for c in (key, "content", "_b", "_l"))
                reason, out = None, content
                try:
                    out = marked(content or b"", b or [], x or [])
                except (Unreadable, zlib.error, KeyError, IndexError, TypeError, AttributeError, ValueError) as e:
                    reason = f"{type(e).__name__}: {e}"
                done.append((own, out, reason))
                size += len(out or b"")
                if size >= BATCH_BYTES:
                    yield _batch(done, names, kinds(batch))
                    done, size = [], 0
            if done:
                yield _batch(done, names, kinds(batch))

    names = [key, "marked", "reason"]
    kinds = lambda batch: [batch.schema.field(key).type, pa.binary(), pa.string()]
    return rows.mapInArrow(run, schema)


def outline_of(data: bytes) -> list[tuple[int, int | None, str, int | None]]:
    """A file's bookmarks in reading order: (place from 0, place of the one above, title, page from 1)."""
    file, out = File(data), []
    number = {ref: n for n, ref in enumerate(file.pages(), 1)}
    ways = [((file.get(file.get(file.trailer["Root"]).get("Outlines")) or {}).get("First"), None)]
    seen: set[Ref] = set()
    while ways:
        at, above = ways.pop()
        if at is None or at in seen:
            continue
        seen.add(at)
        item = file.get(at)
        dest = file.get(item.get("Dest"))
        out.append((len(out), above, _plain(item.get("Title")), number.get(dest[0]) if isinstance(dest, list) and dest else None))
        ways += [(item.get("Next"), above), (item.get("First"), len(out) - 1)]
    return out


def _plain(title) -> str:
    """The text of a string in hexadecimal or in brackets."""
    if not isinstance(title, bytes):
        return ""
    if title[:1] == b"<":
        digits = re.sub(rb"\s", b"", title[1:-1]).decode()
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        raw = re.sub(rb"\\(.)", rb"\1", title[1:-1], flags=re.DOTALL)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def outlines(pdfs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, ord, parent, title, page_num) of the bookmarks in PDF files; files that cannot be read have none."""
    ship(pdfs.sparkSession)
    schema = T.StructType([pdfs.schema[key], *[T.StructField(n, t) for n, t in (("ord", T.LongType()), ("parent", T.LongType()), ("title", T.StringType()), ("page_num", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, kinds = [], [batch.schema.field(key).type, pa.int64(), pa.int64(), pa.string(), pa.int64()]
            for i in range(batch.num_rows):  # a file at a time
                try:
                    marks = outline_of(batch.column("_c")[i].as_py() or b"")
                except (Unreadable, zlib.error, KeyError, IndexError, TypeError, AttributeError, ValueError):
                    continue
                own = batch.column(key)[i].as_py()
                done += [(own, *m) for m in marks]
                if len(done) >= BATCH_ROWS:
                    yield _batch(done, names, kinds)
                    done = []
            if done:
                yield _batch(done, names, kinds)

    names = [key, "ord", "parent", "title", "page_num"]
    return pdfs.select(key, F.col(content).alias("_c")).mapInArrow(run, schema)
