"""Readers on files with known contents: pages, tables, fonts and filters of PDFs, CSV dialects, damaged and oddly encoded files."""

import base64
import io
import zipfile
import zlib

import pytest

from tessera.operators import layout
from tessera.sources import charset, files, pdf


def _lzw(data: bytes) -> bytes:
    """Packs with codes of 9 to 12 bits, one code early, as PDF has it."""
    out, table, held, width = [(256, 9)], {bytes([i]): i for i in range(256)}, b"", 9
    for i in range(len(data)):
        c = data[i : i + 1]
        if held + c in table:
            held += c
            continue
        out.append((table[held], width))
        table[held + c] = len(table) + 2
        held = c
        width = 9 + (len(table) + 2 >= 512) + (len(table) + 2 >= 1024) + (len(table) + 2 >= 2048)
        if len(table) > 4000:
            out.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
    out += [(table[held], width)] if held else []
    bits = "".join(f"{c:0{w}b}" for c, w in [*out, (257, width)])
    return int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8)


def _hexed(data: bytes) -> bytes:
    return data.hex().encode() + b">"


PACKERS = {
    "": lambda d: d,
    "/Filter /FlateDecode ": zlib.compress,
    "/Filter /LZWDecode ": _lzw,
    "/Filter [/ASCII85Decode /FlateDecode] ": lambda d: base64.a85encode(zlib.compress(d)) + b"~>",
    "/Filter [/ASCIIHexDecode] ": _hexed,
    "/Filter /RunLengthDecode ": lambda d: b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100)) + b"\x80",
}


def _pdf(streams: list[bytes], way: str = "", extra: bytes = b"", fonts: bytes = b"", objects: bytes = b"") -> bytes:
    """A file whose page tree lists its pages in reverse order of their numbers."""
    out = [b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", objects]
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in reversed(range(len(streams))))
    out.append(b"2 0 obj << /Type /Pages /Resources << /Font << %s >> >> /Kids [%s] /Count %d >> endobj\n" % (fonts, kids, len(streams)))
    for i, data in enumerate(streams):
        body = PACKERS[way](data)
        out.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (10 + 2 * i, 11 + 2 * i))
        out.append(b"%d 0 obj << %s/Length %d >> stream\n%s\nendstream endobj\n" % (11 + 2 * i, way.encode(), len(body), body))
    return b"".join(out) + b"trailer << /Root 1 0 R " + extra + b">>\n%%EOF"


_LAST = b"BT /F1 12 Tf 72 700 Td [(Sec) -20 (ond) -350 (page)] TJ 0 -14 Td (a \\(b\\) \\351) Tj ET"
_FIRST = b"% remark (no)\nBT /F1 12 Tf 14 TL 72 700 Td (First) Tj T* <48 69> Tj ET q 1 0 0 1 0 0 cm Q"
SCHEMA = "path string, content binary"


def _pages(spark, *contents):
    rows = spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], SCHEMA)
    return {(r["path"], r["page"]): r["page_text"] for r in files.pdf_pages(rows).collect()}


@pytest.mark.parametrize("way", PACKERS)
def test_streams_unpack(way):
    for page, text in zip(pdf.placed(_pdf([_LAST, b"", _FIRST * 40], way)), (["First", "Hi"] * 40, [], ["Sec", "ond", "page", "a (b) \xe9"]), strict=True):
        assert [p[5] for p in page] == text


def test_pages_in_tree_order(spark):
    assert _pages(spark, _pdf([_LAST, b"", _FIRST], "/Filter /FlateDecode ")) == {("f0", 1): "First\nHi", ("f0", 2): "", ("f0", 3): "Second page\na (b) \xe9"}


def test_objects_in_streams():
    inner = b"1 0 2 34 3 76 << /Type /Catalog /Pages 2 0 R >>  << /Type /Pages /Kids [3 0 R] /Count 1 >> << /Type /Page /Contents 5 0 R >>"
    first = inner.index(b"<<")
    places = [inner.index(x, first) - first for x in (b"<< /Type /Catalog", b"<< /Type /Pages", b"<< /Type /Page /")]
    head = b" ".join(b"%d %d" % (n + 1, at) for n, at in enumerate(places)) + b" "
    body = zlib.compress(head + inner[first:])
    packed = b"4 0 obj << /Type /ObjStm /N 3 /First %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (len(head), body)
    got = pdf.placed(b"%PDF-1.5\n" + packed + b"5 0 obj << >> stream\nBT (inside) Tj ET\nendstream endobj\n")
    assert [[p[5] for p in page] for page in got] == [["inside"]]


CMAP = b"""/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0003> <0020> <0041> <D83DDE00> endbfchar
3 beginbfrange <0024> <0030> <0410> <0100> <0101> [<006600660069> <4E2D>] <0200> <0202> <0061> endbfrange endcmap"""


def test_two_byte_fonts_and_encodings(spark):
    wide = b"/F1 20 0 R /F2 23 0 R /F3 24 0 R"
    objects = b"20 0 obj << /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [21 0 R] /ToUnicode 22 0 R >> endobj\n"
    objects += b"21 0 obj << /Subtype /CIDFontType2 /DW 600 /W [36 [500 500] 65 70 1000] >> endobj\n22 0 obj << >> stream\n" + CMAP + b"\nendstream endobj\n"
    objects += b"23 0 obj << /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /A /eacute /fi /uni4E2D 65 /Zcaron /nonsense] >> >> endobj\n"
    objects += b"24 0 obj << /Subtype /TrueType /Encoding /MacRomanEncoding >> endobj\n"
    stream = b"BT /F1 10 Tf 50 700 Td <00240025 0026 0041> Tj 0 -20 Td <01000101 0003 0200 0202> Tj ET BT /F2 10 Tf 50 640 Td (\\001\\002\\003\\004ABC) Tj ET BT /F3 10 Tf 50 600 Td (caf\\216) Tj ET"
    assert _pages(spark, _pdf([stream], fonts=wide, objects=objects)) == {("f0", 1): "АБВ😀\nffi中 ac\nAéﬁ中ŽC\ncafé"}


def _grid(xs, ys, texts, size=10) -> bytes:
    """All lines of a grid and a text in each cell, from the top left."""
    out = [b"%d %d m %d %d l S" % (x, ys[-1], x, ys[0]) for x in xs] + [b"%d %d m %d %d l S" % (xs[0], y, xs[-1], y) for y in ys]
    cells = [(x, y) for y in ys[1:] for x in xs[:-1]]
    out += [b"BT /F1 %d Tf %d %d Td (%s) Tj ET" % (size, x + 4, y + 4, t.encode("cp1252")) for (x, y), t in zip(cells, texts, strict=True) if t]
    return b"\n".join(out)


def test_ruled_tables(spark):
    top = _grid([50, 150, 250, 350], [700, 680, 660], ["name", "n", "note", "a b", "1", ""])
    left, right = _grid([50, 120], [600, 580, 560], ["x", "y"]), _grid([300, 360, 420], [610, 580], ["p", "q"])
    page = b"\n".join([b"BT /F1 10 Tf 50 740 Td (Above) Tj ET", top, left, right, b"BT /F1 10 Tf 50 500 Td (Below) Tj ET"])
    rows = spark.createDataFrame([("a", _pdf([_FIRST, page])), ("b", _pdf([b"50 50 m 60 50 l S 0 0 100 100 re f"])), ("c", b"no"), ("d", None)], SCHEMA)
    got = sorted((r["path"], r["table_id"], r["headers"], r["data"]) for r in files.pdf_tables(rows).collect())
    assert got == [
        ("a", "page_1_table_1", ["name", "n", "note"], [["a b", "1", ""]]),
        ("a", "page_1_table_2", ["x"], [["y"]]),
        ("a", "page_1_table_3", ["p", "q"], []),
    ]
    text = {r["page"]: r["page_text"] for r in files.pdf_pages(rows.where("path = 'a'")).collect()}
    assert text[1].split("\n---\n")[:3] == ["TABLE:\n| name | n | note |\n| --- | --- | --- |\n| a b | 1 |  |", "TABLE:\n| x |\n| --- |\n| y |", "TABLE:\np|q"]
    assert text[1].split("\n---\n")[3].startswith("Above\nname n note\na b 1\n") and text[2] == "First\nHi"


def test_merged_cells_rectangles_and_many_lines(spark):
    # a head over two columns; thin filled rectangles for lines; the page turned into place by a matrix
    boxes = [(50, 660, 200, 20), (50, 640, 100, 20), (150, 640, 100, 20)]
    stream = b"q 2 0 0 2 0 0 cm " + b" ".join(b"%d %d %d %d re S" % tuple(v // 2 for v in b) for b in boxes) + b" Q "
    stream += b"BT /F1 10 Tf 1 0 0 1 60 664 Tm (Both) Tj 1 0 0 1 60 644 Tm (left) Tj 1 0 0 1 160 650 Tm (right) Tj 1 0 0 1 160 642 Tm (side) Tj ET "
    stream += b" ".join(b"%d %d %d 1 re f" % (50, y, 300) for y in (500, 480, 460)) + b" " + b" ".join(b"%d 460 1 41 re f" % x for x in (50, 200, 349))
    stream += b" BT /F1 8 Tf 60 484 Td (u) Tj 150 0 Td (v) Tj ET"
    rows = spark.createDataFrame([("a", _pdf([stream]))], SCHEMA)
    got = {r["table_id"]: (r["headers"], r["data"]) for r in files.pdf_tables(rows).collect()}
    assert got == {"page_1_table_1": (["Both", ""], [["left", "right\nside"]]), "page_1_table_2": (["u", "v"], [["", ""]])}


def test_large_grid(spark):
    xs, ys = list(range(20, 560, 18)), list(range(780, 60, -12))
    texts = [f"{i}" for i in range((len(xs) - 1) * (len(ys) - 1))]
    rows = spark.createDataFrame([(str(k), _pdf([_grid(xs, ys, texts, 6)])) for k in range(3)], SCHEMA)
    found = files.pdf_tables(rows).collect()
    width = len(xs) - 1
    assert len(found) == 3 and all([r["headers"], *r["data"]] == [texts[i : i + width] for i in range(0, len(texts), width)] for r in found)


def test_layout_without_pieces(spark):
    none = spark.createDataFrame([], "page int, seq int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    assert layout.contents(none, ["page"]).count() == 0 and layout.tables(none, ["page"]).count() == 0


def test_forms_nested_strings_and_hostile_streams(spark):
    objects = b"30 0 obj << /Subtype /Form /Resources << /XObject << /X 30 0 R >> >> >> stream\nBT 10 10 Td (form) Tj ET /X Do\nendstream endobj\n"
    page = b"10 0 obj << /Type /Page /Resources << /XObject << /X 30 0 R >> >> /Contents 11 0 R >> endobj 11 0 obj << >> stream\n/X Do BT 0 50 Td (a (b (c (d)))) Tj ET\nendstream endobj\n"
    got = _pages(spark, b"%PDF-1.4\n" + objects + page)
    assert got[("f0", 1)].split("\n")[0] == "a (b (c (d)))" and set(got[("f0", 1)].split("\n")[1].split(" ")) <= {"form", "formform", ""} | {"form" * k for k in range(12)}
    bomb = zlib.compress(b"(x) Tj " * 20_000_000)
    hostile = [
        b"BT <FEFFD800> Tj (\\376\\377\\330\\000) Tj ET", b"(never ends " * 1000, b"[" * 5000 + b"<<" * 5000, b"BT 1 Tm (a) Tj /F1 Tf () ' ET Q Q Q cm re", b"BI /W 1 ID \x00\xff EI BT (after) Tj ET",
        b"BT /F1 nan Tf 1e999 0 Td (far) Tj ET", b"(" * 200_000, b"/" * 200_000, b"<" * 200_000,
    ]
    pages = _pages(spark, *(_pdf([h]) for h in hostile))
    assert len(pages) == len(hostile) and pages[("f4", 1)] == "after"
    packed = b"%PDF-1.4\n10 0 obj << /Type /Page /Contents 11 0 R >> endobj\n11 0 obj << /Filter /FlateDecode >> stream\n" + bomb + b"\nendstream endobj\n"
    assert len(pdf.File(packed).stream(pdf.Reference(11))) <= pdf.MOST


def test_odd_files(spark, tmp_path):
    for odd in (None, b"", b"no pdf", b"%PDF-1.4\n%%EOF", _pdf([_FIRST], extra=b"/Encrypt 9 0 R ")):
        assert pdf.placed(odd) is None
    (tmp_path / "good.PDF").write_bytes(_pdf([_LAST, _FIRST]))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 cut")
    (tmp_path / "a.txt").write_text("plain")
    found = files.scan(spark, str(tmp_path))
    by = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.texts(found).collect()}
    assert by == {"good.PDF": "First\nHi\n---\nSecond page\na (b) \xe9", "bad.pdf": None, "a.txt": "plain"}


def test_csv_cells_that_a_pattern_loses(spark):
    long = b'a,b\n"' + b"q" * 1_000_000 + b'",2\n'
    cases = [
        (long, [["a", "b"], ["q" * 1_000_000, "2"]]),
        (b",2\n1,2\n", [["", "2"], ["1", "2"]]),
        (b'a,b\nx"y,2\n', [["a", "b"], ['x"y', "2"]]),
        (b'a,b\n"two\nlines",2\n\n"say ""hi""",\n', [["a", "b"], ["two\nlines", "2"], ['say "hi"', ""]]),
        (b"a,b\r\n1,2,3\r\n4\r\n", [["a", "b"], ["4"]]),
        (b'a\n"never ends\n', [["a"], ["never ends\n"]]),
        ("имя,n\nПривет мир,1\n".encode("cp1251"), [["имя", "n"], ["Привет мир", "1"]]),
        (b"", []),
    ]
    rows = spark.createDataFrame([(str(i), raw) for i, (raw, _) in enumerate(cases)] + [("null", None)], SCHEMA)
    got = {r["path"]: r["tables"] for r in files.csv_tables(rows).collect()}
    for i, (_, want) in enumerate(cases):
        assert [[t["headers"], *t["data"]] for t in got[str(i)]] == ([want] if want else []), i
    assert got["null"] == []
    assert rows.where("path = 'null' or path = '7'").select(files.csv_text()).collect() == [(None,), (None,)]


def _docx(body: str, change=lambda raw: raw) -> bytes:
    out = io.BytesIO()
    name = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{name}"><w:body>{body}</w:body></w:document>')
    return change(out.getvalue())


def test_damaged_office_files_leave_the_others(spark):
    text = "<w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>" + "text " * 200 + "</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    good = _docx(text + table)
    locked = _docx(text, lambda raw: raw.replace(b"PK\x03\x04\x14\x00\x00", b"PK\x03\x04\x14\x00\x01").replace(b"PK\x01\x02\x14\x03\x14\x00\x00", b"PK\x01\x02\x14\x03\x14\x00\x01"))
    torn = good[:75] + b"\xff" * 40 + good[115:]
    unknown = good.replace(b"\x08\x00", b"\x63\x00")
    rows = spark.createDataFrame([("good", good), ("locked", locked), ("torn", torn), ("unknown", unknown), ("cut", good[:200]), ("none", None), ("text", b"plain")], SCHEMA)
    got = {r["path"]: r for r in files.office_documents(rows).collect()}
    assert got["good"]["text"].startswith("## Head\n\ntext ") and [(t["table_id"], t["headers"], t["data"]) for t in got["good"]["tables"]] == [("table_1", ["h"], [["c"]])]
    assert all(got[k]["text"] is None and got[k]["tables"] == [] for k in got if k != "good")


SAMPLES = {
    "cp1251": "Съешь же ещё этих мягких французских булок, да выпей чаю. Москва, 2024 год.",
    "koi8-r": "Съешь же ещё этих мягких французских булок, да выпей чаю. Москва, 2024 год.",
    "shift_jis": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。カタカナも少し。",
    "euc_jp": "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。カタカナも少し。",
    "gb18030": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "big5": "人人生而自由,在尊嚴和權利上一律平等。他們賦有理性和良心,並應以兄弟關係的精神相對待。",
    "euc_kr": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.",
    "cp1252": "Les élèves français préfèrent le café à l’hôtel – c’est « déjà » réglé. Größe, Straße, niño.",
    "cp1253": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "cp1250": "Příliš žluťoučký kůň úpěl ďábelské ódy. Zażółć gęślą jaźń.",
    "utf-16-le": "Plain words without a mark.",
    "utf-16-be": "Съешь же ещё этих мягких булок",
    "iso2022_jp": "吾輩は猫である。",
    "utf-8": "naïve 猫 ёж",
}


@pytest.mark.parametrize("name", SAMPLES)
def test_charsets_told_apart(name):
    text = SAMPLES[name]
    raw = text.encode(name)
    assert charset.text(raw) == text, charset.detect(raw)


@pytest.mark.parametrize("text, name", [("Привет", "cp1251"), ("日本", "shift_jis"), ("über", "cp1252"), ("10 € – “x”", "cp1252"), ("Die Größe", "cp1252")])
def test_charsets_of_short_texts(text, name):
    assert charset.text(text.encode(name)) == text


def test_charsets_in_a_table(spark):
    rows = spark.createDataFrame([(n, t.encode(n)) for n, t in SAMPLES.items()] + [("utf-8-sig", "﻿a".encode()), ("utf-16", "né".encode("utf-16")), ("", b""), ("null", None), ("byte", b"\xe9")], SCHEMA)
    got = {r["path"]: r for r in rows.select("path", files.detected_charset().alias("charset"), files.detected_text().alias("text")).collect()}
    assert {n: got[n]["text"] for n in SAMPLES} == SAMPLES
    assert got["utf-8-sig"]["text"] == "a" and got["utf-16"]["text"] == "né" and got["byte"]["text"] == "é"
    assert (got[""]["charset"], got[""]["text"]) == ("utf-8", "") and got["null"]["text"] is None and got["null"]["charset"] is None
