"""The PDF source and sink: round trips, hand-written files, and damage."""

import io
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.plans.engine import DamagedPdf, Engine
from loomwork.sources import pdf, pdftext

TEXTS = ["hello\nworld", "", "\n\n a \n", "tab\t\r x  \x0c", "ünï 日本 😀\U0010ffff�", "x" * 20_001 + "\n", "\x00\x01 ( ) \\ <> %", "a" * 8_000 + "b"]


def made(texts, compact=True):
    out = io.BytesIO()
    file = pdf.PdfFile(out, compact)
    for t in texts:
        file.page(t)
    file.close()
    return out.getvalue()


def read(data, *part):
    return [(page, text) for page, text, error in pdftext.texts(data, *part) if not error]


@pytest.mark.parametrize("compact", [True, False])
def test_round_trip(compact):
    texts = [TEXTS[i % len(TEXTS)] for i in range(230)]
    data = made(texts, compact)
    assert read(data) == list(enumerate(texts))
    assert read(data, 0, 3) + read(data, 1, 3) + read(data, 2, 3) == list(enumerate(texts))
    lost = data[: data.rindex(b"startxref")] + b"startxref\n7\n%%EOF"
    assert read(lost) == list(enumerate(texts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=5), st.booleans())
def test_round_trip_of_any_text(texts, compact):
    assert read(made(texts, compact)) == list(enumerate(texts))


FONT = "<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /uni20AC /fi 200 /Acaron] >> >>"


def by_hand(content: bytes, font: str = FONT, more: str = "", head: str = "") -> bytes:
    """A file without cross-references, of one page."""
    return f"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 4 0 R >> /XObject << /X 6 0 R >> >> >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents [5 0 R] >> endobj
4 0 obj {font} endobj
{more}
5 0 obj << {head} /Length 99999 >> stream
""".encode("latin-1") + content + b"\nendstream endobj\ntrailer << /Root 1 0 R >>\n"


@pytest.mark.parametrize(
    "content, text",
    [
        (rb"BT /F1 9 Tf 72 700 Td (Hello \(a\) \101\n(b)) Tj 0 -14 Td [(W) 20 (orld) -400 (again)] TJ ET", "Hello (a) A\n(b)\nWorld again"),
        (rb"""BT /F1 9 Tf 1 0 0 1 72 650 Tm (caf\001 \002 \003n\310) Tj (x) ' 1 2 (y) " ET""", "café € finǍ\nx\ny"),
        (b"BT /F1 9 Tf 10 700 Td (one) Tj 40 0 Td (two) Tj ET BT /F1 9 Tf 10 700 Td (three) Tj ET BT /F1 9 Tf 10 600 Td <66 6F7> Tj ET", "one two three\nfop"),
        (b"q BI /W 1 /H 1 ID \x00(\xff EI Q BT /F1 9 Tf 1 1 Td (after) Tj ET /X Do", "after form"),
        (b"BT /F1 9 Tf (a) Tj T* T* (b) Tj ET", "a\n\nb"),
    ],
)
def test_operators(content, text):
    form = "6 0 obj << /Type /XObject /Subtype /Form /Length 32 >> stream\nBT /F1 9 Tf 1 1 Td (form) Tj ET /X Do\nendstream endobj"
    [(page, got, error)] = pdftext.texts(by_hand(content, more=form))
    assert (page, got, error) == (0, text, None)


def test_filters_and_maps():
    import base64

    plain = b"BT /F1 9 Tf (ab) Tj ET"
    packed = zlib.compress(plain)
    assert read(by_hand(base64.a85encode(packed) + b"~>", head="/Filter [/A85 /Fl]")) == [(0, "ab")]
    assert read(by_hand(packed.hex().encode() + b">", head="/Filter [/ASCIIHexDecode /FlateDecode]")) == [(0, "ab")]
    width = 5
    rows = [plain[i : i + width].ljust(width) for i in range(0, len(plain), width)]
    for how in range(5):
        above, out = bytes(width), b""
        for row in rows:
            coded = bytearray()
            for i, b in enumerate(row):
                left, up, corner = (row[i - 1], above[i], above[i - 1]) if i else (0, above[i], 0)
                guess = [0, left, up, (left + up) // 2, min((left, up, corner), key=lambda x: abs(left + up - corner - x))][how]
                coded.append((b - guess) & 255)
            out += bytes([how]) + coded
            above = row
        assert read(by_hand(zlib.compress(out), head=f"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns {width} >>")) == [(0, "ab")]
    cmap = "7 0 obj << /Length 1 >> stream\n1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfrange <61> <62> <00480049> <63> <64> [<0041> <D83DDE00>] endbfrange\nendstream endobj"
    assert read(by_hand(b"BT /F1 9 Tf (abcd) Tj ET", "<< /Type /Font /Subtype /Type1 /ToUnicode 7 0 R >>", cmap)) == [(0, "HIHJA😀")]


def test_a_font_is_made_once_for_all_pages(monkeypatch):
    fonts = []

    class Counted(pdftext.Font):
        def __init__(self, *parts):
            fonts.append(1)
            super().__init__(*parts)

    monkeypatch.setattr(pdftext, "Font", Counted)
    texts = [f"page {i} ünï" for i in range(230)]
    assert read(made(texts)) == list(enumerate(texts)) and len(fonts) == 1
    fonts.clear()
    monkeypatch.setattr(pdftext, "MAX_FONTS", 1)
    two = by_hand(b"BT /F1 9 Tf (a) Tj /F2 9 Tf (b) Tj /F1 9 Tf (c\310) Tj /F1 9 Tf (d) Tj ET").replace(b"/F1 4 0 R", f"/F1 4 0 R /F2 {FONT}".encode())
    assert read(two) == [(0, "abcǍd")] and len(fonts) == 3


def test_codes_of_two_bytes():
    font, shown = "<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>", b"BT /F1 9 Tf <00010002ffff> Tj % <0001> Tj\n<00010> Tj ET"
    for to, text in (("<D83DDE00>", "a😀\ufffda"), ("<00480049>", "aHI\ufffda")):
        cmap = f"7 0 obj << /Length 1 >> stream\n1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0061> <0002> {to} endbfchar\nendstream endobj"
        assert read(by_hand(shown, font, cmap)) == [(0, text)]


def test_files_are_dealt_to_all_cores():
    files = [(f"{i:04d}.pdf", 100_000) for i in range(1_000)]
    ranges = pdf.PdfReader("data", False, 32 << 20, cores=12).ranges(files)
    assert len(ranges) >= 48 and [f[0] for r in ranges for f in r.files] == [f for f, _ in files]
    big = pdf.PdfReader("data", False, 32 << 20, cores=12).ranges([("a.pdf", 40 << 20), ("b.pdf", 30 << 20)])
    assert [r.files for r in big] == [[("a.pdf", 0, 2)], [("a.pdf", 1, 2)], [("b.pdf", 0, 1)]]


def test_damage_is_named():
    [row] = pdftext.texts(b"junk")
    assert row[:2] == (None, None) and "no header" in row[2]
    data = made(["first", "second"], compact=False)
    [row] = pdftext.texts(data[:200])
    assert row[0] is None and "cut off" in row[2]
    at = [m.start() for m in re.finditer(b"stream\n", data)][0]
    rows = list(pdftext.texts(data[: at + 12] + b"\x00\x00\x00\x00" + data[at + 16 :]))
    assert rows[0][0] == 0 and "damaged" in rows[0][2] and rows[1] == (1, "second", None)
    [row] = pdftext.texts(data.replace(b"trailer\n<<", b"trailer\n<< /Encrypt 1 0 R"))
    assert "encrypted" in row[2]
    [row] = pdftext.texts(by_hand(b"x", head="/Filter /LZWDecode"))
    assert row[0] == 0 and "LZWDecode" in row[2]
    for bad in (b"BT (no font) Tj ET", b"BT /F9 1 Tf ET", b"BT Tf ET", b"[" * 100):
        [row] = pdftext.texts(by_hand(bad))
        assert row[0] == 0 and row[1] is None and row[2]
    circle = by_hand(b"").replace(b"/Kids [3 0 R]", b"/Kids [2 0 R]")
    [row] = pdftext.texts(circle)
    assert "circle" in row[2]


def test_source_and_sink(spark, tmp_path):
    folder = str(tmp_path / "pdfs")
    rows = [(f"f{i % 3}.pdf", i, None if i == 7 else f"page {i}\n" + "é" * i) for i in range(60)]
    pdf.write_pdfs(spark.createDataFrame(rows, "name string, page long, text string"), folder)
    pdf.write_pdfs(spark.createDataFrame(rows[:30], "name string, page long, text string").where("name = 'f0.pdf'"), folder, compact=False)  # replaces a file
    (tmp_path / "pdfs/bad.pdf").write_bytes(b"%PDF-1.7 nothing")
    (tmp_path / "pdfs/B.PDF").write_bytes(b"junk")
    (tmp_path / "pdfs/inner").mkdir()
    (tmp_path / "pdfs/inner/in.pdf").write_bytes(made(["inside"]))
    for part_bytes in (1 << 20, 700):  # 700: files are shared by several partitions
        got = pdf.pdf_pages(spark, folder, part_bytes=part_bytes)
        found = {(r.source.split("/")[-1], r.page): r.text for r in got.where("error is null").collect()}
        want = {}
        for name in ("f0.pdf", "f1.pdf", "f2.pdf"):
            pages = [t or "" for n, i, t in rows if n == name and (name != "f0.pdf" or i < 30)]
            want |= {(name, i): t for i, t in enumerate(pages)}
        assert found == want
        [bad] = got.where("error is not null").collect()
        assert bad.source.endswith("/bad.pdf") and bad.page is None and bad.error.startswith("PdfError")
    assert pdf.pdf_pages(spark, folder, part_bytes=700).rdd.getNumPartitions() > 5
    assert pdf.pdf_pages(spark, folder, recursive=True).where("text = 'inside'").count() == 1
    assert pdf.pdf_pages(spark, f"file://{folder}/f1.pdf").count() == 20
    with pytest.raises(Exception, match="isn't the name of a PDF file"):
        pdf.write_pdfs(spark.createDataFrame([("../x.pdf", 0, "")], "name string, page long, text string"), folder)


def test_engine_reads_pdf_files(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), str(tmp_path / "data"))
    (tmp_path / "data").mkdir()
    assert engine.upload("a.pdf", made(["The longest train gets 10 points.", "A player starts with $1500."])) == 2
    with pytest.raises(DamagedPdf, match="no header"):
        engine.upload("b.pdf", b"nothing")
    with pytest.raises(DamagedPdf):
        engine.upload("a.pdf", b"%PDF-1.4 lost")
    assert [x.name for x in (tmp_path / "data").glob("[!.]*")] == ["a.pdf"]
    (tmp_path / "data/c.pdf").write_bytes(b"lost")
    assert engine.ingest() == 0
    assert [r.source.split("/")[-1] for r in engine.damaged().collect()] == ["c.pdf"]
    told = engine.query("How many points does the longest train get?")
    assert "10 points" in told.answer and told.sources[0].endswith("a.pdf:0:0")


def test_stream_reads_new_and_replaced_files_only(spark, tmp_path):
    import os

    from loomwork.streaming.incremental import ingest_pdf_stream

    data, checkpoint = tmp_path / "data", str(tmp_path / "checkpoint")
    data.mkdir()
    engine, batches = Engine(spark, str(tmp_path / "store"), str(data)), []

    def run():
        batches.clear()
        ingest_pdf_stream(engine, checkpoint, lambda rows: batches.append(rows.collect())).awaitTermination()
        return {(r.source.split("/")[-1], r.page, r.error) for b in batches for r in b}

    for name in ("a", "b", "c"):
        (data / f"{name}.pdf").write_bytes(made([f"first page of {name}", f"second page of {name}"]))
    assert run() == {(f"{n}.pdf", i, None) for n in "abc" for i in (0, 1)} and engine.store.count() == 6
    assert run() == set()  # a restart with nothing new
    (data / "b.pdf").write_bytes(made(["first page of b", "another second page", "third page"]))  # replaced
    (data / "c.pdf").unlink()  # vanished
    (data / "d.pdf").write_bytes(b"damaged")
    got = run()
    assert {x for x in got if not x[2]} == {("b.pdf", i, None) for i in range(3)}
    assert {x[:2] for x in got if x[2]} == {("c.pdf", None), ("d.pdf", None)} and pdf.VANISHED in {x[2] for x in got}
    texts = {r.id.split("/")[-1]: r.text for r in engine.store.read().collect()}
    assert texts["b.pdf:1:0"] == "second page of b" and texts["b.pdf:2:0"] == "third page" and len(texts) == 7
    stat = os.stat(data / "a.pdf")
    os.utime(data / "a.pdf", ns=(stat.st_atime_ns, stat.st_mtime_ns + 10**9))  # the same length at another time
    assert {x[:2] for x in run()} == {("a.pdf", 0), ("a.pdf", 1)} and engine.store.count() == 7


def test_an_offset_names_the_same_files_again(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.pdf").write_bytes(made(["x"]))
    stream = pdf.PdfChanges(pdf.PdfReader(str(data), False, 1 << 20), str(tmp_path / "state"))
    first = stream.latestOffset()
    again = pdf.PdfChanges(stream.reader, stream.state)
    assert again.latestOffset() == first == {"listing": 1}
    (data / "b.pdf").write_bytes(made(["y"]))
    second = again.latestOffset()
    files = lambda a, b: [f for r in again.partitions(a, b) for f in r.files]
    assert [f[0][-5:] for f in files(stream.initialOffset(), first)] == ["a.pdf"] and [f[0][-5:] for f in files(first, second)] == ["b.pdf"]
    assert files(first, second) == files(first, second) and files(second, second) == []
    again.commit(second)
    assert [f[0][-5:] for f in files(first, second)] == ["b.pdf"]
