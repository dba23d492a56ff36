"""Paged originals: DOCX pages, sections and paragraphs, files that can't be read, partitions, streams."""

import io
import os
import zipfile

import pytest

from folioscope.sources import originals as O

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
STYLES = f"""<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Two"><w:name w:val="Zwei"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style>
<w:style w:styleId="Own"><w:name w:val="own"/><w:basedOn w:val="Two"/></w:style><w:style w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/></w:style></w:styles>"""


def p(text="", style=None, inside="", props=""):
    pr = f'<w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}{props}</w:pPr>'
    return f"<w:p>{pr}{f'<w:r><w:t>{text}</w:t></w:r>' if text else ''}{inside}</w:p>"


def docx(body, styles=STYLES, document=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", document or f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", styles)
    return out.getvalue()


BREAK, NOTED = '<w:r><w:br w:type="page"/></w:r>', "<w:r><w:lastRenderedPageBreak/></w:r>"


def rows(content, name="a.docx"):
    return [r[1:] for r in O.paragraphs_of(name, content)]


def test_docx_pages_and_sections():
    body = (
        p("Intro") + p("First", "H1") + p("one") + p("Sub", "Own") + p("", None, BREAK) + p("", None, NOTED + "<w:r><w:t>two</w:t></w:r>") + p("three", None, NOTED + "<w:r><w:t> more</w:t></w:r>")
        + p("Second", "H1") + f"<w:tbl><w:tr><w:tc>{p('cell a')}</w:tc><w:tc>{p('cell b')}</w:tc></w:tr></w:tbl>" + p("last", None, "", "<w:pageBreakBefore/>")
        + p("end", None, "<w:r><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r>", "<w:sectPr/>") + p("after", "A", "", '<w:outlineLvl w:val="2"/>')
    )
    assert rows(docx(body)) == [
        (1, "", 0, "Intro", None), (1, "First", 1, "First", None), (1, "First", 2, "one", None), (1, "First / Sub", 3, "Sub", None), (2, "First / Sub", 4, "two", None), (2, "First / Sub", 5, "three more", None),
        (3, "Second", 6, "Second", None), (3, "Second", 7, "cell a", None), (3, "Second", 8, "cell b", None), (4, "Second", 9, "last", None), (4, "Second", 10, "end\tx\ny", None), (5, "Second / after", 11, "after", None),
    ]


def test_docx_leaves_out_what_is_not_text():
    body = p("kept", None, '<w:del><w:r><w:t>gone</w:t></w:r></w:del><w:moveFrom><w:r><w:t>moved</w:t></w:r></w:moveFrom><w:ins><w:r><w:t> new</w:t></w:r></w:ins><mc:AlternateContent><mc:Choice><w:r><w:t> box</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t> twice</w:t></w:r></mc:Fallback></mc:AlternateContent>')
    assert rows(docx(body, None)) == [(1, "", 0, "kept new box", None)]
    nested = p("outer", None, f"<w:r><w:txbxContent>{p('inner')}</w:txbxContent></w:r>")
    assert [r[3] for r in rows(docx(nested))] == ["outer", "inner"]


@pytest.mark.parametrize(
    "name, content, reason",
    [
        ("a.docx", b"not a zip", "damaged"), ("a.docx", docx(p("x"))[:-30], "damaged"), ("a.docx", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "EncryptedPackage".encode("utf-16-le"), "encrypted"),
        ("a.docx", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 old", "damaged"), ("a.docx", docx("", document="<w:document"), "damaged"), ("a.docx", docx(""), "empty"), ("a.docx", b"", "empty"),
        ("a.docx", docx("", document=f'<!DOCTYPE x [<!ENTITY a "b">]><w:document {W}/>'), "damaged"), ("a.pdf", b"%PDF", "type"), ("noending", b"x", "type"), ("a.txt", b"\xff\xfe\xfa", "damaged"), ("a.txt", b" \n", "empty"), ("a.TXT", b"x", None),
    ],
)
def test_files_that_cannot_be_read(name, content, reason):
    got = O.paragraphs_of(name, content)
    assert [r[5] for r in got] == [reason]


def test_damage_in_the_middle():
    whole = bytearray(docx(p("a" * 5000) + "".join(p(str(k)) for k in range(3000)), None))
    for k in range(200, 260):
        whole[k] ^= 0xA5
    assert [r[5] for r in O.paragraphs_of("a.docx", bytes(whole))] == ["damaged"]


def test_markdown_sections():
    text = "top\n# One #\na\n```\n# no heading\n```\n### Deep\nb\n## Two\n\nc\n#tag\n"
    got = [(r[2], r[4]) for r in O.paragraphs_of("a.md", text.encode())]
    assert got == [("", "top"), ("One", "# One #"), ("One", "a"), ("One", "```"), ("One", "# no heading"), ("One", "```"), ("One / Deep", "### Deep"), ("One / Deep", "b"), ("One / Two", "## Two"), ("One / Two", "c"), ("One / Two", "#tag")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k in range(12):
        (tmp_path / "in" / f"f{k}.txt").write_text(f"one {k}\n\ntwo {k}")
    (tmp_path / "in" / "deep" / "d.docx").write_bytes(docx(p("deep", "H1")))
    (tmp_path / "in" / "bad.docx").write_bytes(b"zip?")
    (tmp_path / "in" / ".hidden.txt").write_text("no")
    (tmp_path / "in" / "empty.txt").write_text("")
    return tmp_path / "in"


def test_source(spark, folder, monkeypatch):
    O.register(spark)
    read = spark.read.format("originals").option("path", str(folder)).option("part_bytes", "30")
    got = read.load().collect()
    names = {os.path.basename(r.path): r.reason for r in got}
    assert len(names) == 15 and names["bad.docx"] == "damaged" and names["empty.txt"] == "empty" and sum(r.reason is None for r in got) == 25
    assert read.load().rdd.getNumPartitions() > 5
    assert {r.text for r in read.load().where("section = 'deep'").collect()} == {"deep"}
    one = spark.read.format("originals").option("path", f"file://{folder}/f3.txt").load().collect()
    assert [(r.paragraph, r.text) for r in one] == [(0, "one 3"), (1, "two 3")]
    assert spark.read.format("originals").option("path", f"{folder}/none").load().count() == 0


def test_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    O.register(spark)
    sink, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def drain():
        stream = spark.readStream.format("originals").option("path", str(folder)).option("files_a_batch", "4").load()
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", at).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(sink)

    assert drain().count() == 27
    (folder / "late.txt").write_text("late")
    assert drain().count() == 28 and drain().count() == 28
    assert spark.read.parquet(sink).select("path").distinct().count() == 16
