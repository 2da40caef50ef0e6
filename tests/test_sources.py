"""Readers on packages that are made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import html, office, routing


def package(entries, stored=()):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return b.getvalue()


W = 'xmlns:w="w"'
DOCX = package({"word/document.xml": f"<w:document {W}><w:p><w:r><w:t>A</w:t><w:tab/><w:t>B</w:t></w:r><w:r><w:br/></w:r></w:p><w:p><w:r><w:t>C</w:t></w:r></w:p></w:document>"})
XLSX = package(
    {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/./s1.xml"/><Relationship Id="r2" Target="/xl/sharedStrings.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>",
        "xl/worksheets/s1.xml": '<worksheet><c r="A1" t="s"><v>1</v></c><c r="B1"><v>3</v></c><c r="C1"><f>A1+1</f></c><c r="D1" t="inlineStr"><is><t>in</t></is></c></worksheet>',
    }
)
MANIFEST = '<m xmlns:m="m"><m:file-entry m:full-path="content.xml"/></m>'
ODS = package({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "META-INF/manifest.xml": MANIFEST, "content.xml": '<d xmlns:t="t"><t:table t:name="T"><t:table-row><t:table-cell t:number-columns-repeated="2"><t:p>x</t:p></t:table-cell><t:table-cell t:number-columns-repeated="9999"/></t:table-row></t:table></d>'}, ("mimetype",))
ODT = package({"mimetype": "application/vnd.oasis.opendocument.text", "META-INF/manifest.xml": MANIFEST, "content.xml": '<d xmlns:t="t"><t:h t:outline-level="2">H</t:h><t:p> a  b<t:s t:c="2"/>c<t:line-break/>d </t:p><t:p/></d>'}, ("mimetype",))
EPUB = package(
    {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>',
        "o/p.opf": '<p><manifest><item id="a" href="a%20b.xhtml#x"/></manifest><spine><itemref idref="a"/></spine></p>',
        "o/a b.xhtml": "<html><head><title>T</title></head><body><h1>One</h1><p>two <b>bold</b><br/>x</p></body></html>",
    },
    ("mimetype",),
)


def texts(content):
    kind, nodes, refusal = office.read(content)
    assert refusal is None, refusal
    return kind, [(a, t) for _, a, _, t in nodes]


def test_packages():
    assert texts(DOCX) == ("docx", [("1:1", "A\tB"), ("2:1", "C")])
    assert texts(XLSX) == ("xlsx", [("S!A1", "two"), ("S!B1", "3"), ("S!C1", "A1+1"), ("S!D1", "in")])
    assert texts(ODS) == ("ods", [("T:1:1", "x"), ("T:1:2", "x")])
    assert texts(ODT) == ("odt", [("1", "H"), ("2", "a b  c\nd")])
    assert texts(EPUB) == ("epub", [("1:2", "One"), ("1:3", "two bold\nx")])


def test_rtf():
    stream = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}Caf\'e9\par {\*\skipped no}two\tab x\u8364?\par\u55357?\u56832?}"
    assert texts(stream) == ("rtf", [("1", "Café"), ("2", "two\tx€"), ("3", "😀")])


@pytest.mark.parametrize(("content", "why"), [(b"", "unsupported-format"), (b"{\\rtf1 {a", "rtf-unbalanced"), (b"PK\x03\x04junk", "malformed"), (package({"x": "y"}), "unknown-package"), (package({"word/document.xml": "<a/>", "xl/workbook.xml": "<a/>"}), "ambiguous-package"), (package({"word/document.xml": "<a>"}), "malformed-xml")])
def test_refusals(content, why):
    kind, nodes, refusal = office.read(content)
    assert nodes == [] and refusal.startswith(why)


def test_mutations_are_refused_or_read():
    for content in (DOCX, XLSX, ODT, EPUB):
        for cut in range(0, len(content), 37):
            for broken in (content[:cut], content[:cut] + b"\xff" + content[cut + 1 :]):
                _, nodes, refusal = office.read(broken)
                assert refusal is None or nodes == []


def test_html_blocks():
    page = "<html><head><title>T</title><style>x</style></head><body>loose<p>One <i>leaf</i>  of it<nav><ul><li>menu</li></ul></nav><p>Two<pre> a\n b</pre>&lt;<script>s</script></body>"
    assert html.read(page) == ([(1, "body", "loose"), (2, "p", "One leaf of it"), (5, "p", "Two<"), (6, "pre", "a\n b")], 3, 0)
    assert [n for n, _, _ in html.read("<body><h2>Title</h2><nav><p>menu</p></nav><ul><li>item</li></ul></body>")[0]][0] == 2
    assert html.read(None) == ([], 0, 0)


PPTX = package(
    {
        "ppt/presentation.xml": '<p xmlns:r="r"><sldIdLst><sldId id="256" r:id="b"/><sldId id="257" r:id="a"/></sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="a" Target="slides/s1.xml"/><Relationship Id="b" Target="slides/s2.xml"/></Relationships>',
        "ppt/slides/s1.xml": "<sld><sp><txBody><p><r><t>last</t></r></p></txBody></sp></sld>",
        "ppt/slides/s2.xml": "<sld><sp><txBody><p><r><t>one</t></r><r><t> two</t></r></p><p/></txBody></sp><graphicFrame><tbl><tc><p><fld><t>3</t></fld></p></tc></tbl></graphicFrame></sld>",
    }
)
ODP = package({"mimetype": "application/vnd.oasis.opendocument.presentation", "META-INF/manifest.xml": MANIFEST, "content.xml": '<d xmlns:d="d" xmlns:t="t"><d:page><d:frame><t:p>top</t:p><t:p/><t:p>next</t:p></d:frame><d:rect><t:p>box</t:p></d:rect></d:page><d:page><d:frame><t:p>end</t:p></d:frame></d:page></d>'}, ("mimetype",))


def test_slides():
    assert texts(PPTX) == ("pptx", [("1:1:1:1", "one"), ("1:1:1:2", " two"), ("1:2:1:1", "3"), ("2:1:1:1", "last")])
    assert texts(ODP) == ("odp", [("1:1:1", "top"), ("1:1:3", "next"), ("1:2:1", "box"), ("2:1:1", "end")])
    kind, nodes, refusal = office.read(PPTX.replace(b"x", b"x"))
    assert refusal is None and len(nodes) == 4


def test_too_many_stated_spaces_are_refused():
    for times, why in ((4096, None), (4097, "resource-limit repeated-spaces")):
        made = package({"mimetype": "application/vnd.oasis.opendocument.text", "META-INF/manifest.xml": MANIFEST, "content.xml": f'<d xmlns:t="t"><t:p>a<t:s t:c="{times}"/>b</t:p></d>'}, ("mimetype",))
        assert office.read(made)[2] == why


def test_routing_and_nodes(spark, tmp_path):
    for name, content in {"a.bin": DOCX, "b.pdf": b"%PDF-1.7", "c.rtf": rb"{\rtf1 hi}", "d.png": b"\x89PNG\r\n\x1a\n", "e.txt": b"text", "f": b"\n\n%PDF-1.4"}.items():
        (tmp_path / name).write_bytes(content)
    files = routing.files(spark, str(tmp_path))
    assert {r["path"].rpartition("/")[2]: r["media"] for r in files.collect()} == {"a.bin": "zip", "b.pdf": "pdf", "c.rtf": "rtf", "d.png": "png", "e.txt": None, "f": None}
    heads = spark.createDataFrame([(n, bytearray(c)) for n, c in enumerate((b"%PDF-1.7", b"%PDF-", b"%PD", b"", b"%PDX", b"x%PDF-", b"P"))], "n int, content binary")
    assert [r["n"] for r in heads.where(routing.aims_at_pdf(F.col("content"))).orderBy("n").collect()] == [0, 1, 2, 3]
    got = office.nodes(files.where("media in ('zip', 'rtf')")).collect()
    assert sorted(r["text"] for r in got) == ["A\tB", "C", "hi"]
