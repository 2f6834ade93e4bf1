import base64
import gzip
import io
import zipfile

from hypothesis import given
from hypothesis import strategies as st

from tessera.sources import files, html


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


PAGE = """<html lang="de"><head><title>t</title><script>x()</script></head><body><nav><p>menu</p></nav><h1>A</h1><p>one <b>two</b></p>
<h2>B</h2><ul><li>x</li><li>y</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><pre>a
 b</pre><div class="footer-box">no</div><h2>C</h2><img src="i.png" alt="pic"><p>end<br>line</p>"""


def test_html_blocks():
    assert html.blocks(PAGE)[1:] == [
        ("heading", "A", ["A"]), ("paragraph", "one two", ["A"]), ("heading", "B", ["A", "B"]), ("list", "x\ny", ["A", "B"]),
        ("table_summary", "Table rows=2 columns=2\nk\tv\n1\t2", ["A", "B"]), ("code", "a\n b", ["A", "B"]), ("heading", "C", ["A", "C"]),
        ("image", "pic", ["A", "C"]), ("paragraph", "end line", ["A", "C"]),
    ]
    assert html.blocks(None) == [] and html.blocks("<p>open <i>never closed") == [("paragraph", "open never closed", [])]


@given(st.text(alphabet="<>/abtdrp h1\"'= &;!-", max_size=60))
def test_html_never_fails(text):
    html.blocks(text)


def test_office_files():
    w = 'xmlns:w="w"'
    docx = archive({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert files.docx_blocks(docx) == [("heading", "Title"), ("paragraph", "a b"), ("table_summary", "Table rows=1 columns=1\nc")]
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>%s</a:t></a:r></a:p></p:sld>'
    assert files.pptx_blocks(archive({"ppt/slides/slide10.xml": slide % "ten", "ppt/slides/slide2.xml": slide % "two", "ppt/notesSlides/notesSlide1.xml": slide % "n"})) == [("slide", "two"), ("slide", "ten"), ("note", "n")]
    xlsx = archive({"xl/sharedStrings.xml": '<sst xmlns="s"><si><t>hey</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="s"><sheetData><row><c t="s"><v>0</v></c><c><v>4</v></c></row><row><c/></row></sheetData></worksheet>'})
    assert files.xlsx_blocks(xlsx) == [("table_summary", "hey\t4")]


def test_markdown():
    text = b"---\na: 1\n---\n# T\n\npara\nmore\n\n- x\n- y\n\n|a|b|\n|-|-|\n|1|2|\n\n```\ncode\n\nx\n```\n[^1]: note\n"
    assert files.markdown_blocks(text) == [("note", "a: 1"), ("heading", "T"), ("paragraph", "para\nmore"), ("list", "- x\n- y"), ("table_summary", "Table rows=2\na\tb\n1\t2"), ("code", "code\n\nx"), ("note", "[^1]: note")]


def test_frames(spark):
    docx = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    rows = [(1, "text/plain", b"a\n\nb"), (2, docx, b"broken"), (3, None, b"x"), (4, "image/png", b"\x89PNG"), (5, "text/html", PAGE.encode()), (6, "text/plain", None)]
    got = files.parse(spark.createDataFrame(rows, "id long, media_type string, content binary")).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.kind, r.text))
    assert by[1] == [("paragraph", "a"), ("paragraph", "b")] and by[2] == [("error", "BadZipFile")] and by[4] == [("other", "image/png")]
    assert 3 not in by and 6 not in by and len(by[5]) == 10
    raw = [(gzip.compress("é".encode()), "gzip"), (base64.b64encode(b"x"), "base64"), (b"no", "gzip"), (None, None), (b"\xff", None)]
    df = spark.createDataFrame(raw, "content binary, encoding string")
    assert [r[0] for r in df.select(files.decode_payload("content", "encoding")).collect()] == ["é", "x", None, None, "ÿ"]


def test_upsert_and_eval_set(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.current(spark, path, "k") is None
    files.upsert(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), "k")
    files.upsert(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), "k")
    assert sorted(map(tuple, files.current(spark, path, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "e.jsonl").write_text('{"query_id": "1", "question": "q", "expected_ids": ["a"]}\nbroken\n')
    assert [r.question for r in files.eval_set(spark, str(tmp_path / "e.jsonl")).collect()] == ["q"]
