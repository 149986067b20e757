"""Documents as tables: what is changed, what stays byte by byte, what is refused."""

import io
import re
import zipfile

from huisclos.plans.files import pseudonymize_docx
from huisclos.sources.docx import docx_of, pieces, with_texts
from huisclos.sources.files import docx_text, extract

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:x="urn:x>y"'
BODY = (
    f'<?xml version="1.0" encoding="UTF-8"?><w:document {NS}><w:body>'
    '<w:p w:a="1>2"><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Écrire à a@</w:t></w:r><w:r><w:t>b.fr &amp; c</w:t></w:r></w:p>'
    '<w:p><w:r><w:rPr><w:i/></w:rPr><w:t>rien  ici</w:t><w:tab/></w:r></w:p><w:p/>'
    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a@b.fr</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    '<w:p><w:r><w:t>dehors z@b.fr</w:t></w:r><w:r><x:box><w:p><w:r><w:t> dedans</w:t></w:r></w:p></x:box></w:r></w:p></w:body></w:document>'
)
CORE = '<c:coreProperties xmlns:c="urn:c" xmlns:dc="urn:dc"><dc:title>Pour z@b.fr</dc:title><dc:other>z@b.fr</dc:other></c:coreProperties>'


def packed(body=BODY, core=CORE):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/media/i.png", bytes(range(256)))
        z.writestr("word/document.xml", body)
        z.writestr("docProps/core.xml", core)
    return out.getvalue()


def part(content, name):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read(name)


def test_pieces_in_order_and_nothing_else_changes():
    found = pieces(packed())
    assert [p.text for p in found] == ["Écrire à a@b.fr & c", "rien  ici\t", "dehors z@b.fr dedans", "a@b.fr", "x", "Pour z@b.fr"]
    body = part(with_texts(packed(), {0: "vu <1>"}), "word/document.xml").decode()
    changed = '<w:p w:a="1>2"><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">vu &lt;1&gt;</w:t></w:r></w:p>'
    assert body == re.sub(r'<w:p w:a.*?</w:p>', changed.replace("\\", r"\\"), BODY, count=1)
    same = with_texts(packed(), {})
    assert all(part(same, n) == part(packed(), n) for n in ("word/media/i.png", "word/document.xml", "docProps/core.xml"))
    assert docx_text(docx_of(["un", "a < b & c"], ["c", "d"], "t")) == "un\na < b & c\nc\td"


def test_files_through_the_table(spark):
    files = [("A", 1, "/a.docx", packed()), ("A", 2, "/b.docx", packed().replace(b"PK", b"XX")), ("A", 3, "/c.docx", docx_of(["z@b.fr", "rien"])), ("B", 1, "/d.docx", docx_of([])), ("B", 2, "/e.docx", None)]
    done, protected = pseudonymize_docx(spark.createDataFrame(files, "dossier_id string, seq long, path string, content binary"))
    got = {r["path"]: r for r in done.collect()}
    assert part(got["/a.docx"]["content"], "word/document.xml").decode().count("[EMAIL_001]") == 2
    assert b"<dc:title>Pour [EMAIL_002]</dc:title><dc:other>z@b.fr" in part(got["/a.docx"]["content"], "docProps/core.xml")
    assert got["/a.docx"]["counts"] == {"EMAIL": 4} and part(got["/a.docx"]["content"], "word/media/i.png") == bytes(range(256))
    assert got["/b.docx"]["error_kind"] == got["/e.docx"]["error_kind"] == "FichierIllisible" and got["/b.docx"]["content"] == files[1][3]
    assert got["/d.docx"]["content"] == files[3][3] and got["/d.docx"]["counts"] is None
    texts = {r["path"]: r["text"] for r in extract(done.select("path", "content")).collect()}
    assert texts["/c.docx"] == "[EMAIL_002]\nrien" and texts["/a.docx"].startswith("Écrire à [EMAIL_001] & c\nrien  ici")
    assert protected.canonical.count() == 2
