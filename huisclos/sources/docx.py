"""Documents rewritten as tables: files become rows of paragraphs, and changed paragraphs go back into their files.

Paragraphs are cut out of the XML at byte offsets and put back there, so all that isn't changed stays as
it was, byte by byte. A changed paragraph keeps its own properties and the look of its first run.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import UNREADABLE

#: The format's namespace, its parts, and the properties that hold texts.
WORDS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
BODY, CORE = "word/document.xml", "docProps/core.xml"
PROPERTIES = ("creator", "lastModifiedBy", "title", "subject", "description", "keywords", "category")
#: Paragraphs in one file at most; positions are added to the file's place in its dossier.
MOST = 1 << 24
#: Characters of text that are handed on at once.
HANDED = 4 << 20
#: Names as the parser gives them, of elements that count.
_LOCAL = {f"{WORDS}|{name}": name for name in ("tbl", "p", "pPr", "r", "rPr", "t", "tab", "br", "cr")}


_TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")


def _tag_end(data: bytes, at: int) -> int:
    """Where the tag ends that begins at ``at``; ``>`` may stand in its quotes."""
    return _TAG.match(data, at).end()


@dataclass
class Piece:
    """A paragraph or property: bytes from ``start`` to ``end`` of ``part``, and what stays of them around a new text."""

    part: str
    start: int
    end: int
    text: str
    before: bytes
    after: bytes
    rank: int


def _paragraphs(data: bytes) -> list[Piece]:
    """Outermost paragraphs; rank 0 in the body, 1 in tables."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise ValueError("not UTF-8")
    found: list[Piece] = []
    parser = expat.ParserCreate(namespace_separator="|")
    parser.buffer_text = True
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    state = {"depth": 0, "tables": 0, "runs": 0, "in_text": False}
    now: dict = {}

    def began(name: str, _) -> None:
        local = _LOCAL.get(name)
        if local is None:
            return
        if local == "tbl":
            state["tables"] += 1
        elif local == "p":
            state["depth"] += 1
            if state["depth"] == 1:
                state["runs"] = 0
                now.clear()
                now.update(start=parser.CurrentByteIndex, text=[], props=b"", look=b"")
        elif state["depth"] == 1 and local == "pPr" and not now["props"]:
            now["props_at"] = parser.CurrentByteIndex
        elif state["depth"] and local == "r":
            state["runs"] += 1
        elif state["depth"] == 1 and local == "rPr" and state["runs"] == 1 and not now["look"]:
            now["look_at"] = parser.CurrentByteIndex
        elif state["depth"] and local == "t":
            state["in_text"] = True
        elif state["depth"] and local in marks and state["runs"]:
            now["text"].append(marks[local])

    def ended(name: str) -> None:
        local = _LOCAL.get(name)
        if local is None:
            return
        if local == "tbl":
            state["tables"] -= 1
        elif local == "pPr" and state["depth"] == 1 and "props_at" in now and not now["props"]:
            now["props"] = data[now["props_at"] : _tag_end(data, parser.CurrentByteIndex)]
        elif local == "rPr" and state["depth"] == 1 and state["runs"] == 1 and "look_at" in now and not now["look"]:
            now["look"] = data[now["look_at"] : _tag_end(data, parser.CurrentByteIndex)]
        elif local == "t":
            state["in_text"] = False
        elif local == "p":
            state["depth"] -= 1
            if state["depth"] == 0 and now["text"]:
                opening = data[now["start"] : _tag_end(data, now["start"])]
                mark = opening[1:].split(b":")[0] + b":" if b":" in opening.split()[0] else b""
                before = opening + now["props"] + b"<" + mark + b"r>" + now["look"] + b"<" + mark + b't xml:space="preserve">'
                after = b"</" + mark + b"t></" + mark + b"r></" + mark + b"p>"
                found.append(Piece(BODY, now["start"], _tag_end(data, parser.CurrentByteIndex), "".join(now["text"]), before, after, int(state["tables"] > 0)))

    parser.StartElementHandler, parser.EndElementHandler = began, ended
    parser.CharacterDataHandler = lambda chars: now["text"].append(chars) if state["in_text"] else None
    parser.Parse(data, True)
    return found


def _properties(data: bytes) -> list[Piece]:
    found: list[Piece] = []
    parser = expat.ParserCreate(namespace_separator="|")
    now: dict = {}

    def began(name: str, _) -> None:
        now.clear()
        if name.rpartition("|")[2] in PROPERTIES:
            now.update(start=_tag_end(data, parser.CurrentByteIndex), text=[])

    def ended(name: str) -> None:
        if "start" in now and now["text"]:
            found.append(Piece(CORE, now["start"], parser.CurrentByteIndex, "".join(now["text"]), b"", b"", 2))
        now.clear()

    parser.StartElementHandler, parser.EndElementHandler = began, ended
    parser.CharacterDataHandler = lambda chars: now["text"].append(chars) if "start" in now else None
    parser.Parse(data, True)
    return found


def _pieces(z: zipfile.ZipFile) -> list[Piece]:
    found = _paragraphs(z.read(BODY))
    if CORE in z.namelist():
        found += _properties(z.read(CORE))
    if len(found) >= MOST:
        raise ValueError("too many paragraphs")
    return sorted((p for p in found if p.text.strip()), key=lambda p: p.rank)


def pieces(content: bytes) -> list[Piece]:
    """What of a file holds text: paragraphs, those of tables after the others, then properties."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return _pieces(z)


def with_texts(content: bytes, changes: dict[int, str]) -> bytes:
    """The file with the pieces at these positions changed; each part is written once, other parts as they are."""
    source, target = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    by_part: dict[str, list[tuple[Piece, str]]] = {}
    for at, piece in enumerate(_pieces(source)):
        if at in changes:
            by_part.setdefault(piece.part, []).append((piece, changes[at]))
    with zipfile.ZipFile(target, "w") as z:
        for item in source.infolist():
            data = source.read(item)
            if item.filename in by_part:
                out, at = [], 0
                for piece, text in sorted(by_part[item.filename], key=lambda c: c[0].start):
                    out += (data[at : piece.start], piece.before, escape(text).encode(), piece.after)
                    at = piece.end
                data = b"".join((*out, data[at:]))
            z.writestr(item, data)
    return target.getvalue()


_READ = pa.schema([("dossier_id", pa.string()), ("seq", pa.int64()), ("position", pa.int64()), ("text", pa.string()), ("error_kind", pa.string())])


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """``files``: (dossier_id, seq, content). Returns (dossier_id, seq, position, text, error_kind): a row for each piece, or one with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

        for batch in batches:
            for dossier, seq, content in zip(*(batch.column(n).to_pylist() for n in ("dossier_id", "seq")), batch.column("content")):
                try:
                    found = [(dossier, seq, at, p.text, None) for at, p in enumerate(pieces(content.as_py()))]
                except Exception:  # any damage of a stranger's file is the same refusal
                    found = [(dossier, seq, None, None, UNREADABLE)]
                rows += found
                size += sum(len(r[3] or "") + 64 for r in found)
                if size > HANDED:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    return files.select("dossier_id", "seq", "content").mapInArrow(run, "dossier_id string, seq long, position long, text string, error_kind string")


def rewritten(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``files`` (dossier_id, seq, content, ...) with ``changes`` (dossier_id, seq, position, text) written into their contents."""
    listed = changes.groupBy("dossier_id", "seq").agg(F.collect_list(F.struct("position", "text")).alias("__c"))  # one file's paragraphs

    def write(contents: pa.Array, lists: pa.Array) -> pa.Array:
        made = []
        for content, found in zip(contents, lists):
            c = content.as_py()
            made.append(c if not found.is_valid else with_texts(c, dict(zip(*(found.values.field(n).to_pylist() for n in ("position", "text"))))))
        return pa.array(made, pa.binary())

    joined = files.join(listed, ["dossier_id", "seq"], "left")
    changed = F.when(F.col("__c").isNull(), F.col("content")).otherwise(F.arrow_udf(write, "binary")(F.col("content"), F.col("__c")))
    return joined.withColumn("content", changed).drop("__c")


def docx_of(paragraphs: list[str], cells: list[str] = (), title: str = "") -> bytes:
    """A plain document of paragraphs, then a table of one row of ``cells``."""
    para = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr></w:tbl>" if len(cells) else ""
    kinds = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{BODY}"/></Relationships>',
        BODY: f'<w:document xmlns:w="{WORDS}"><w:body>{"".join(map(para, paragraphs))}{table}</w:body></w:document>',
        CORE: f'<cp:coreProperties xmlns:cp="{kinds}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></cp:coreProperties>',
    }
    return _stored({name: text.encode() for name, text in parts.items()})  # without a date: equal texts make equal files


def _stored(parts: dict[str, bytes]) -> bytes:
    """A zip file of parts below 4 GB in all that are not compressed; an entry of ``zipfile`` takes ten times as long as a small part itself."""
    out, listed, at = [], [], 0
    for name, data in parts.items():
        own = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(name.encode()), 0)
        out += (b"PK\x03\x04", own, name.encode(), data)
        listed.append(b"PK\x01\x02" + struct.pack("<H", 20) + own + struct.pack("<HHHII", 0, 0, 0, 0, at) + name.encode())
        at += 4 + len(own) + len(name.encode()) + len(data)
    directory = b"".join(listed)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(parts), len(parts), len(directory), at, 0)
    return b"".join((*out, directory, end))
