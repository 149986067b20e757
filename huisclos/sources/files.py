"""Text of uploaded files; refusals are rows with an error kind, not exceptions."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted suffixes, error kinds and the document format's namespace.
PLAIN, RICH = (".txt", ".md", ".csv"), (".docx", ".pdf")
UNSUPPORTED, UNREADABLE, NO_TEXT = "FormatNonSupporte", "FichierIllisible", "PdfSansTexte"
NAMESPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_TEXT, _MARKS = f"{NAMESPACE}t", {f"{NAMESPACE}tab": "\t", f"{NAMESPACE}br": "\n", f"{NAMESPACE}cr": "\n"}


def _paragraph(p: ElementTree.Element) -> str:
    return "".join([e.text or "" if e.tag == _TEXT else _MARKS.get(e.tag, "") for e in p.iter()])


def docx_text(content: bytes) -> str:
    """Paragraphs, then all table rows with tabs between cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{NAMESPACE}body")
    lines = [_paragraph(p) for p in body.findall(f"{NAMESPACE}p")]
    for row in body.findall(f"{NAMESPACE}tbl/{NAMESPACE}tr"):
        lines.append("\t".join("\n".join(_paragraph(p) for p in c.findall(f"{NAMESPACE}p")) for c in row.findall(f"{NAMESPACE}tc")))
    return "\n".join(lines)


def pdf_text(content: bytes) -> str:
    """Pages joined by newlines; needs the optional ``pypdf``."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def _rich_texts(content: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    def one(data: bytes | None, kind: str) -> tuple[str | None, str | None]:
        if data is None:
            return None, UNREADABLE if kind in RICH else None
        try:
            text = docx_text(data) if kind == ".docx" else pdf_text(data)
        except ImportError:
            return None, UNSUPPORTED
        except Exception:  # any damage of a stranger's file is the same refusal
            return None, UNREADABLE
        return (None, NO_TEXT) if kind == ".pdf" and not text.strip() else (text, None)

    return pd.DataFrame([one(c, s) for c, s in zip(content, suffix)], columns=["text", "error_kind"])


def extract(files: DataFrame) -> DataFrame:
    """``files``: (path, content). Plus suffix, text, error_kind. CSV is read as raw text; bytes that aren't UTF-8 as Latin-1."""
    suffix = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    plain = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    known = files.withColumn("suffix", suffix)
    # contents of other kinds stay out of Python
    rich = F.when(F.col("suffix").isin(*RICH), F.col("content"))
    read = known.withColumn("__r", F.pandas_udf(_rich_texts, "struct<text:string,error_kind:string>")(rich, F.col("suffix")))
    kind = lambda a, b, c: F.when(F.col("suffix").isin(*PLAIN), a).when(F.col("suffix").isin(*RICH), b).otherwise(c)
    nothing = F.lit(None).cast("string")
    return read.withColumn("text", kind(plain, F.col("__r.text"), nothing)).withColumn("error_kind", kind(nothing, F.col("__r.error_kind"), F.lit(UNSUPPORTED))).drop("__r")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return extract(spark.read.format("binaryFile").load(path).select("path", "content"))
