"""Files in, files out: documents whose paragraphs are pseudonymized as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.docx import MOST, docx_paragraphs, rewritten
from .conversation import merged_counts
from .materialize import written
from .pseudonymize import Protected, pseudonymize

FILE = ["dossier_id", "seq"]


def pseudonymize_docx(files: DataFrame, policies: DataFrame | None = None, **options) -> tuple[DataFrame, Protected]:
    """``files``: (dossier_id, seq, content, ...), seq the order of arrival in a dossier, unique in it.

    Returns the files with contents rewritten, counts by type of the whole file and error_kind, and what
    ``pseudonymize`` gives for their paragraphs, whose seq is the file's and their place in it. Damaged files
    come back as they are with an error_kind. ``options`` are those of ``pseudonymize``.
    """
    read = written(docx_paragraphs(files))
    texts = read.where("error_kind IS NULL").select("dossier_id", (F.col("seq") * MOST + F.col("position")).alias("seq"), "text")
    done = pseudonymize(texts, policies, **options)
    placed = written(done.texts.select("dossier_id", F.floor(F.col("seq") / MOST).alias("seq"), (F.col("seq") % MOST).alias("position"), "text", "protected", "counts"))
    changed = placed.where("protected <> text").select(*FILE, "position", F.col("protected").alias("text"))
    counts = merged_counts(placed.where("counts IS NOT NULL"), FILE)
    broken = read.where("error_kind IS NOT NULL").select(*FILE, "error_kind")
    return rewritten(files, changed).join(counts, FILE, "left").join(broken, FILE, "left"), done
