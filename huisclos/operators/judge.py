"""Strict reading of a judge model's replies, and where its segments lie."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import let
from ..functions.strict_json import whole_json
from ..sources.connectors import Calls, Client, complete_once
from .rewrite import NUMBERED

#: Fixed value: the keys of a candidate, all of them and no other.
FIELDS = ("segment", "type_candidat", "justification", "score")
CANDIDATES = "array<struct<segment:string,type_candidat:string,justification:string,score:double>>"
#: How Spark writes the schema of a list of such objects; it puts other names in backquotes.
SHAPE = r"^ARRAY<(VOID|OBJECT<justification: STRING, score: (BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+, ?\d+\)), segment: STRING, type_candidat: STRING>)>$"
INVALID = "SortieJugeInvalide"
#: What the judge is asked for.
PROMPT = (
    "Tu relis un texte dont les données personnelles ont été remplacées par des jetons comme [PERSONNE_001]. "
    "Cherche ce qui permettrait encore de reconnaître une personne : une fonction rare, un lieu précis, un événement unique, un lien de parenté, un recoupement. "
    "Ne signale jamais un jeton. Réponds seulement par une liste JSON, vide s'il n'y a rien. Chaque élément a exactement quatre clés : "
    '"segment" (copié mot pour mot du texte), "type_candidat", "justification" et "score" (de 0 à 1).'
)


def cleaned(raw: Column) -> Column:
    """Without a leading reasoning block and without one code fence around everything."""
    unfenced = lambda t: let(F.regexp_extract(t, r"(?s)^\s*```[a-zA-Z]*\s*(.*?)\s*```\s*$", 1), lambda inner: F.when(inner != "", inner).otherwise(t))
    return let(F.regexp_replace(raw, r"(?s)^\s*<think>.*?</think>", ""), unfenced)


def items_of(raw: Column) -> Column:
    """The candidates of a reply's JSON list; null where anything in it is not as it must be.

    Each is an object of exactly the four keys, each once, with three texts that are not blank and a number from 0 to 1.
    """

    def sound(c: Column) -> Column:
        whole = c["score"].between(0, 1)
        for f in FIELDS[:3]:
            whole = whole & c[f].rlike(r"(?U)\S")
        return F.coalesce(whole, F.lit(False))

    # one schema of all items: a key too many or a type that isn't its key's shows there, a missing one as a null in its item
    listed = let(whole_json(raw), lambda v: F.when(F.schema_of_variant(v).rlike(SHAPE), F.try_variant_get(v, "$", CANDIDATES)))
    return let(listed, lambda items: F.when(F.forall(items, sound), items))


def read_judge(outputs: DataFrame, raw: str = "raw", score_min: float = 0.5) -> DataFrame:
    """``outputs`` plus candidates and error_kind. One violation rejects the whole reply.

    Candidates below ``score_min`` and those that only name a placeholder are dropped.
    """
    read = outputs.withColumn("candidates", items_of(cleaned(F.col(raw))))
    read = read.withColumn("error_kind", F.when(F.col("candidates").isNull(), INVALID))
    bare = rf"^\s*{NUMBERED}\s*$"
    kept = F.filter("candidates", lambda c: (c["score"] >= score_min) & ~c["segment"].rlike(bare))
    return read.withColumn("candidates", F.coalesce(kept, F.array().cast(CANDIDATES)))


def locate(read: DataFrame, text: str, details: bool = False) -> DataFrame:
    """Plus located (start, end, type, score; first occurrence) and n_unlocated. Only ``details`` lets prose out."""

    def place(c: Column) -> Column:
        start = (F.instr(F.col(text), c["segment"]) - 1).cast("int")
        fields = [start.alias("start"), (start + F.length(c["segment"])).alias("end"), c["type_candidat"].alias("type_candidat"), c["score"].alias("score")]
        return F.struct(*fields, *([c["segment"].alias("segment"), c["justification"].alias("justification")] if details else []))

    placed = F.transform("candidates", place)
    found = F.filter(placed, lambda p: p["start"] >= 0)
    return read.withColumn("located", found).withColumn("n_unlocated", F.size("candidates") - F.size("located"))


def judge_input(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Only a conversation's last message goes to the judge."""
    return messages.groupBy(key).agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def judge_pass(texts: DataFrame, client_factory: Callable[[], Client], keys: list[str], answers_at: str, text: str = "protected", model: str = "", calls: Calls = Calls(60.0), score_min: float = 0.5) -> DataFrame:
    """``texts`` plus candidates, located, n_unlocated and error_kind. ``answers_at``: the folder of raw answers, so a text is asked about once.

    A pass that fails anywhere leaves the text without candidates and with the kind of the failure; nothing else stops. A later run asks
    only about texts that have no answer yet from this model and prompt. Equal texts are asked about once.
    """
    asked = texts.withColumn("__judged", F.sha2(F.concat_ws("\n", F.lit(model), F.lit(PROMPT), F.col(text)), 256))
    wanted = asked.where(F.col(text).isNotNull()).groupBy("__judged").agg(F.first(text).alias("t"))
    requests = wanted.select("__judged", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"))
    replies = complete_once(requests, client_factory, "__judged", answers_at, calls, ({"role": "system", "content": PROMPT},))
    read = read_judge(replies.withColumnRenamed("error_kind", "__failed"), "reply", score_min)
    told = read.select("__judged", "candidates", F.coalesce("__failed", "error_kind").alias("error_kind"))
    none = F.array().cast(CANDIDATES)
    joined = asked.join(told, "__judged", "left").withColumn("candidates", F.coalesce("candidates", none)).drop("__judged")
    return locate(joined, text).select(*texts.columns, "candidates", "located", "n_unlocated", "error_kind")
