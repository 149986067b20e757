"""A chat request from messages to the checked, re-identified reply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.repair import check_replies, restore_replies
from ..operators.rewrite import NUMBERED, reidentify
from ..operators.vault import known_placeholders
from ..sources.audit import events
from ..sources.connectors import echo_replies, with_system_prompt
from ..sources.requests import read_requests
from .materialize import written
from .pseudonymize import Protected, pseudonymize


def request_messages(protected: DataFrame) -> DataFrame:
    """(dossier_id, messages, sent, counts): a dossier's protected messages in order, with the prompt where needed."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", F.col("protected").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    tokens = F.flatten(F.collect_list(F.regexp_extract_all("protected", F.lit(NUMBERED), F.lit(0))))
    merged = protected.groupBy("dossier_id").agg(ordered.alias("messages"), F.array_sort(F.array_distinct(tokens)).alias("sent"))
    sized = merged.withColumn("messages", with_system_prompt(F.col("messages"))).withColumn("size", F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["content"])))
    return sized.join(merged_counts(protected, ["dossier_id"]), "dossier_id", "left")


def merged_counts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, counts): the texts' counts by type, summed."""
    sums = texts.select(*keys, F.explode("counts").alias("type", "n")).groupBy(*keys, "type").agg(F.sum("n").cast("int").alias("n"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))


def without_streaming(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose ``stream`` is false, audit rows of those that asked for a stream)."""
    asked = requests.where("stream").select("dossier_id", F.lit("stream_refused").alias("status"))
    return requests.withColumn("stream", F.lit(False)), events(asked)


def chat_response(answers: DataFrame, model: str | Column = "", models: DataFrame | None = None) -> DataFrame:
    """(dossier_id, response, error_kind): a chat completion's shape with the answer and the report on placeholders; no text where the back end failed. ``models`` may name each dossier's."""
    message = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.when(F.col("error_kind").isNull(), "stop").otherwise("error").alias("finish_reason"))
    named = answers if models is None else answers.join(models, "dossier_id")
    whole = F.struct(F.lit("chat.completion").alias("object"), (F.lit(model) if isinstance(model, str) else model).alias("model"), F.array(choice).alias("choices"), F.col("report"))
    return named.select("dossier_id", whole.alias("response"), "error_kind")


def converse(messages: DataFrame, policies: DataFrame | None = None, back_end: Callable[[DataFrame], DataFrame] = echo_replies, reidentified: bool = True) -> tuple[Protected, DataFrame]:
    """``messages``: (dossier_id, seq, role, text). ``back_end`` adds reply and error_kind to the last protected message of each dossier.

    The reply is repaired, checked against the dossier's placeholders, and re-identified only if it is sound.
    """
    done = pseudonymize(messages, policies)
    last = done.texts.groupBy("dossier_id").agg(F.max_by("protected", "seq").alias("protected"), F.max("seq").alias("seq"))
    requests = request_messages(done.texts)
    answers = written(back_end(last.join(requests.select("dossier_id", "sent", "size"), "dossier_id")).withColumn("text", F.col("reply")))
    known, keys = known_placeholders(done.canonical), ["dossier_id", "seq"]
    repaired = written(restore_replies(answers, known, keys))
    report = check_replies(repaired, repaired.select(*keys, F.explode("sent").alias("placeholder")), known, keys)
    sound = F.col("report.ok") & F.lit(reidentified)
    restored = reidentify(report, done.canonical, keys)
    return done, restored.withColumn("answer", F.when(sound, F.col("restored")).otherwise(F.col("text"))).drop("restored")


def converse_requests(documents: DataFrame, policies: DataFrame | None = None, back_end: Callable[[DataFrame], DataFrame] = echo_replies, reidentified: bool = True) -> tuple[DataFrame, DataFrame]:
    """``documents``: (dossier_id, raw), a dossier's one request. Returns (dossier_id, response, error_kind) for each and audit rows.

    A document that is no request, or has no message, is answered by its kind of error only; a stream that was asked for is answered whole.
    """
    read = written(read_requests(documents.select("dossier_id", "raw")))
    empty = F.size("request.messages") == 0
    told = written(read.withColumn("error_kind", F.when(empty, "RequeteInvalide").otherwise(F.col("error_kind"))))
    sound = told.where("error_kind IS NULL")
    _, trail = without_streaming(sound.select("dossier_id", F.col("request.stream").alias("stream")))
    messages = sound.select("dossier_id", F.posexplode("request.messages").alias("seq", "m")).select("dossier_id", F.col("seq").cast("long").alias("seq"), "m.role", F.col("m.content").alias("text"))
    _, answers = converse(messages, policies, back_end, reidentified)
    models = sound.select("dossier_id", F.col("request.model").alias("model"))
    shaped = chat_response(answers, F.col("model"), models).select("dossier_id", "response", "error_kind")
    refused = told.where("error_kind IS NOT NULL").select("dossier_id", F.lit(None).cast(shaped.schema["response"].dataType).alias("response"), "error_kind")
    failed = events(refused.select("dossier_id", F.lit("refused").alias("status"), "error_kind"))
    return shaped.unionByName(refused), trail.unionByName(failed)


def answer_view(done: Protected, mode: str = "serieux") -> DataFrame:
    """(dossier_id, seq, view): what a page shows of each text.

    view has mode, text, counts, detections, ambiguous, in_review. Values, placeholders and fake names are among the detections in the mode ``demo`` only.
    """
    if mode not in ("serieux", "demo"):
        raise ValueError(f"no mode {mode!r}")
    shown = ["type", "start", "end", "score"]
    spans = done.spans.where("placeholder IS NOT NULL")
    if mode == "demo":
        shown += ["surface", "placeholder"]
        if done.surrogates is not None:
            spans, shown = spans.join(done.surrogates, ["dossier_id", "placeholder"], "left"), [*shown, "surrogate"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", F.struct(*shown).alias("d")))), lambda x: x["d"])
    rows = spans.groupBy("dossier_id", "seq").agg(listed.alias("__d"))
    joined = done.texts.select("dossier_id", "seq", "protected", "counts", "in_review").join(rows, ["dossier_id", "seq"], "left")
    ambiguous = F.array().cast("array<string>")
    if done.people is not None:
        unclear = done.spans.where("type = 'PERSONNE'").join(done.people.where("ambiguous").select("dossier_id", "placeholder").distinct(), ["dossier_id", "placeholder"], "left_semi")
        joined = joined.join(unclear.groupBy("dossier_id", "seq").agg(F.array_sort(F.collect_set("placeholder")).alias("__a")), ["dossier_id", "seq"], "left")
        ambiguous = F.coalesce("__a", ambiguous)
    none = F.array().cast(rows.schema["__d"].dataType)
    view = F.struct(
        F.lit(mode).alias("mode"), F.col("protected").alias("text"), F.coalesce("counts", F.create_map().cast("map<string,int>")).alias("counts"), F.coalesce("__d", none).alias("detections"),
        ambiguous.alias("ambiguous"), F.coalesce("in_review", F.array().cast("array<string>")).alias("in_review"),
    )
    return joined.select("dossier_id", "seq", view.alias("view"))
