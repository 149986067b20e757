"""Model back ends as partition functions; the client is injected, so tests need no network."""

from __future__ import annotations

import ipaddress
import json
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import spread, written

Client = Callable[[list[dict]], str]
#: Fixed value: what a model is told when placeholders stand in the payload.
KEEP_TOKENS = "Les jetons entre crochets comme [PERSONNE_001] remplacent des données confidentielles. Reprends-les à l'identique, sans les modifier ni les traduire."


def echo_replies(requests: DataFrame, text: str = "protected") -> DataFrame:
    """A back end that answers with what it was sent."""
    return requests.withColumn("reply", F.col(text)).withColumn("error_kind", F.lit(None).cast("string"))


class Unavailable(Exception):
    """The back end is there and can't answer now."""


class Refused(Exception):
    """The back end won't answer this."""


class InvalidReply(Exception):
    """What came back is no completion."""


#: Failures that may pass.
PASSING = (TimeoutError, ConnectionError, Unavailable)


@dataclass(frozen=True)
class Calls:
    """``seconds`` until an answer must be there, ``tries`` in all, ``pause`` before the second one (then doubled), ``at_once`` in a task."""

    seconds: float = 120.0
    tries: int = 3
    pause: float = 1.0
    at_once: int = 4


def http_client(url: str, model: str, token: str = "", seconds: float = 120.0, temperature: float | None = 0) -> Client:
    """A client for a chat-completions service; what it raises says nothing of the payload."""

    def client(messages: list[dict]) -> str:
        payload = {"model": model, "messages": messages} | ({} if temperature is None else {"temperature": temperature})
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(payload).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=seconds) as answer:
                body = answer.read()
        except urllib.error.HTTPError as e:
            raise (Unavailable if e.code >= 500 or e.code in (408, 425, 429) else Refused)(str(e.code)) from None
        except urllib.error.URLError as e:
            raise (TimeoutError() if isinstance(e.reason, TimeoutError) else ConnectionError()) from None
        try:
            content = json.loads(body)["choices"][0]["message"]["content"]
        except (ValueError, LookupError, TypeError):
            raise InvalidReply() from None
        if not isinstance(content, str):
            raise InvalidReply()
        return content

    return client


def ask(client: Client, messages: list[dict], calls: Calls) -> tuple[str | None, str | None]:
    """(reply, kind of failure): one is null. Failures that may pass are tried again after a pause."""
    kind = None
    for n in range(calls.tries):
        if n:
            time.sleep(calls.pause * 2 ** (n - 1))
        try:
            return client(messages), None
        except Exception as e:  # the kind only: a message may quote the payload
            kind = type(e).__name__
            if not isinstance(e, PASSING):
                break
    return None, kind


class _Caller(threading.Thread):
    """Takes turns from ``turns`` until none is left, then leaves ``under_way``. Only the one that watches it contends for its lock."""

    def __init__(self, client: Client, calls: Calls, turns: deque, answers: list, under_way: set[_Caller], changed: threading.Condition) -> None:
        super().__init__(daemon=True)
        self.client, self.calls, self.turns, self.answers, self.under_way, self.changed = client, calls, turns, answers, under_way, changed
        self.own, self.since, self.lost = threading.Lock(), time.monotonic(), False

    def run(self) -> None:
        i, answer = None, None
        while True:
            with self.own:
                if self.lost:
                    return
                if i is not None:
                    self.answers[i] = answer
                try:
                    i, messages = self.turns.popleft()
                except IndexError:
                    break
                self.since = time.monotonic()
            try:
                answer = ask(self.client, messages, self.calls)
            except BaseException as e:  # raised by the thread that reads the answers
                answer = e
        with self.changed:
            self.under_way.discard(self)
            self.changed.notify()

    def given_up(self, most: float) -> bool:
        with self.own:
            self.lost = self.lost or self.since + most <= time.monotonic()
            return self.lost


def asked_in_order(client: Client, requests: list[list[dict]], calls: Calls) -> Iterator[tuple[str | None, str | None]]:
    """Answers in the order of ``requests``, at most ``at_once`` under way. A call that doesn't come back in time is given up; another thread goes on in its place.

    Threads take the next request themselves: a future for each call costs several times what a quick client does.
    """
    most = calls.seconds * calls.tries + calls.pause * 2**calls.tries
    answers: list = [(None, "TimeoutError")] * len(requests)
    turns, under_way, changed = deque(enumerate(requests)), set(), threading.Condition()
    more = lambda: _Caller(client, calls, turns, answers, under_way, changed)
    try:
        with changed:
            under_way |= {more() for _ in range(min(calls.at_once, len(requests)))}
            for caller in under_way:
                caller.start()
            while under_way:
                changed.wait(max(0.0, min(c.since for c in under_way) + most - time.monotonic()))
                for caller in [c for c in under_way if c.given_up(most)]:
                    under_way.remove(caller)
                    if turns:
                        under_way.add(other := more())
                        other.start()
    finally:
        turns.clear()
    for answer in answers:
        if isinstance(answer, BaseException):
            raise answer
        yield answer


def _conversations(messages: pa.Array, before: tuple[dict, ...]) -> list[list[dict]]:
    """Each row's messages after ``before``."""
    flat = messages.flatten()
    told = [{"role": r, "content": c} for r, c in zip(*(pc.struct_field(flat, f).to_pylist() for f in ("role", "content")))]
    ends = list(accumulate(pc.list_value_length(messages).to_pylist(), initial=0))
    return [[*map(dict, before), *told[i:j]] for i, j in zip(ends, ends[1:])]


def _complete(requests: DataFrame, client_factory: Callable[[], Client], key: str, calls: Calls, before: tuple[dict, ...]) -> DataFrame:
    """``requests``: (``key``, messages, reply, __had). Where __had is true the reply stands and nothing is asked. Returns (``key``, reply, error_kind, __had)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()
        for batch in batches:
            had = batch.column("__had")
            missing = pc.invert(had)
            answers = asked_in_order(client, _conversations(batch.column("messages").filter(missing), before), calls)
            replies, kinds = zip(*((r, None) if h else next(answers) for h, r in zip(had.to_pylist(), batch.column("reply").to_pylist()))) if len(had) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(replies, pa.string()), pa.array(kinds, pa.string()), had], [key, "reply", "error_kind", "__had"])

    kind = dict(requests.dtypes)[key]
    return requests.select(key, "messages", "reply", "__had").mapInArrow(run, f"{key} {kind}, reply string, error_kind string, __had boolean")


def complete(requests: DataFrame, client_factory: Callable[[], Client], key: str = "conv_id", calls: Calls = Calls()) -> DataFrame:
    """``requests``: (``key``, messages array<struct<role,content>>). Returns (``key``, reply, error_kind). One client a task; failures become error kinds without payload."""
    return _complete(requests.withColumns({"reply": F.lit(None).cast("string"), "__had": F.lit(False)}), client_factory, key, calls, ()).drop("__had")


def complete_once(requests: DataFrame, client_factory: Callable[[], Client], key: str, answers_at: str, calls: Calls = Calls(), before: tuple[dict, ...] = ()) -> DataFrame:
    """``complete`` for requests that have no answer in the folder ``answers_at`` yet; new answers are added to it, failures are not.

    A run after a lost one, or over more requests, asks only for what is missing. One run at a time writes to a folder.
    Messages that all requests begin with go in ``before``: they are no part of any row.
    """
    spark, kind = requests.sparkSession, dict(requests.dtypes)[key]
    shape = f"{key} {kind}, reply string"
    requests.limit(0).select(key, F.lit(None).cast("string").alias("reply")).write.mode("append").parquet(answers_at)  # so that a first run finds a table
    had = spread(spark.read.schema(shape).parquet(answers_at).dropDuplicates([key]).withColumn("__had", F.lit(True)))
    told = requests.select(key, "messages").join(had, key, "left").withColumn("__had", F.coalesce("__had", F.lit(False)))
    # dealt anew: Spark makes as few tasks as bytes ask for, and answers take longer than bytes tell
    dealt = told.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), F.xxhash64(key))
    made = written(_complete(dealt, client_factory, key, calls, before))
    made.where("NOT __had AND error_kind IS NULL").select(key, "reply").write.mode("append").parquet(answers_at)
    return made.drop("__had")


def with_system_prompt(messages, prompt: str = KEEP_TOKENS):
    """Put the prompt first, only where a placeholder stands in a message."""
    needed = F.exists(messages, lambda m: m["content"].rlike(r"\[[A-Z_]+_\d{3,}\]"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    return F.when(needed, F.concat(first, messages)).otherwise(messages)


@dataclass(frozen=True)
class Options:
    """Job options, checked where they are made; empty strings count as absent."""

    policies: dict[str, str] = field(default_factory=dict)
    engine: str = ""
    engine_threshold: float = 0.5
    judge_url: str = ""
    judge_model: str = ""
    judge_score_min: float = 0.5
    judge_answers: str = ""
    coreference: bool = False
    surrogates: bool = False
    vault_path: str = ""
    vault_key: str = field(default="", repr=False)
    vault_key_file: str = ""

    def __post_init__(self) -> None:
        for name in ("engine_threshold", "judge_score_min"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in [0, 1]")
        if self.vault_key and self.vault_key_file or bool(self.vault_path) != bool(self.vault_key or self.vault_key_file):
            raise ValueError("vault_path comes with either vault_key or vault_key_file")
        if not bool(self.judge_url) == bool(self.judge_model) == bool(self.judge_answers):
            raise ValueError("judge_url, judge_model and judge_answers (a folder) come together")
        if self.judge_url and not private_host(self.judge_url):
            raise ValueError("the judge must run on a private host")


def private_host(url: str) -> bool:
    host = url.split("://")[-1].split("/")[0].rsplit("@", 1)[-1]
    host = host[1:].split("]")[0] if host.startswith("[") else host.split(":")[0]
    if host == "localhost":
        return True
    try:
        return ipaddress.ip_address(host).is_private
    except ValueError:
        return False
