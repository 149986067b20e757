"""The judge as a pass: time-outs, refusals and recoveries, a re-run that asks only for what is missing, a service over HTTP."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from huisclos.operators.judge import PROMPT, judge_pass, read_judge
from huisclos.plans.job import options_from, run_job
from huisclos.sources.connectors import Calls, InvalidReply, Refused, Unavailable, ask, asked_in_order, complete_once, http_client

FOUND = json.dumps([{"segment": "le maire", "type_candidat": "fonction", "justification": "unique", "score": 0.8}])
TEXTS = "dossier_id string, seq long, protected string"


def flaky(log):
    """Answers by the text: 'tard' times out twice, 'non' is refused, 'bof' is no JSON. Counts its calls in a file."""

    def factory():
        seen = {}

        def client(messages):
            text = messages[-1]["content"]
            assert messages[0] == {"role": "system", "content": PROMPT}
            with open(log, "a") as f:
                f.write(text + "\n")
            seen[text] = seen.get(text, 0) + 1
            if "tard" in text and seen[text] < 3:
                raise TimeoutError(text)
            if "non" in text:
                raise Refused(text)
            if "jamais" in text:
                raise Unavailable(text)
            return "bof" if "bof" in text else FOUND

        return client

    return factory


def test_pass_survives_and_asks_once(spark, tmp_path):
    log, answers = tmp_path / "log", str(tmp_path / "answers")
    rows = [("A", 1, "vu le maire"), ("A", 2, "tard le maire"), ("A", 3, "non"), ("B", 1, "bof"), ("B", 2, "jamais"), ("B", 3, None), ("C", 1, "vu le maire")]
    texts = spark.createDataFrame(rows, TEXTS)
    calls = Calls(seconds=5, tries=3, pause=0.01)

    def run(df):
        return {(r["dossier_id"], r["seq"]): ([(p["start"], p["end"]) for p in r["located"]], r["n_unlocated"], r["error_kind"]) for r in judge_pass(df, flaky(log), ["dossier_id", "seq"], answers, model="m", calls=calls).collect()}

    want = {("A", 1): ([(3, 11)], 0, None), ("A", 2): ([(5, 13)], 0, None), ("A", 3): ([], 0, "Refused"), ("B", 1): ([], 0, "SortieJugeInvalide"), ("B", 2): ([], 0, "Unavailable"), ("B", 3): ([], 0, None), ("C", 1): ([(3, 11)], 0, None)}
    assert run(texts) == want
    asked = log.read_text().splitlines()
    assert sorted(asked) == sorted(["vu le maire", "bof", "non"] + ["tard le maire"] * 3 + ["jamais"] * 3)
    assert run(texts.unionByName(spark.createDataFrame([("D", 1, "neuf")], TEXTS))) == want | {("D", 1): ([], 1, None)}
    assert sorted(log.read_text().splitlines()[len(asked) :]) == sorted(["non", "neuf"] + ["jamais"] * 3)


def test_calls_are_bounded_and_in_order():
    now, most, lock = [0], [0], threading.Lock()
    gate = threading.Event()

    def client(messages):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        gate.wait(0.02)
        with lock:
            now[0] -= 1
        return messages[0]["content"]

    got = list(asked_in_order(client, [[{"role": "user", "content": str(i)}] for i in range(20)], Calls(at_once=3)))
    assert got == [(str(i), None) for i in range(20)] and 1 < most[0] <= 3
    slow = list(asked_in_order(lambda m: gate.wait(3) and "x", [[{}]], Calls(seconds=0.05, tries=1, pause=0.01)))
    assert slow == [(None, "TimeoutError")]
    assert ask(lambda m: 1 / 0, [], Calls(tries=5)) == (None, "ZeroDivisionError")


def test_keys_of_any_kind(spark, tmp_path):
    requests = spark.createDataFrame([(1, [("user", "a")]), (2, [("user", "b")])], "k int, messages array<struct<role:string,content:string>>")
    got = complete_once(requests, lambda: lambda m: m[0]["content"].upper(), "k", str(tmp_path / "x"))
    assert sorted(map(tuple, got.collect())) == [(1, "A", None), (2, "B", None)]


def test_calls_go_on_after_those_given_up():
    gate = threading.Event()
    client = lambda m: gate.wait(20) and "x" if m[0]["content"] == "jamais" else m[0]["content"]
    contents = ["jamais", "a", "jamais", "jamais", "b", "c", "jamais"]
    got = list(asked_in_order(client, [[{"role": "user", "content": c}] for c in contents], Calls(seconds=0.2, tries=1, pause=0.01, at_once=2)))
    gate.set()
    assert got == [(None, "TimeoutError") if c == "jamais" else (c, None) for c in contents]
    assert list(asked_in_order(client, [], Calls())) == []


def test_what_ends_a_call_ends_the_task():
    def client(messages):
        raise SystemExit(3)

    with pytest.raises(SystemExit):
        list(asked_in_order(client, [[]] * 3, Calls(at_once=2)))


def test_requests_are_made_once_and_dealt_to_all_tasks(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    def factory():
        number = TaskContext.get().partitionId()
        return lambda m: f"{number} {len(m)} {m[0]['content']}"

    rows = spark.range(40).mapInPandas(counted, "id long").groupBy("id").agg(F.lit("t").alias("t"))
    requests = rows.select("id", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"))
    got = complete_once(requests, factory, "id", str(tmp_path / "x"), before=({"role": "system", "content": "s"},)).collect()
    assert sorted(r["id"] for r in got) == list(range(40)) and {r["reply"][1:] for r in got} == {" 2 s"}
    assert {r["reply"][0] for r in got} == set("0123") and made.value == 40


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = asked["messages"][-1]["content"]
        code = int(text) if text.isdigit() else 200
        body = {"choices": [{"message": {"content": f"{asked['model']}|{self.headers['Authorization']}|{text}"}}]} if text != "vide" else {"choices": []}
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_a_service_over_http():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = http_client(f"http://127.0.0.1:{server.server_port}/v1/", "m", "t", 5)
    say = lambda text: client([{"role": "user", "content": text}])
    assert say("oui") == "m|Bearer t|oui"
    for text, kind in (("503", Unavailable), ("429", Unavailable), ("400", Refused), ("vide", InvalidReply)):
        with pytest.raises(kind) as e:
            say(text)
        assert "oui" not in str(e.value)
    server.shutdown()
    server.server_close()
    with pytest.raises(ConnectionError):
        say("oui")


def test_options_reach_the_job(spark, tmp_path):
    made = options_from({"HUISCLOS_JUDGE_URL": "http://localhost:1/v1", "HUISCLOS_JUDGE_MODEL": "m", "HUISCLOS_JUDGE_ANSWERS": str(tmp_path / "a"), "HUISCLOS_JUDGE_SCORE_MIN": "0.9"})
    docs = spark.createDataFrame([("A", 1, "le maire écrit à a@b.fr")], "dossier_id string, seq long, text string")
    seen = spark.sparkContext.accumulator(0)
    done = run_job(docs, made, judge_client=lambda: lambda m: FOUND if m[1]["content"] == "le maire écrit à [EMAIL_001]" else "faux")
    row = done.judged.first()
    assert row["error_kind"] is None and row["candidates"] == [] and seen.value == 0  # 0.8 is below the least score


@pytest.mark.parametrize(
    "raw, n",
    [
        ('[{"segment": "a", "type_candidat": "b", "justification": "c", "score": 1}]', 1),
        ('[{"segment": "a", "type_candidat": "b", "justification": "c", "score": 1.0e0}]', 1),
        ('[{"segment": "a", "type_candidat": "b", "justification": "c", "score": 0.50}, {"segment": "a", "type_candidat": "b", "justification": "c", "score": 0.7}]', 2),
        ('[{"segment": "a", "type_candidat": "b", "justification": "c", "score": null}]', None),
        ('[{"segment": "a", "type_candidat": "b", "justification": null, "score": 0.6}]', None),
        ('[{"segment": "a", "type_candidat": "b", "justification": "\\u00a0", "score": 0.6}]', None),
        ('[{"segment": "a", "segment": "a", "type_candidat": "b", "justification": "c", "score": 0.6}]', None),
        ('[{"segment": ["a"], "type_candidat": "b", "justification": "c", "score": 0.6}]', None),
        ('[{"segment": "a", "type_candidat": "b", "score": 0.6}]', None),
        ("[[]]", None), ("[null]", None), ("null", None), ('"x"', None), ("[1]", None), ("[{}]", None), ("[] x", None), ("", None), ("[]],[x", None), ("[]} x", None), ("[],", None), ("[],[]", None), (" [] \n", 0),
    ],
)
def test_strictness_without_python(spark, raw, n):
    read = read_judge(spark.createDataFrame([(raw,)], "raw string"))
    row = read.first()
    assert (len(row["candidates"]), row["error_kind"]) == ((n or 0), None if n is not None else "SortieJugeInvalide")
    assert "Python" not in read._jdf.queryExecution().toString().replace("LogicalRDD", "")
    assert read.where(F.lit(True)).count() == 1


ITEM = {"segment": "a", "type_candidat": "b", "justification": "c", "score": 0.5}


def test_a_reply_is_parsed_once_and_each_item_is_whole(spark):
    without = lambda *keys: {k: v for k, v in ITEM.items() if k not in keys}
    good = [[ITEM, ITEM | {"score": 1}], [dict(reversed(ITEM.items()))], []]
    bad = [
        [ITEM, without("segment")], [ITEM, ITEM | {"more": 1}], [ITEM, None], [None], [ITEM, 1], [ITEM, ITEM | {"segment": 1}], [ITEM, ITEM | {"score": None}], [ITEM, ITEM | {"score": "1"}], [ITEM, ITEM | {"score": 2}],
        [without("justification", "score") | {"justification: STRING, score": 0.5}], [ITEM | {"segment": " "}],
    ]
    raws = [(n, json.dumps(r), True) for n, r in enumerate(good)] + [(n, json.dumps(r), False) for n, r in enumerate(bad, 100)]
    raws += [(n, "[]" + end, False) for n, end in enumerate([',""]', ',"x"]', "]", "]} x", ',"a":1', ",[]"], 200)]
    read = read_judge(spark.createDataFrame(raws, "n int, raw string, ok boolean"))
    assert {r["n"]: r["error_kind"] is None for r in read.collect()} == {n: ok for n, _, ok in raws}
    assert read._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
