"""Batches, retries, errors by row and the store of answers, with stubs and an HTTP server on this machine."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from pyspark import cloudpickle

from plumbline.operators import facts, models, perturb

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def backend(client, name="stub", **options):
    models._CLIENTS.clear()
    return models.Backend(name, lambda: client, **{"wait": 0.0, **options})


def test_retries_and_errors_of_single_prompts():
    calls = []

    def client(prompts):
        calls.append(len(prompts))
        if len(calls) == 1:
            raise TimeoutError("slow")
        return [ValueError("no") if p == "bad" else p.upper() for p in prompts]

    assert models._tried(backend(client), ["a", "bad", "b"]) == [("A", None, 2), (None, "ValueError: no", 3), ("B", None, 2)]
    assert calls == [3, 3, 1]  # the second retry asks for the failed prompt only


def test_a_poisoned_batch_is_asked_one_by_one():
    def client(prompts):
        if "poison" in prompts:
            raise RuntimeError("crash")
        return [p + "!" for p in prompts]

    got = models._tried(backend(client, attempts=2), ["a", "poison", "b"])
    assert [(a, e) for a, e, _ in got] == [("a!", None), (None, "RuntimeError: crash"), ("b!", None)]


def test_wrong_number_of_answers_and_waiting(monkeypatch):
    waited = []
    monkeypatch.setattr(models.time, "sleep", waited.append)
    got = models._tried(backend(lambda prompts: [], attempts=4, wait=0.5), ["a"])
    assert got == [(None, "ValueError: 0 answers for 1 prompts", 4)] and waited == [0.5, 1.0, 2.0]


class Logged:
    """Answers and writes down what it was asked, in a folder that all workers share."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, prompts):
        import uuid

        (self.folder / uuid.uuid4().hex).write_text(json.dumps(prompts))
        return [ConnectionError("down") if "down" in p else p[::-1] for p in prompts]


def test_distinct_prompts_are_asked_once_and_stored(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def opened():
        return Logged(asked)

    own = models.Backend("logged", opened, batch=3, attempts=2, wait=0.0)
    store = models.AnswerStore(spark, str(tmp_path / "store"))
    rows = [(i, "p%d" % (i % 5), i) for i in range(40)] + [(50, None, 1), (51, "down", 2), (52, "", 3)]
    df = spark.createDataFrame(rows, "id int, prompt string, answers int").repartition(3)
    got = {r["id"]: (r["answer"], r["error"]) for r in models.with_answers(df, F.col("prompt"), own, store).collect()}
    assert len(got) == 43 and got[7] == ("2p", None) and got[50] == (None, None) and got[52] == ("", None) and got[51] == (None, "ConnectionError: down")
    seen = [p for f in asked.iterdir() for p in json.loads(f.read_text())]
    assert sorted(set(seen)) == ["", "down", "p0", "p1", "p2", "p3", "p4"] and len(seen) == 8  # the failed one twice
    before = len(list(asked.iterdir()))
    again = models.with_answers(df.where("id <> 51"), F.col("prompt"), own, store)
    assert {r["id"]: (r["answer"], r["error"]) for r in again.collect()} == {i: x for i, x in got.items() if i != 51}
    assert len(list(asked.iterdir())) == before  # the second run asks nothing
    models.with_answers(df, F.col("prompt"), own, store).count()
    assert len(list(asked.iterdir())) == before + 2  # failed prompts are asked again
    other = models.with_answers(df.limit(1), F.col("prompt"), models.Backend("another model", opened, wait=0.0), store)
    assert other.count() == 1 and len(list(asked.iterdir())) > before + 2


def test_empty_table_and_column_names(spark, tmp_path):
    own = models.Backend("stub", lambda: lambda prompts: prompts, wait=0.0)
    df = spark.createDataFrame([], "key string, prompt string")
    assert models.with_answers(df, F.col("prompt"), own).count() == 0
    df = spark.createDataFrame([("k", "p")], "key string, prompt string")
    assert models.with_answers(df, F.col("prompt"), own).select("key", "answer").first() == ("k", "p")


class Judge:
    def __call__(self, prompts):
        return [RuntimeError("down") if "added" in p else json.dumps({"plausible": "removed" not in p}) for p in prompts]


def test_a_model_judges_changes(spark):
    edge = "struct<fact_type:string,original_value:string,perturbed_value:string,description:string>"
    rows = [(1, ("Evidence", "FIR", "", "FIR removed")), (2, ("Evidence", "FIR", "", "FIR removed")), (3, ("Section", "a", "b", "Section changed")), (4, ("Evidence", "", "x", "x added"))]
    found = spark.createDataFrame(rows, f"tree_id int, edge {edge}")
    got = {r["tree_id"]: (r["accepted"], r["verdict"]["reasoning"]) for r in perturb.validated(found, backend=models.Backend("judge", Judge, wait=0.0)).collect()}
    assert got == {1: (False, ""), 2: (False, ""), 3: (True, ""), 4: (True, perturb.NO_ANSWER)}


class Extractor:
    def __call__(self, prompts):
        return ['{"case_id": "", "outcome": "x"}' if p.startswith("again") or "easy" in p else "no idea" if "hard" in p else OSError("gone") for p in prompts]


def test_a_model_fills_sheets(spark):
    df = spark.createDataFrame([(1, "easy"), (2, "hard"), (3, "lost")], "case_id int, facts string")
    own = models.Backend("extractor", Extractor, attempts=1, wait=0.0)
    once = {r["case_id"]: (r["sheet"] and r["sheet"]["case_id"], r["error"]) for r in facts.sheets_by_model(df, own).collect()}
    assert once == {1: ("1", None), 2: (None, None), 3: (None, "OSError: gone")}
    twice = facts.sheets_by_model(df, own, second=lambda t: F.when(t == "hard", F.concat(F.lit("again "), t))).collect()
    assert {r["case_id"]: (r["sheet"] and r["sheet"]["case_id"], r["error"]) for r in twice} == {1: ("1", None), 2: ("2", None), 3: (None, "OSError: gone")}


def test_chat_over_http(spark, monkeypatch):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][0]["content"]
            ok = self.path == "/v1/chat/completions" and self.headers["Authorization"] == "Bearer k" and "bad" not in said
            self.send_response(200 if ok else 500)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": f"{body['model']}: {said}"}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        monkeypatch.setenv("STUB_KEY", "k")
        own = models.chat_client(f"http://127.0.0.1:{server.server_port}/v1/", "m", "STUB_KEY", timeout=10)
        good, bad = own()(["hello", "bad"])
        assert good == "m: hello" and "500" in str(bad)
    finally:
        server.shutdown()


@pytest.mark.parametrize("attempts", [1, 3])
def test_a_client_that_never_opens(attempts):
    def fail():
        raise ImportError("no model here")

    models._CLIENTS.clear()
    assert models._tried(models.Backend("none", fail, attempts=attempts, wait=0.0), ["a", "b"]) == [(None, "ImportError: no model here", attempts)] * 2
