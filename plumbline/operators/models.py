"""Answers of a model for prompts in a table: one client per worker, batches, retries, errors by row, and a store.

A backend is a function that opens a client and how to treat it; the client maps a list of prompts to a list of answers
and may put an exception in the place of one. Every distinct prompt is asked once, whatever the number of rows that
have it: prompts are reduced to distinct keys (a hash of the backend's name and the prompt), keys that the store knows are
anti-joined away, and what is left is dealt out over the tasks. Answers are staged before they are joined back, so a lost
executor asks its unfinished batches again and nothing else; good answers are appended to the store, failed ones are not,
so that the next run asks them again.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import by_key, path_exists, python_ready, staged

Client = Callable[[list[str]], "list[str | Exception]"]


@dataclass(frozen=True)
class Backend:
    """``open`` makes a client, once per worker and again after a failure of a whole batch; ``name`` tells models and versions apart.

    A failed prompt is asked up to ``attempts`` times; ``wait`` seconds pass before the second time, and twice as long
    before each further one. Prompts that fail together are asked one by one in the end.
    """

    name: str
    open: Callable[[], Client]
    batch: int = 16
    attempts: int = 3
    wait: float = 0.5


#: Clients of this worker by the backend's name.
_CLIENTS: dict[str, Client] = {}


def _tried(backend: Backend, prompts: list[str]) -> list[tuple[str | None, str | None, int]]:
    """Answer, error and number of attempts for each prompt."""
    out: list = [None] * len(prompts)
    open_ = list(range(len(prompts)))
    whole = None
    for attempt in range(1, backend.attempts + 1):
        if attempt > 1:
            time.sleep(backend.wait * 2 ** (attempt - 2))
        whole = None
        try:
            if backend.name not in _CLIENTS:
                _CLIENTS[backend.name] = backend.open()
            got = _CLIENTS[backend.name]([prompts[i] for i in open_])
            if len(got) != len(open_):
                raise ValueError(f"{len(got)} answers for {len(open_)} prompts")
        except Exception as e:  # noqa: BLE001 - whatever a client raises is the rows' error
            _CLIENTS.pop(backend.name, None)
            whole, got = e, [e] * len(open_)
        for i, answer in zip(open_, got, strict=True):
            failed = isinstance(answer, Exception)
            out[i] = (None if failed else answer, f"{type(answer).__name__}: {answer}" if failed else None, attempt)
        open_ = [i for i in open_ if out[i][1] is not None]
        if not open_:
            break
    if whole is not None and len(open_) > 1:
        for i in open_:
            out[i] = _tried(backend, [prompts[i]])[0]
    return out


def _asked(backend: Backend):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, backend.batch):
                part = batch.slice(at, backend.batch)
                answers, errors, attempts = zip(*_tried(backend, part.column(1).to_pylist()))
                columns = [part.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(attempts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "answer", "error", "attempts"])

    return run


def ask(prompts: DataFrame, backend: Backend) -> DataFrame:
    """Rows (key, prompt) as (key, answer, error, attempts); the keys are dealt out over all tasks."""
    python_ready(prompts.sparkSession)
    dealt = by_key(prompts.select("key", "prompt"), "key")
    return dealt.mapInArrow(_asked(backend), "key string, answer string, error string, attempts int")


class AnswerStore:
    """Answers by key in a Parquet folder that runs append to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """key and answer; a key that two runs have asked at once has the lesser answer."""
        schema = "key string, answer string"
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).groupBy("key").agg(F.min("answer").alias("answer"))

    def add(self, answers: DataFrame) -> None:
        answers.select("key", "answer").write.mode("append").parquet(self.path)


def with_answers(rows: DataFrame, prompt: Column, backend: Backend, store: AnswerStore | None = None) -> DataFrame:
    """``rows`` with the columns answer and error of their prompts; a null prompt is not asked and has neither.

    Prompts are asked while this is called, and what is new goes to the store.
    """
    name = F.sha2(F.concat(F.lit(backend.name + "\0"), prompt), 256)
    keyed = rows.withColumn("_prompt_key", name)
    wanted = keyed.select(F.col("_prompt_key").alias("key"), prompt.alias("prompt")).where("key IS NOT NULL").groupBy("key").agg(F.first("prompt").alias("prompt"))
    known = None
    if store is not None:
        known = store.read()
        wanted = wanted.join(known, "key", "left_anti")
    asked = staged(ask(wanted, backend))
    answers = asked.select("key", "answer", "error")
    if store is not None:
        answers = answers.unionByName(known.select("key", "answer", F.lit(None).cast("string").alias("error")))
        # The known answers are read before this run's own are added to the same folder.
        answers = staged(answers.join(keyed.select(F.col("_prompt_key").alias("key")).distinct(), "key", "left_semi"))
        store.add(asked.where("error IS NULL"))
    return keyed.join(answers.withColumnRenamed("key", "_prompt_key"), "_prompt_key", "left").drop("_prompt_key")


def chat_client(url: str, model: str, key_variable: str, timeout: float = 60.0, temperature: float = 0.1, max_tokens: int = 2048) -> Callable[[], Client]:
    """Opens a client of an HTTP endpoint for chat completions (one request per prompt, each with its own error).

    The key is read from the worker's environment, so that it stands in no plan and no log.
    """

    def open_() -> Client:
        from urllib.request import Request, urlopen

        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(key_variable, '')}"}

        def one(prompt: str) -> str | Exception:
            body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}
            try:
                with urlopen(Request(url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers), timeout=timeout) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"]
            except Exception as e:  # noqa: BLE001 - this prompt's error
                return e

        return lambda prompts: [one(p) for p in prompts]

    return open_
