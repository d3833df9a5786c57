"""Model calls: one operator, whatever answers."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.sources import materialise

#: Tries of a call, pause between them in seconds, defaults of a request.
ATTEMPTS = 3
PAUSE = 1.0
MODEL = "openrouter/free"
TEMPERATURE = 0.7


class Backend(Protocol):
    """Answers requests. A backend is sent to the workers, which ``open`` it once for each partition."""

    pause: float  # seconds between the tries of a failed call

    def open(self) -> Callable[[str, str, str, float], str]:
        """A function of (stage, prompt, model, temperature) that returns a reply or raises."""
        ...


class RuleBackend:
    """Replies by a function of stage and prompt. For tests and dry runs: rules are not a model."""

    pause = 0.0

    def __init__(self, rules: Callable[[str, str], str]):
        self.rules = rules

    def open(self) -> Callable[[str, str, str, float], str]:
        return lambda stage, prompt, model, temperature: self.rules(stage, prompt)


class HttpBackend:
    """A chat endpoint in the common form. Not tested here, as this container has no network."""

    pause = PAUSE

    def __init__(self, url: str, key_variable: str = "CHAT_API_KEY", timeout: float = 60.0):
        if not os.environ.get(key_variable):
            raise ValueError(f"{key_variable} is not set")
        self.url, self.key_variable, self.timeout = url, key_variable, timeout

    def open(self) -> Callable[[str, str, str, float], str]:
        key = os.environ[self.key_variable]

        def ask(stage: str, prompt: str, model: str, temperature: float) -> str:
            body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature}
            request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                choices = json.load(reply).get("choices")
            if not choices:
                raise ValueError("No choices returned")
            return choices[0]["message"]["content"]

        return ask


def with_retries(ask: Callable[[], str], attempts: int = ATTEMPTS, pause: float = PAUSE) -> tuple[str | None, str | None, int]:
    """(reply, error, tries made): tried again after any failure, which the last one reports."""
    for n in range(1, attempts + 1):
        try:
            return ask(), None, n
        except Exception as e:
            if n == attempts:
                return None, f"LLM call failed: {e}", n
            time.sleep(pause)
    raise ValueError("attempts must be positive")


def request_id(stage: Column, model: Column, temperature: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("|", stage, model, temperature.cast("string"), prompt), 256)


def call(rows: DataFrame, prompt: str, backend: Backend, stage: str, known: DataFrame | None = None, model: str = MODEL, temperature: float = TEMPERATURE, attempts: int = ATTEMPTS) -> DataFrame:
    """``rows`` with ``reply`` and ``call_error``.

    Equal requests are made once; those in ``known`` (req_id, reply) not at all. Replies are written before they are
    used, so a later action doesn't call again. A failed call is an error of its row, and others go on. Requests are
    spread by their hash, not by what they belong to. A null prompt gets no call and a null reply.
    """
    own = rows.withColumn("_req", request_id(F.lit(stage), F.lit(model), F.lit(temperature), F.col(prompt)))
    pause = backend.pause
    wanted = own.filter(F.col(prompt).isNotNull()).select(F.col("_req").alias("req_id"), F.col(prompt).alias("prompt")).dropDuplicates(["req_id"])
    if known is not None:
        known = known.dropDuplicates(["req_id"])
        wanted = wanted.join(known.select("req_id"), "req_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = None
        for batch in batches:
            if ask is None and len(batch):
                ask = backend.open()
            out = [with_retries(lambda p=p: ask(stage, p, model, temperature), attempts, pause) for p in batch["prompt"]]
            yield pd.DataFrame({"req_id": batch["req_id"], "reply": [o[0] for o in out], "call_error": [o[1] for o in out]})

    replies = materialise(wanted.repartition("req_id").mapInPandas(run, "req_id string, reply string, call_error string"), f"replies-{stage}")
    if known is not None:
        replies = replies.unionByName(known.select("req_id", "reply", F.lit(None).cast("string").alias("call_error")))
    return own.join(replies.withColumnRenamed("req_id", "_req"), "_req", "left").drop("_req")


def replay(rows: DataFrame, prompt: str, recorded: DataFrame, stage: str, model: str = MODEL, temperature: float = TEMPERATURE) -> DataFrame:
    """``rows`` with the recorded ``reply`` of each request (req_id, reply); those not recorded are errors."""
    own = rows.withColumn("req_id", request_id(F.lit(stage), F.lit(model), F.lit(temperature), F.col(prompt)))
    found = own.join(recorded.select("req_id", "reply", F.lit(True).alias("_known")).dropDuplicates(["req_id"]), "req_id", "left")
    return found.withColumn("call_error", F.when(F.col("_known").isNull(), F.lit("not recorded"))).drop("req_id", "_known")
