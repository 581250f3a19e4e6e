"""Calls of a text model from a DataFrame: one client a task, retries, checks, JSON answers."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .quality import json_in

Provider = Callable[[list[dict[str, str]]], str]


class RetryLater(Exception):
    """A failure that may pass: too many requests, a lost connection."""


class Refused(Exception):
    """A failure that stays: a bad request, no quota."""


class Http:
    """A client of a chat completion service; ``used`` adds up the tokens that the service reports: prompt and completion.

    A bad request, a refused key and a spent quota are failures that stay; too many requests, errors
    of the service and of the connection may pass.
    """

    def __init__(self, url: str, model: str, key: str | None = None, timeout: float = 300.0, **options):
        self.url, self.model, self.timeout, self.options = url.rstrip("/") + "/chat/completions", model, timeout, options
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        self.used = [0, 0]

    def __call__(self, messages: list[dict[str, str]]) -> str:
        body = json.dumps({"model": self.model, "messages": messages, **self.options}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, self.headers), timeout=self.timeout) as r:
                answer = json.load(r)
        except urllib.error.HTTPError as e:
            said = e.read().decode("utf-8", "replace")
            spent = e.code == 429 and "insufficient_quota" in said
            raise (RetryLater if e.code >= 500 or (e.code == 429 and not spent) else Refused)(f"{e.code}: {said[:500]}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise RetryLater(str(e)) from e
        usage = answer.get("usage") or {}
        self.used = [self.used[0] + usage.get("prompt_tokens", 0), self.used[1] + usage.get("completion_tokens", 0)]
        return answer["choices"][0]["message"]["content"] or ""


def completed(provider: Provider, messages: list[dict[str, str]], attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """An answer, asked for up to ``attempts`` times, with waits that double."""
    for n in range(1, attempts + 1):
        try:
            return provider(messages)
        except RetryLater:
            if n == attempts:
                raise
            sleep(wait * 2 ** (n - 1))
    raise AssertionError


def validated(provider: Provider, messages: list[dict[str, str]], valid: Callable[[str], bool], attempts: int = 3, **how) -> str:
    """The first answer that ``valid`` accepts; the same messages are sent again."""
    for _ in range(attempts):
        if valid(answer := completed(provider, messages, **how)):
            return answer
    raise ValueError("no valid answer")


def structured(provider: Provider, messages: list[dict[str, str]], check: Callable[[dict], str | None], attempts: int = 3, shape: dict | None = None, **how) -> dict:
    """An answer as an object for which ``check`` finds no error; all errors so far are sent back.  Three failures end it.

    With a ``shape`` (see ``example``) the last message of the user ends with an instance of it.
    """
    asked = [dict(m) for m in messages]
    last = next((m for m in reversed(asked) if m.get("role") == "user"), None)
    if shape is not None and last is not None:
        last["content"] += f"\n\nAnswer with a JSON object like this:\n{json.dumps(example(shape))}"
    for _ in range(attempts):
        answer = completed(provider, asked, **how)
        try:
            found = json.loads(json_in(answer) or "")
            error = check(found) if isinstance(found, dict) else "no object"
        except ValueError as e:
            error = str(e)
        if error is None:
            return found
        asked = [*asked, {"role": "assistant", "content": answer}, {"role": "user", "content": f"The answer can't be used: {error}. Answer with the object alone."}]
    raise ValueError("no usable answer")


def example(schema: dict) -> dict:
    """An instance of a schema given as names to types or nested schemas, to show to a model."""
    plain = {"string": "text", "int": 0, "double": 0.0, "boolean": False}
    return {k: [example(v[0]) if isinstance(v[0], dict) else plain[v[0]]] if isinstance(v, list) else example(v) if isinstance(v, dict) else plain[v] for k, v in schema.items()}


def answered(rows: DataFrame, messages: str, factory: Callable[[], Provider]) -> DataFrame:
    """``rows`` with ``answer``, ``error``, ``seconds`` and the tokens that the client counted (0 if it doesn't); ``messages`` is a column array<struct<role, content>>.

    A client is made once a task.  A call that fails for good leaves a null answer and its error.
    """
    columns = rows.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in it:
            found = []
            for m in pdf[messages]:
                began, before = time.time(), list(getattr(client, "used", (0, 0)))
                try:
                    found.append((completed(client, [dict(role=x["role"], content=x["content"]) for x in m]), None))
                except (RetryLater, Refused) as e:
                    found.append((None, str(e)))
                now = getattr(client, "used", (0, 0))
                found[-1] += (time.time() - began, now[0] - before[0], now[1] - before[1])
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(found, columns=["answer", "error", "seconds", "prompt_tokens", "completion_tokens"])], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in columns)
    return rows.mapInPandas(run, f"{schema}, answer string, error string, seconds double, prompt_tokens long, completion_tokens long")
