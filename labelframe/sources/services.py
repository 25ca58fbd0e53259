"""Adapters to outside models: an injected function over batches of rows, with retries. Nothing here needs a network; tests inject fakes."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Ask = Callable[[str], str]


def chat_completion(base_url: str, model: str, timeout: float = 60, max_tokens: int = 900, temperature: float = 0.3) -> Ask:
    """A function that sends a prompt to a chat-completions service and returns the raw answer."""

    def ask(prompt: str) -> str:
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": max_tokens}).encode()
        request = urllib.request.Request(base_url.rstrip("/") + "/chat/completions", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read().decode()

    return ask


def answered(rows: DataFrame, prompt: str, ask: Ask, retries: int = 2) -> DataFrame:
    """``rows`` with ``raw`` (null after the last failure) and ``service_error``. One call a row; a failure never fails the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw, errors = [], []
            for text in frame[prompt]:
                answer, error = None, None
                for _ in range(retries + 1):
                    try:
                        answer, error = ask(text), None
                        break
                    except Exception as e:  # an outside service may fail in any way
                        error = f"{type(e).__name__}: {e}"
                raw.append(answer)
                errors.append(error)
            yield frame.assign(raw=raw, service_error=errors)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "raw string", "service_error string"])
    return rows.mapInPandas(run, schema)
