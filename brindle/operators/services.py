"""External calls behind small interfaces, with deterministic stand-ins, and the retry rules around them.

A service is any object with the protocol's methods that can be pickled; executors call it a batch of
rows at a time. The stand-ins answer from the prompt alone, so every query over them is repeatable.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import page_markdown, valid_object


class Model(Protocol):
    def complete(self, model: str, prompt: str) -> dict:
        """text, prompt_tokens, completion_tokens; raises CallError."""


class Fetcher(Protocol):
    def fetch(self, url: str) -> tuple[int, str, str]:
        """status, content type, body."""


class CallError(Exception):
    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"HTTP {status}")
        self.status = status

    @property
    def permanent(self) -> bool:
        """Client errors that another attempt can't mend."""
        return 400 <= self.status < 500 and self.status not in (408, 409, 425, 429)


@dataclass
class EchoModel:
    """Answers with the start of the prompt; models in `failing` answer with their status, and models in `json` with an object."""

    failing: dict[str, int] = field(default_factory=dict)
    json: frozenset = frozenset()

    def complete(self, model: str, prompt: str) -> dict:
        if model in self.failing:
            raise CallError(self.failing[model])
        words = prompt.split()
        text = " ".join(words[:40])
        if model in self.json:
            text = f"Here: {json.dumps({'tags': [{'name': w} for w in words[:3]]})} done"
        return {"text": text, "prompt_tokens": -(-len(prompt) // 4), "completion_tokens": -(-len(text) // 4)}


@dataclass
class TableFetcher:
    """Pages from a mapping of URLs; unknown ones are 404."""

    pages: dict[str, str]

    def fetch(self, url: str) -> tuple[int, str, str]:
        return (200, "text/html", self.pages[url]) if url in self.pages else (404, "", "")


ANSWER = "id long, text string, model string, attempts array<struct<model:string,attempt:int,status:string,prompt_tokens:long,completion_tokens:long>>"


def ask(model: Model, chain: list[str], prompt: str, tries: int = 2, structured: bool = False) -> dict:
    """The first answer along a chain of models. A rate limit goes on to the next model at once, a permanent error too; other errors are tried again."""
    attempts = []
    for name in chain:
        for attempt in range(1, tries + 1):
            try:
                got = model.complete(name, prompt)
            except CallError as e:
                attempts.append({"model": name, "attempt": attempt, "status": "rate_limit" if e.status == 429 else "error", "prompt_tokens": None, "completion_tokens": None})
                if e.permanent or e.status == 429:
                    break
                continue
            text = valid_object(got["text"]) if structured else got["text"]
            attempts.append({"model": name, "attempt": attempt, "status": "ok" if text is not None else "invalid", "prompt_tokens": got["prompt_tokens"], "completion_tokens": got["completion_tokens"]})
            if text is not None:
                return {"text": text, "model": name, "attempts": attempts}
    return {"text": None, "model": None, "attempts": attempts}


def generate(prompts: DataFrame, model: Model, chain: list[str], tries: int = 2, structured: bool = False) -> DataFrame:
    """(id, text, model, attempts) of (id, prompt); attempts explode into the usage ledger."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"id": i, **ask(model, chain, p or "", tries, structured)} for i, p in zip(batch["id"], batch["prompt"])]
            yield pd.DataFrame(rows, columns=["id", "text", "model", "attempts"])

    return prompts.select("id", "prompt").mapInPandas(run, ANSWER)


def ledger(answers: DataFrame, label: str) -> DataFrame:
    """One usage row per attempt; rows outside a story (null id) are left out."""
    a = answers.where("id IS NOT NULL").select(F.col("id").alias("story_id"), F.explode("attempts").alias("a"))
    return a.select("story_id", F.lit(label).alias("label"), F.col("a.model").alias("model_requested"), "a.attempt", "a.status", "a.prompt_tokens", "a.completion_tokens")


def fetch_pages(urls: DataFrame, fetcher: Fetcher, reader: Fetcher | None = None, least: int = 40) -> DataFrame:
    """(id, markdown, source) of (id, url): extracted pages; challenges and refusals go to the reader, whose text must have `least` characters."""
    from ..functions.text import CHALLENGE_MARKERS

    def one(url: str) -> tuple[str | None, str]:
        status, _, body = fetcher.fetch(url)
        blocked = status == 403 or any(m in body.lower() for m in CHALLENGE_MARKERS)
        if status == 200 and not blocked:
            return page_markdown(body), "html"
        if blocked and reader is not None:
            status, _, text = reader.fetch(url)
            if status == 200 and len(text.strip()) >= least and not any(m in text.lower() for m in CHALLENGE_MARKERS):
                return text, "reader"
        return None, "blocked" if blocked else "missing"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(u) for u in batch["url"]]
            yield pd.DataFrame({"id": batch["id"], "markdown": [g[0] for g in got], "source": [g[1] for g in got]})

    return urls.select("id", "url").mapInPandas(run, "id long, markdown string, source string")


def canonical_hash(**parts: object) -> str:
    """SHA-256 of compact JSON in the order given."""
    return hashlib.sha256(json.dumps(parts, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
