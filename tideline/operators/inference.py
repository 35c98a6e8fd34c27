"""Inference as a stage of a plan: providers called per batch, with retries, fallback and two passes."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "id long, model string, text string, confidence double, prompt_tokens long, completion_tokens long, provider string, attempts int, error string"
PASSING = (408, 429)


class ProviderError(Exception):
    def __init__(self, status: int | None, message: str = "") -> None:
        super().__init__(message or f"status {status}")
        self.status = status

    @property
    def passing(self) -> bool:
        """Whether another provider may succeed: no status (transport, saturation), 408, 429 or 5xx."""
        return self.status is None or self.status in PASSING or 500 <= self.status < 600


@dataclass(frozen=True)
class Reply:
    text: str
    confidence: float
    prompt_tokens: int
    completion_tokens: int


class Provider(ABC):
    """Answers requests. Instances go to the tasks, so they must pickle; a task opens its own connections."""

    name = "provider"

    @abstractmethod
    def infer(self, model: str, prompt: str) -> Reply: ...


class Fixed(Provider):
    """A stand-in without a network: answers from a digest of the request, the same each time."""

    name = "fixed"

    def infer(self, model: str, prompt: str) -> Reply:
        digest = hashlib.sha256(f"{model}\n{prompt}".encode()).digest()
        return Reply(f"{model}:{digest[:4].hex()}", digest[4] / 255, len(prompt) // 4, 2 + digest[5] % 30)


def infer(requests: DataFrame, providers: list[Provider]) -> DataFrame:
    """Replies to requests (id, model, prompt): providers are asked in order while the cause is passing; an error that is not,
    or the last one, is the row's. Rows are spread as they lie; nothing is shuffled."""
    if not 1 <= len(providers) <= 8:
        raise ValueError("1 to 8 providers")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, model, prompt in zip(pdf.id, pdf.model, pdf.prompt, strict=True):
                for n, p in enumerate(providers, 1):
                    try:
                        r = p.infer(model, prompt or "")
                        out.append((key, model, r.text, r.confidence, r.prompt_tokens, r.completion_tokens, p.name, n, None))
                        break
                    except ProviderError as e:
                        if n == len(providers) or not e.passing:
                            out.append((key, model, None, None, 0, 0, p.name, n, str(e)))
                            break
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return requests.select("id", "model", "prompt").mapInPandas(run, SCHEMA)
