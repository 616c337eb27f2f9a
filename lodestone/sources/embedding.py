"""Embeddings from an HTTP service, in bounded batches with retries, over the units that lack them."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import incremental

BATCH = 32
ATTEMPTS = 3
BACKOFF_S = 0.25
TIMEOUT_S = 300.0
VECTORS = "unit_id bigint, kind string, model_version string, dimensions int, embedding array<float>"
Embed = Callable[[list[str], float], list[list[float]]]


class TransientError(Exception):
    """Worth another attempt: the connection, a time-out, or a service under pressure."""


class PermanentError(Exception):
    """No attempt will do better."""


class BudgetExhausted(Exception):
    """The deadline is reached; what is embedded so far stays."""


@dataclass(frozen=True)
class HttpEmbedder:
    """Posts texts to ``<url>/v1/embeddings``; called with texts and a time-out in seconds."""

    url: str
    model: str = "embed"

    def __call__(self, texts: list[str], timeout: float) -> list[list[float]]:
        body = json.dumps({"input": texts, "model": self.model}).encode()
        request = urllib.request.Request(f"{self.url.rstrip('/')}/v1/embeddings", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                raw = reply.read()
        except urllib.error.HTTPError as error:
            lasting = 400 <= error.code < 500 and error.code not in (408, 429)
            raise (PermanentError if lasting else TransientError)(f"status {error.code}") from error
        except OSError as error:
            raise TransientError(str(error)) from error
        try:
            found = [item["embedding"] for item in json.loads(raw)["data"]]
        except (ValueError, KeyError, TypeError) as error:
            raise PermanentError(f"not a list of embeddings: {error}") from error
        if len(found) != len(texts):
            raise PermanentError(f"{len(texts)} texts but {len(found)} embeddings")
        return found


def bounded(embed: Embed, texts: list[str], deadline: float | None = None, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One batch: up to three attempts while errors are transient, each within what is left until ``deadline`` (epoch seconds)."""
    for attempt in range(1, ATTEMPTS + 1):
        left = None if deadline is None else deadline - time.time()
        if left is not None and left <= 0:
            raise BudgetExhausted
        try:
            return embed(texts, TIMEOUT_S if left is None else min(TIMEOUT_S, left))
        except TransientError:
            if attempt == ATTEMPTS:
                raise
            pause = BACKOFF_S * attempt
            if left is not None and pause >= left:
                raise BudgetExhausted from None
            sleep(pause)
    raise AssertionError("every attempt returns or raises")


def embedded(texts: DataFrame, embed: Embed, model: str, deadline: float | None = None) -> DataFrame:
    """Vectors of (unit_id, kind, text), batch by batch in every task; past the deadline tasks stop and keep what they have."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            for k in range(0, len(f), BATCH):
                part = f.iloc[k : k + BATCH]
                try:
                    found = bounded(embed, [t or "" for t in part["text"]], deadline)
                except BudgetExhausted:
                    return
                yield pd.DataFrame({"unit_id": part["unit_id"].to_numpy(), "kind": part["kind"].to_numpy(), "model_version": model, "dimensions": [len(v) for v in found], "embedding": found})

    return texts.select("unit_id", "kind", "text").mapInPandas(run, VECTORS)


def backfill(units: DataFrame, vectors: DataFrame, embed: Embed, model: str, deadline: float | None = None) -> DataFrame:
    """The vectors that ``units`` (unit_id, evidence_text, routing_text) lack for this model, evidence and routing."""
    lacking = None
    for kind in ("evidence", "routing"):
        some = incremental.missing_vectors(units, vectors, kind, model).select("unit_id", F.lit(kind).alias("kind"), F.col(f"{kind}_text").alias("text"))
        lacking = some if lacking is None else lacking.unionByName(some)
    return embedded(lacking, embed, model, deadline)


class Breaker:
    """After three deadlines in a row questions go without vectors for half a minute."""

    def __init__(self, trip_after: int = 3, cooldown: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.trip_after, self.cooldown, self.clock = trip_after, cooldown, clock
        self.missed, self.open_until = 0, None

    def allows(self) -> bool:
        return self.open_until is None or self.clock() >= self.open_until

    def succeeded(self) -> None:
        self.missed, self.open_until = 0, None

    def missed_deadline(self) -> None:
        self.missed += 1
        if self.missed >= self.trip_after:
            self.missed, self.open_until = 0, self.clock() + self.cooldown


def encode_floats(values: list[float]) -> bytes:
    """Little-endian 32-bit floats, as vectors are exchanged."""
    import numpy as np

    return np.asarray(values, "<f4").tobytes()


def decode_floats(raw: bytes) -> list[float]:
    import numpy as np

    if len(raw) % 4:
        raise ValueError(f"{len(raw)} bytes are no whole number of floats")
    return np.frombuffer(raw, "<f4").tolist()
