"""What the pipelines take from outside: token counts, embeddings and answers."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_ROWS, RETRIES, FIRST_WAIT_S = 50, 5, 5.0


class TooManyRequests(Exception):
    """The service asks to come again later."""


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Vectors from hashes of words: the same text always gives the same unit vector, texts with common words are similar."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[code % self.dim] += 1.0 if code >> 63 else -1.0
            size = np.linalg.norm(v)
            out.append((v / size if size else v).tolist())
        return out


def with_retries(embed: Embedder, texts: list[str], wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Waits 5, 10, 20, 40 and 80 seconds where there are too many requests; any other failure is raised at once."""
    for attempt in range(RETRIES + 1):
        try:
            return embed(texts)
        except TooManyRequests:
            if attempt == RETRIES:
                raise
            wait(FIRST_WAIT_S * 2**attempt)
    raise AssertionError


def embed_texts(rows: DataFrame, embed: Embedder, key: str = "id", text: str = "text", prefix: str = "passage: ", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``key, values, error``: vectors by batches inside the tasks; a batch that fails gives its rows an error, not the job."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch_rows):
                part = pdf.iloc[at : at + batch_rows]
                try:
                    values, error = with_retries(embed, part["t"].tolist()), None
                except Exception as e:  # noqa: BLE001
                    values, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"k": part["k"].to_numpy(), "values": values, "error": error})

    texts = rows.select(F.col(key).alias("k"), F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return texts.mapInPandas(run, f"k {kind}, values array<float>, error string").withColumnRenamed("k", key)


def answers(prompts: DataFrame, generate: Callable[[str, list[dict]], str], key: str = "query_id") -> DataFrame:
    """``key, message, error`` of each prompt's ``system`` and ``messages``."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, system, messages in zip(pdf["k"], pdf["system"], pdf["messages"]):
                try:
                    rows.append((k, generate(system, [dict(m) for m in messages]), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["k", "message", "error"])

    asked = prompts.select(F.col(key).alias("k"), "system", "messages")
    return asked.mapInPandas(run, f"k {kind}, message string, error string").withColumnRenamed("k", key)

