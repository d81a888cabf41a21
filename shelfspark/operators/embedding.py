"""Embedding as a batch function over texts, a model being any callable."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def stub_vectors(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors seeded by the text alone: the same text has the same vector everywhere."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.stack([np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).normal(size=dim) for t in texts])
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return run


def embed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """(key, v): vectors of texts, null as empty; batches hold texts of like length."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p[text].fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            found: list = [None] * len(texts)
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                for i, v in zip(some, model([texts[i] for i in some]), strict=True):
                    found[i] = v.astype(np.float32).tolist()
            yield pd.DataFrame({key: p[key], "v": found})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, v array<float>")


def encoded(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[int]]], batch: int = 256) -> DataFrame:
    """(key, tokens): token ids of texts, null as empty, encoded in batches in the worker processes."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p[text].fillna("").tolist()
            found = [ids for lo in range(0, len(texts), batch) for ids in encode(texts[lo : lo + batch])]
            yield pd.DataFrame({key: p[key], "tokens": found})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, tokens array<int>")
