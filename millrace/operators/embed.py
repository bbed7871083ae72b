"""Embedders: a deterministic local one, and any callable on batches of texts."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def local_vector(text: str, dimensions: int) -> list[float]:
    """Unit vector of Gaussians seeded by the text's SHA-256; equal texts are equal, others unrelated."""
    rng = random.Random(int(hashlib.sha256(text.encode()).hexdigest()[:16], 16))
    v = np.array([rng.gauss(0, 1) for _ in range(dimensions)])
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).tolist()


def embed(df: DataFrame, text_col: str, call: Callable[[list[str]], list[list[float]]], batch_size: int = 100) -> DataFrame:
    """``df`` with ``embedding``; null texts have none.  ``call`` is unpickled once per task, so it may hold a client."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = [None] * len(frame)
            at = [i for i, t in enumerate(frame[text_col]) if t is not None]
            for low in range(0, len(at), batch_size):
                part = at[low : low + batch_size]
                for i, v in zip(part, call([frame[text_col].iloc[i] for i in part])):
                    out[i] = v
            yield frame.assign(embedding=out)

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", embedding array<double>")


def embed_local(df: DataFrame, text_col: str = "content", dimensions: int = 1024) -> DataFrame:
    return embed(df, text_col, lambda texts: [local_vector(t, dimensions) for t in texts])


def embedder_for(model: str, dimensions: int, remote: Callable[[str, list[str]], list[list[float]]] | None = None) -> Callable[[list[str]], list[list[float]]]:
    """A model named ``bedrock/...`` is remote and needs ``remote(model, texts)``; every other is local."""
    if model.startswith("bedrock/"):
        if remote is None:
            raise ValueError("a remote model needs a callable")
        name = model.split("/", 1)[1]
        return lambda texts: remote(name, texts)
    return lambda texts: [local_vector(t, dimensions) for t in texts]


