"""Vectors for photos by a plug-in, a batch at a time, with one model for each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Turns paths into vectors, in their order."""

    def embed(self, paths: list[str]) -> np.ndarray: ...


def pick_device(wanted: str, has_accelerator: bool) -> str:
    """``auto`` becomes the accelerator if there is one, anything else stays."""
    return ("cuda" if has_accelerator else "cpu") if wanted == "auto" else wanted


def embed(photos: DataFrame, build: Callable[[], Embedder], batch: int = 8) -> DataFrame:
    """(photo_id, vector): unit vectors of ``photos`` (photo_id, source_path); ``build`` runs once in each task, and only if it has rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for rows in batches:
            for at in range(0, len(rows), batch):
                piece = rows.iloc[at : at + batch]
                model = model or build()
                x = np.asarray(model.embed(piece["source_path"].tolist()), dtype=np.float64).reshape(len(piece), -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                yield pd.DataFrame({"photo_id": piece["photo_id"].to_numpy(), "vector": [v.astype(np.float32) for v in x]})

    return photos.select("photo_id", "source_path").mapInPandas(run, "photo_id long, vector array<float>")


def lookup_vectors(photos: DataFrame, known: DataFrame) -> DataFrame:
    """(photo_id, vector) from a table of vectors made elsewhere (source_path, vector)."""
    return photos.select("photo_id", "source_path").join(known.select("source_path", "vector"), "source_path").where(F.col("vector").isNotNull()).select("photo_id", "vector")
