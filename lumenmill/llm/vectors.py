"""Vector tables for the operators on embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component(vectors: DataFrame, vector_col: str) -> type:
    """The type that holds the column's components exactly: single precision for arrays of floats."""
    return np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, digest, v): v holds the components of a usable vector, else it is null.

    Usable: not null, not empty or zero, no null or non-finite component.
    """

    kind = component(vectors, vector_col)

    def run(batches):
        for b in batches:
            digests, values = [], []
            for x in b.column(1).to_pylist():
                v = None
                if x and None not in x:
                    a = np.array(x, kind)
                    if np.isfinite(a).all() and a.any():
                        v = (a + 0.0).tobytes()
                values.append(v)
                digests.append(hashlib.blake2b(v, digest_size=16).digest() if v else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(values, pa.binary())], ["vec_id", "digest", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).mapInArrow(run, "vec_id long, digest binary, v binary")


def stacked(values, width: int, kind: type = np.float64) -> np.ndarray:
    """Packed vectors as rows of doubles, shorter ones filled with zeros, longer ones cut (see callers)."""
    out = np.zeros((len(values), width))
    for k, v in enumerate(values):
        a = np.frombuffer(v, kind)[:width]
        out[k, : len(a)] = a
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, scaled by the largest component first so that no square overflows."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)
