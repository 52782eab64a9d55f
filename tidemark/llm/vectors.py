"""Vectors as binary columns, and the classes of equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(column, dim: int, dtype=np.float64) -> np.ndarray:
    """A matrix of a binary column's vectors."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(-1, dim) if raw else np.empty((0, dim), dtype)


def packed(vectors: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id, v): v holds the components as doubles; null where a vector is null, empty or holds null
    or non-finite components, or (nonzero) has no direction. Vectors of other lengths than the
    longest stay apart because their bytes differ in number."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column("v").to_pylist():
                v = None
                if x and None not in x:
                    a = np.array(x, dtype=np.float64)
                    if np.isfinite(a).all() and (not nonzero or a.any()):
                        v = (a + 0.0).tobytes()  # -0.0 becomes 0.0
                out.append(v)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "v"])

    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].alias("v"))
    return rows.mapInArrow(run, "id long, v binary")
