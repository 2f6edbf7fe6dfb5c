"""Wire payloads of tiles."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: types are spelled out, as workers that import this module have no session to parse them
PAYLOAD = T.StructType(
    [T.StructField("dense", T.StringType()), T.StructField("dtype", T.StringType()), T.StructField("size", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("min_value", "max_value")]
)


def dense_payload(values: np.ndarray) -> dict:
    """base64 of float16 if no value is NaN and all lie strictly inside its range, else of float32; extremes without NaN."""
    v = np.asarray(values, np.float64).ravel()
    seen = v[~np.isnan(v)]
    half = len(seen) == len(v) and (not len(v) or (v.min() > np.finfo(np.float16).min and v.max() < np.finfo(np.float16).max))
    kind = np.float16 if half else np.float32
    return {
        "dense": base64.b64encode(v.astype(kind).tobytes()).decode(),
        "dtype": np.dtype(kind).name,
        "size": len(v),
        "min_value": float(seen.min()) if len(seen) else float("nan"),
        "max_value": float(seen.max()) if len(seen) else float("nan"),
    }


def decode_dense(payload: dict) -> np.ndarray:
    return np.frombuffer(base64.b64decode(payload["dense"]), payload["dtype"]).astype(np.float64)


@F.pandas_udf(PAYLOAD)
def dense_tile(values: pd.Series) -> pd.DataFrame:
    """Payload of an array of doubles a row; nulls are NaN."""
    return pd.DataFrame([dense_payload(np.array([np.nan if x is None else x for x in (v if v is not None else [])], float)) for v in values], columns=["dense", "dtype", "size", "min_value", "max_value"])


def tile_of_cells(rows: int, columns: int, fill: float):
    """A column function (at, value, inside_rows, inside_columns) -> payload of a tile of ``rows`` x ``columns`` cells: ``fill``, NaN
    outside the given corner, and the values at their places (a null value is NaN)."""

    @F.pandas_udf(PAYLOAD)
    def encode(at: pd.Series, value: pd.Series, inside_rows: pd.Series, inside_columns: pd.Series) -> pd.DataFrame:
        out = []
        for a, v, r, c in zip(at, value, inside_rows, inside_columns):
            cells = np.full((rows, columns), fill)
            cells[r:, :] = np.nan
            cells[:, c:] = np.nan
            if a is not None and len(a):
                cells.ravel()[np.asarray(a, np.int64)] = np.asarray(v, np.float64)
            out.append(dense_payload(cells))
        return pd.DataFrame(out, columns=["dense", "dtype", "size", "min_value", "max_value"])

    return encode
