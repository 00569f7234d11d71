"""Spectral descriptors of array columns: one vectorised FFT call per window length in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.signals import FREQUENCY_FEATURES

# Lower bound of the relative spectrum and its decibel value.
FLOOR_RATIO = 1e-8
FLOOR_DB = -160.0

FEATURE_TYPE = T.StructType([T.StructField(name, T.DoubleType()) for name in FREQUENCY_FEATURES])


def _same_length(samples: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions and stacked samples for every array length of a batch."""
    lengths = samples.map(len).to_numpy()
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, np.stack([np.asarray(samples.iloc[r], dtype=np.float64) for r in rows])


def _amplitudes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    taper = np.hanning(block.shape[1])
    return np.abs(np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * taper, axis=1)), taper


@F.pandas_udf(FEATURE_TYPE)
def frequency_features(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    result = np.zeros((len(samples), len(FREQUENCY_FEATURES)))
    rates = rate.to_numpy(dtype=np.float64)
    for rows, block in _same_length(samples):
        size = block.shape[1]
        if size < 2 or not np.isfinite(block).all():
            raise ValueError("a window needs two or more finite samples")
        magnitude, taper = _amplitudes(block)
        power = magnitude**2
        power[:, 0] = 0.0
        total = power.sum(axis=1)
        live = total > 0
        share = np.divide(power, total[:, None], out=np.zeros_like(power), where=live[:, None])
        logs = np.log(share, out=np.zeros_like(share), where=share > 0)
        axis = np.arange(power.shape[1]) / size * rates[rows][:, None]
        picked = np.take_along_axis(axis, power.argmax(axis=1)[:, None], axis=1)[:, 0]
        values = np.column_stack(
            [
                picked,
                (axis * share).sum(axis=1),
                total / (size * (taper**2).sum() or 1.0),
                -(share * logs).sum(axis=1) / np.log(power.shape[1]),
            ]
        )
        result[rows] = np.where(live[:, None], values, 0.0)
    return pd.DataFrame(result, columns=list(FREQUENCY_FEATURES))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def relative_spectrum(samples: pd.Series) -> pd.Series:
    """Magnitude of every bin against the largest one, in decibels."""
    result: list[np.ndarray | None] = [None] * len(samples)
    for rows, block in _same_length(samples):
        magnitude, _ = _amplitudes(block)
        top = magnitude.max(axis=1, keepdims=True)
        ratio = np.divide(magnitude, top, out=np.zeros_like(magnitude), where=top > 0)
        decibels = 20.0 * np.log10(np.maximum(ratio, FLOOR_RATIO))
        decibels[top[:, 0] == 0] = FLOOR_DB
        for row, line in zip(rows, decibels):
            result[row] = line
    return pd.Series(result)
