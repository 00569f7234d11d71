"""Pixel metrics and quality rules of inspection images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Luminance weights, quality bounds and file signatures.
LUMINANCE = (0.299, 0.587, 0.114)
DARK_BELOW = 28
BRIGHT_ABOVE = 238
CONTRAST_BELOW = 7
EDGE_BELOW = 8
LOW_SIDE = 160
SMALLEST_SIDE = 16
SIGNATURES = {"image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A"}

METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("brightness", "contrast", "edge_variance")])


def edge_response(gray: np.ndarray) -> np.ndarray:
    """Eight-neighbour edge filter clipped to bytes; the border keeps its own pixels."""
    out = gray.astype(np.int64)
    if min(gray.shape) > 2:
        box = sum(gray[i : i + gray.shape[0] - 2, j : j + gray.shape[1] - 2].astype(np.int64) for i in range(3) for j in range(3))
        out[1:-1, 1:-1] = np.clip(9 * gray[1:-1, 1:-1].astype(np.int64) - box, 0, 255)
    return out


@F.pandas_udf(METRICS)
def image_metrics(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Mean and standard deviation of the luminance, and the variance of the edge response."""
    rows = []
    for h, w, c, raw in zip(height, width, channels, data):
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(h, w, c)
        if c == 1:
            gray = pixels[:, :, 0]
        else:
            blue, green, red = (pixels[:, :, i].astype(np.float64) for i in range(3))
            gray = np.floor(LUMINANCE[0] * red + LUMINANCE[1] * green + LUMINANCE[2] * blue + 0.5).astype(np.uint8)
        rows.append((gray.mean(), gray.std(), edge_response(gray).var()))
    return pd.DataFrame(rows, columns=[f.name for f in METRICS.fields], dtype="float64")


def quality_limits(brightness: Column, contrast: Column, edges: Column, smallest_side: Column) -> Column:
    """Names of the broken quality rules; none means the image is usable."""
    return F.array_compact(
        F.array(
            F.when(brightness < DARK_BELOW, "dark"),
            F.when(brightness > BRIGHT_ABOVE, "overexposed"),
            F.when((contrast < CONTRAST_BELOW) | (edges < EDGE_BELOW), "blur_or_low_contrast"),
            F.when(smallest_side < LOW_SIDE, "low_resolution"),
        )
    )


def sniffed_mime(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = None
    for mime, magic in SIGNATURES.items():
        hit = F.startswith(head, F.lit(magic))
        out = F.when(hit, mime) if out is None else out.when(hit, mime)
    return out.when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "image/webp")
