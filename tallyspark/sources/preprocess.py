"""Page images before they are read: resize, contrast, denoise, deskew, threshold.

The arithmetic (scale, skew angle) is native; pixels go through a function over Arrow batches.
Without an image library, with preprocessing off, or where anything fails, a page stays as it is.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.documents import PAGE, resize_scale
from tallyspark.sources.options import Options

#: Degrees under which a page counts as straight, and over which a line is not one of text.
STRAIGHT, STEEP = 0.3, 45.0


def skew_angle(segments: Column) -> Column:
    """Median angle in degrees of array<struct<x1, y1, x2, y2>> that are less than 45 degrees off; null without any."""
    angles = F.transform(segments, lambda s: F.degrees(F.atan2(s["y2"] - s["y1"], s["x2"] - s["x1"])))
    flat = F.array_sort(F.filter(angles, lambda a: (a > -STEEP) & (a < STEEP)))
    n = F.size(flat)
    middle = (F.get(flat, F.floor((n - 1) / 2).cast("int")) + F.get(flat, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle)


def needs_rotation(angle: Column) -> Column:
    return F.coalesce(F.abs(angle) >= STRAIGHT, F.lit(False))


def enhance(image: np.ndarray, options: Options) -> np.ndarray:
    """One page through OpenCV; the page itself where the library is missing or fails."""
    try:
        import cv2
    except ImportError:
        return image
    try:
        height, width = image.shape[:2]
        scale = _scale(height, width, options)
        if scale != 1.0:
            image = cv2.resize(image, None, fx=scale, fy=scale, interpolation=cv2.INTER_CUBIC if scale > 1 else cv2.INTER_AREA)
        grey = cv2.cvtColor(image, cv2.COLOR_RGB2GRAY)
        if options.contrast:
            grey = cv2.createCLAHE(clipLimit=2.0, tileGridSize=(8, 8)).apply(grey)
        if options.denoise:
            grey = cv2.fastNlMeansDenoising(grey, None, h=7, templateWindowSize=7, searchWindowSize=21)
        lines = cv2.HoughLinesP(cv2.Canny(grey, 50, 150), 1, np.pi / 180, 200, minLineLength=grey.shape[1] // 3, maxLineGap=20) if options.deskew else None
        found = [] if lines is None else [np.degrees(np.arctan2(y2 - y1, x2 - x1)) for x1, y1, x2, y2 in lines[:, 0]]
        found = [a for a in found if -STEEP < a < STEEP]
        if found and abs(angle := float(np.median(found))) >= STRAIGHT:
            turn = cv2.getRotationMatrix2D((grey.shape[1] / 2, grey.shape[0] / 2), angle, 1.0)
            grey = cv2.warpAffine(grey, turn, grey.shape[::-1], flags=cv2.INTER_CUBIC, borderMode=cv2.BORDER_REPLICATE)
        if options.threshold:
            grey = cv2.adaptiveThreshold(grey, 255, cv2.ADAPTIVE_THRESH_GAUSSIAN_C, cv2.THRESH_BINARY, 31, 15)
        return cv2.cvtColor(grey, cv2.COLOR_GRAY2RGB)
    except cv2.error:
        return image


def _scale(height: int, width: int, options: Options) -> float:
    short, long = min(height, width), max(height, width)
    scale = options.min_short_edge / short if short < options.min_short_edge else 1.0
    scale = options.max_long_edge / long if long * scale > options.max_long_edge else scale
    return 1.0 if abs(scale - 1) < 0.02 else scale


def preprocess(loaded: DataFrame, options: Options | None = None, function: Callable[[np.ndarray, Options], np.ndarray] = enhance) -> DataFrame:
    """``pages`` with every image enhanced that has no text layer; the test stands inside the function."""
    options = options or Options()
    if not options.preprocess:
        return loaded

    @F.pandas_udf(f"array<{PAGE}>")
    def run(batches: pd.Series) -> pd.Series:
        out = []
        for pages in batches:
            done = []
            for p in [] if pages is None else pages:
                p = dict(p)
                if not (p["text_layer"] or "").strip() and p["image"]:
                    try:
                        a = function(np.frombuffer(p["image"], np.uint8).reshape(p["height"], p["width"], 3), options)
                        p |= {"image": a.tobytes(), "height": a.shape[0], "width": a.shape[1]}
                    except Exception as failed:  # the page is read as it is
                        warnings.warn(f"a page cannot be enhanced: {failed}", stacklevel=2)
                done.append(p)
            out.append(done)
        return pd.Series(out)

    return loaded.withColumn("pages", run("pages"))


__all__ = ["enhance", "needs_rotation", "preprocess", "resize_scale", "skew_angle"]
