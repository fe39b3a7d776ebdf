"""Voxel intensity expressions."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CLIP = (-1000.0, 3492.0)
MEAN = 656.9095458984375
STD = 1074.9185791015625
DEFAULT_DENSITY = 50.0


def normalize_ct(hu: Column, lo=CLIP[0], hi=CLIP[1], mean=MEAN, std=STD) -> Column:
    """Clip to the training window, subtract its mean, divide by its deviation.

    The window is the training set's, never the scan's own.
    """
    lo, hi, mean, std = (F.lit(v) if not isinstance(v, Column) else v for v in (lo, hi, mean, std))
    clipped = F.least(F.greatest(hu.cast("double"), lo), hi)
    return (clipped - mean) / F.greatest(std, F.lit(1e-8))


def normalized(hu, lo=CLIP[0], hi=CLIP[1], mean=MEAN, std=STD):
    """``normalize_ct`` of an array."""
    return (np.minimum(np.maximum(hu, lo), hi) - mean) / max(std, 1e-8)


def denormalize(v: Column, mean=MEAN, std=STD) -> Column:
    """Back to intensities; the clipping is not undone."""
    return v * std + mean


def density_to_threshold(density: Column, low: Column, auto: Column, high: Column) -> Column:
    """0..100 on the scan's own scale: 0 low, 50 automatic, 100 high."""
    d = F.least(F.greatest(density.cast("double"), F.lit(0.0)), F.lit(100.0))
    return (F.when(d <= 50.0, low + (auto - low) * d / 50.0)
            .otherwise(auto + (high - auto) * (d - 50.0) / 50.0))


def above(value: Column, isovalue) -> Column:
    return value > isovalue
