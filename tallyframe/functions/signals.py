"""Signals of decoded audio samples: energy, pitch variation and envelope, as vectorised functions of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def frame_db(x: np.ndarray, rate: int, frame_s: float = 0.1) -> np.ndarray:
    n = max(1, int(rate * frame_s))
    frames = x[: len(x) // n * n].reshape(-1, n)
    return 20 * np.log10(np.sqrt((frames**2).mean(1)) + 1e-9)


def energy(x: np.ndarray, rate: int) -> float:
    """How far the loud frames stand above the middle ones, in decibels."""
    db = frame_db(x, rate)
    return float(np.percentile(db, 95) - np.median(db)) if len(db) else 0.0


def pitch_spread(x: np.ndarray, rate: int, low: float = 75.0, high: float = 400.0) -> float:
    """Median absolute deviation of the voiced frames' pitch, in semitones; pitch by autocorrelation."""
    n = int(rate * 0.04)
    frames = x[: len(x) // n * n].reshape(-1, n)
    frames = frames[np.sqrt((frames**2).mean(1)) > 0.01]
    if not len(frames):
        return 0.0
    frames = frames - frames.mean(1, keepdims=True)
    spectrum = np.fft.rfft(frames, 2 * n)
    auto = np.fft.irfft(np.abs(spectrum) ** 2)[:, :n]
    a, b = int(rate / high), min(n - 1, int(rate / low))
    lag = a + auto[:, a:b].argmax(1)
    voiced = auto[np.arange(len(lag)), lag] > 0.3 * auto[:, 0]
    if voiced.sum() < 3:
        return 0.0
    tones = 12 * np.log2(rate / lag[voiced])
    return float(np.median(np.abs(tones - np.median(tones))))


def envelope(x: np.ndarray, rate: int, hop_s: float = 0.2) -> np.ndarray:
    n = max(1, int(rate * hop_s))
    return np.sqrt((x[: len(x) // n * n].reshape(-1, n) ** 2).mean(1))


def _over(f, kind):
    return F.pandas_udf(lambda s, rate: pd.Series([f(np.asarray(x, float), int(r)) for x, r in zip(s, rate)]), kind)


energy_db = _over(energy, DoubleType())
pitch_semitones = _over(pitch_spread, DoubleType())
rms_envelope = _over(lambda x, r: envelope(x, r).tolist(), ArrayType(DoubleType()))
