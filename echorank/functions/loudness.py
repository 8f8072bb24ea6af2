"""Waveform and loudness expressions, and the fixed psycho-acoustic tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from .ids import as_column

# Fixed values -----------------------------------------------------------------
# Upper edges of the 24 critical bands in Hz.
BARK_EDGES = (100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720,
              2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500)
# Loudness levels in phon; the first six have a curve below.
PHON_LEVELS = (3, 20, 40, 60, 80, 100)
# Frequencies in Hz, and the sound pressure in dB that is as loud as each level.
CURVE_FREQUENCIES = (31.62, 50, 70.7, 100, 141.4, 200, 316.2, 500, 707.1, 1000, 1414,
                     1682, 2000, 2515, 3162, 3976, 5000, 7071, 10000, 11890, 14140, 15500)
EQUAL_LOUDNESS = (
    (55, 40, 32, 24, 19, 14, 10, 6, 4, 3, 2, 2, 0, -2, -5, -4, 0, 5, 10, 14, 25, 35),
    (66, 52, 43, 37, 32, 27, 23, 21, 20, 20, 20, 20, 19, 16, 13, 13, 18, 22, 25, 30, 40, 50),
    (76, 64, 57, 51, 47, 43, 41, 41, 40, 40, 40, 39.5, 38, 35, 33, 33, 35, 41, 46, 50, 60, 70),
    (89, 79, 74, 70, 66, 63, 61, 60, 60, 60, 60, 59, 56, 53, 52, 53, 56, 61, 65, 70, 80, 90),
    (103, 96, 92, 88, 85, 83, 81, 80, 80, 80, 80, 79, 76, 72, 70, 70, 75, 79, 83, 87, 95, 105),
    (118, 110, 107, 105, 103, 102, 101, 100, 100, 100, 100, 99, 97, 94, 90, 90, 95, 100, 103, 105, 108, 115),
)
# Sone: the level where one law takes over from the other, and both exponents.
SONE_KNEE = 40
SONE_DOUBLING = 10
SONE_EXPONENT = 2.642
# Spreading of a band over its neighbours, in dB: offset, slope, shift, bend.
SPREAD = (15.81, 7.5, 0.474, 17.5)
# -------------------------------------------------------------------------------


def band_levels(bands: int = 24) -> np.ndarray:
    """dB of each loudness level at the band edges, (bands, levels).

    Between two tabulated frequencies both count by the inverse of their distance,
    which is linear interpolation.
    """
    edges = BARK_EDGES[:bands]
    return np.stack([np.interp(edges, CURVE_FREQUENCIES, curve) for curve in EQUAL_LOUDNESS], axis=1)


def spreading_matrix(bands: int = 24) -> np.ndarray:
    offset, slope, shift, bend = SPREAD
    gap = np.subtract.outer(np.arange(bands), np.arange(bands)) + shift
    return 10 ** ((offset + slope * gap - bend * np.sqrt(1 + gap**2)) / 10)


def normalize_pcm(samples, width) -> Column:
    """Integer samples (n, channels) to about (-1, 1); 8 bit keeps its offset."""
    scale = F.pow(F.lit(2.0), F.lit(8) * as_column(width) - 1)
    return F.transform(as_column(samples), lambda s: F.transform(s, lambda x: x / scale))


def to_mono(samples) -> Column:
    """Mean over the channels of each sample."""
    return F.transform(as_column(samples), lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))


def to_db(power) -> Column:
    return F.log10(F.greatest(as_column(power), F.lit(1.0))) * 10


def to_phon(db, band: int) -> Column:
    """Loudness level of a dB value in one band (0-based).

    Linear between the curves, the lowest level below the first curve, the last
    segment continued above the top one.
    """
    db = as_column(db)
    curve = [float(v) for v in band_levels()[band]]
    levels = [float(p) for p in PHON_LEVELS]
    value = F.when(db <= curve[0], F.lit(levels[0]))
    for n in range(1, len(curve)):
        slope = (levels[n] - levels[n - 1]) / (curve[n] - curve[n - 1])
        inside = (db - curve[n - 1]) * slope + levels[n - 1]
        value = value.when(db <= curve[n], inside) if n < len(curve) - 1 else value.otherwise(inside)
    return value


def to_sone(phon) -> Column:
    phon = as_column(phon)
    loud = F.pow(F.lit(2.0), (phon - SONE_KNEE) / SONE_DOUBLING)
    return F.when(phon >= SONE_KNEE, loud).otherwise(F.pow(phon / SONE_KNEE, F.lit(SONE_EXPONENT)))
