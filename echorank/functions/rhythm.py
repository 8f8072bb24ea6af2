"""Rhythm features of one waveform segment, as numpy helpers for Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .loudness import PHON_LEVELS, SONE_DOUBLING, SONE_EXPONENT, SONE_KNEE, BARK_EDGES, band_levels, spreading_matrix

# Samples per segment and per FFT window for each sampling rate,
# the gain that puts full scale on the hearing threshold, the divisor of the
# modulation spectrum.
SEGMENT_SIZES = {11025: 2**16, 22050: 2**17, 44100: 2**18}
WINDOW_SIZES = {11025: 256, 22050: 512, 44100: 1024}
HEARING_GAIN = 0.0875 * 2**15
MODULATION_DIVISOR = 256
# Windows transformed together.
FRAMES = 64
SEGMENT_TYPES = ("rp", "rh", "ssd", "mvd")


@dataclass(frozen=True)
class RhythmOptions:
    """Switches of the transforms, number of bands and modulation bins."""

    n_bark_bands: int = 24
    mod_ampl_limit: int = 60
    bark: bool = True
    masking: bool = True
    db: bool = True
    phon: bool = True
    sone: bool = True
    fluctuation_weighting: bool = True

    def __post_init__(self):
        if not self.bark and (self.masking or self.phon):
            raise ValueError("masking and phon need critical bands")


def power_spectrogram(signal: np.ndarray, window: int) -> np.ndarray:
    """(bins, frames): Hann window, half overlap, power per window energy and 2π.

    All bins but DC count twice, for their mirror image.
    """
    frames = np.lib.stride_tricks.sliding_window_view(signal, window)[:: window // 2]
    taper = np.hanning(window)
    power = np.empty((len(frames), window // 2 + 1))
    for a in range(0, len(frames), FRAMES):  # few at a time stay in the processor's cache
        power[a : a + FRAMES] = np.abs(np.fft.rfft(frames[a : a + FRAMES] * taper, axis=1)) ** 2
    power /= taper @ taper * 2 * np.pi
    power[:, 1:] *= 2
    return power.T


def bark_matrix(bins: int, rate: int, bands: int) -> np.ndarray:
    """0/1 matrix that sums the bins of a critical band: lower edge in, upper out."""
    frequency = np.linspace(0, rate / 2, bins)
    band = np.searchsorted(BARK_EDGES, frequency, side="right")
    return (np.arange(min(bands, len(BARK_EDGES)))[:, None] == band).astype(float)


def to_phon(db: np.ndarray) -> np.ndarray:
    """Band by band, linear between the loudness curves; see ``loudness.to_phon``."""
    curves, levels = band_levels(len(db)), np.array(PHON_LEVELS, dtype=float)
    slopes = np.diff(levels) / np.diff(curves, axis=1)
    at = sum((db > curves[:, n, None]).astype(np.int8) for n in range(1, curves.shape[1] - 1))
    band = np.arange(len(db))[:, None]
    value = levels[at] + (db - curves[band, at]) * slopes[band, at]
    return np.where(db <= curves[:, :1], levels[0], value)


def to_sone(phon: np.ndarray) -> np.ndarray:
    soft = np.maximum(phon, 0) / SONE_KNEE
    return np.where(phon >= SONE_KNEE, 2 ** ((phon - SONE_KNEE) / SONE_DOUBLING), soft**SONE_EXPONENT)


def sonogram(segment: np.ndarray, rate: int, options: RhythmOptions) -> np.ndarray:
    """(bands, frames) of loudness."""
    matrix = power_spectrogram(segment * HEARING_GAIN, WINDOW_SIZES[rate])
    if options.bark:
        matrix = bark_matrix(len(matrix), rate, options.n_bark_bands) @ matrix
    if options.masking:
        matrix = spreading_matrix(len(matrix)) @ matrix
    if options.db:
        matrix = 10 * np.log10(np.maximum(matrix, 1))
    if options.phon:
        matrix = to_phon(matrix)
    return to_sone(matrix) if options.sone else matrix


def modulation(sono: np.ndarray, limit: int) -> np.ndarray:
    """Magnitudes of the modulation frequencies 1..limit, per band."""
    size = max(2, 1 << int(sono.shape[1] - 1).bit_length())
    if limit >= size:
        raise ValueError(f"{limit} modulation frequencies need more than {sono.shape[1]} frames")
    return np.abs(np.fft.fft(sono, size, axis=1)[:, 1 : limit + 1]) / MODULATION_DIVISOR


def fluctuation_curve(rate: int, limit: int) -> np.ndarray:
    frequency = np.arange(1, limit + 1) * rate / SEGMENT_SIZES[rate]
    return 1 / (frequency / 4 + 4 / frequency)


def row_moments(matrix: np.ndarray) -> np.ndarray:
    """(rows, 7): mean, variance, skewness, kurtosis, median, min, max per row.

    A row that is constant up to rounding has variance, skewness and kurtosis 0.
    """
    mean = matrix.mean(axis=1)
    gap = matrix - mean[:, None]
    var = (gap**2).mean(axis=1)
    flat = var <= (np.finfo(float).resolution * mean) ** 2
    safe, var = np.where(flat, 1.0, var), np.where(flat, 0.0, var)
    skew = np.where(flat, 0.0, (gap**3).mean(axis=1) / safe**1.5)
    kurtosis = np.where(flat, 0.0, (gap**4).mean(axis=1) / safe**2)
    columns = [mean, var, skew, kurtosis, np.median(matrix, axis=1), matrix.min(axis=1), matrix.max(axis=1)]
    return np.nan_to_num(np.stack(columns, axis=1), nan=0.0, posinf=np.inf, neginf=-np.inf)


def segment_vectors(segment: np.ndarray, rate: int, types, options: RhythmOptions) -> dict[str, np.ndarray]:
    """The wanted vectors of one segment; matrices are flattened column by column."""
    sono = sonogram(segment, rate, options)
    out = {}
    if "ssd" in types:
        out["ssd"] = row_moments(sono).ravel(order="F")
    if {"rp", "rh", "mvd"} & set(types):
        spectrum = modulation(sono, options.mod_ampl_limit)
        if "mvd" in types:
            out["mvd"] = row_moments(spectrum.T).ravel(order="F")
        if "rh" in types:
            out["rh"] = spectrum.sum(axis=0)
        if "rp" in types:
            weight = fluctuation_curve(rate, options.mod_ampl_limit) if options.fluctuation_weighting else 1.0
            out["rp"] = (spectrum * weight).ravel(order="F")
    return out
