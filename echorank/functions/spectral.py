"""Kernels from a recording to frames: resampling, cepstra, pitch classes, onsets, beats.

Each takes one recording's numbers inside a task; Spark deals the recordings.
"""

from __future__ import annotations

from math import gcd

import numpy as np

# Mel scale, linear up to 1000 Hz (200/3 Hz a step), logarithmic above
# (27 steps for a factor of 6.4).
MEL_STEP, MEL_KNEE, MEL_RATIO = 200 / 3, 1000.0, 6.4 ** (1 / 27)
# Coefficients of a timbre frame and the bands they come from.
CEPSTRA, MEL_BANDS = 13, 40
# Fixed values of the spectral peaks: lowest magnitude, range in Hz, number, and the pitch of A.
PEAK_FLOOR, PEAK_LOW, PEAK_HIGH, PEAKS, TUNING = 1e-5, 20.0, 3500.0, 60, 440.0
# Tempo: range and centre in beats a minute, width in octaves. Beats: cost of uneven steps.
TEMPO_LOW, TEMPO_HIGH, TEMPO_CENTRE, TEMPO_WIDTH, EVENNESS = 40.0, 240.0, 120.0, 1.0, 100.0
# Frames on each side that an onset is smoothed over for the tempo.
SMOOTH = 4
# Zero crossings of the resampling filter on each side, its Kaiser shape, share of the band kept.
CROSSINGS, KAISER, BAND = 32, 9.0, 0.95
# Numbers gathered at a time, of spectra at a time, of a filter up to which it is kept, and filters kept.
BLOCK, SPECTRA, KEPT, FILTERS = 1 << 22, 1 << 17, 1 << 18, 16


def _taps(up: int, down: int, cut: float, half: int, first: int, count: int) -> tuple[int, np.ndarray]:
    """The filter of outputs ``first`` to ``first + count``: place of the first input, and inputs x outputs."""
    n = np.arange(first, first + count, dtype=np.int64) * down
    begin = int(n[0] // up)
    offsets = np.arange(-half + 1, half + 1)
    t = offsets[None, :] - (n % up / up)[:, None]
    taps = cut * np.sinc(cut * t) * np.i0(KAISER * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(KAISER)
    taps /= taps.sum(axis=1, keepdims=True)
    matrix = np.zeros((int(n[-1] // up) - begin + 2 * half, count))
    matrix[(n // up - begin)[:, None] + np.arange(2 * half)[None, :], np.arange(count)[:, None]] = taps
    return begin, matrix


def resample(x: np.ndarray, rate: int, to: int, filters: dict | None = None) -> np.ndarray:
    """``x`` at another sampling rate, by a polyphase windowed sinc.

    Output n lies at input place n * rate / to; the phases of the filter repeat after
    to / gcd outputs. Level and time are kept, what lies above the lower of both
    half rates is filtered out. Neighbouring outputs share most of their inputs, so a
    matrix makes some of them from a stretch of the input, and all repeats at once.
    ``filters`` keeps small filters from one recording to the next.
    """
    if rate == to or len(x) == 0:
        return np.asarray(x, float)
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    cut = BAND * min(1.0, to / rate)
    half = int(np.ceil(CROSSINGS / cut))
    total = -(-len(x) * up // down)
    group = max(1, 2 * half * up // down)  # outputs whose inputs are twice a filter's
    times = -(-group // up)
    period, shift = up * times, down * times  # outputs and inputs after which the phases repeat
    rounds = -(-total // period)
    padded = np.concatenate([np.zeros(half - 1), x, np.zeros(2 * half + shift)])
    out, kept = np.zeros((rounds, period)), {}
    if filters is not None and period * 4 * half <= KEPT:
        if len(filters) >= FILTERS:
            filters.clear()
        kept = filters.setdefault((rate, to), kept)
    for first in range(0, min(period, total), group):
        count = min(group, period - first)
        begin, matrix = found = kept.get(first) or _taps(up, down, cut, half, first, count)
        if period * 4 * half <= KEPT:
            kept[first] = found
        stretches = np.lib.stride_tricks.sliding_window_view(padded, len(matrix))[begin::shift]
        step = max(1, BLOCK // len(matrix))
        for a in range(0, rounds, step):
            b = min(rounds, a + step)
            out[a:b, first : first + count] = np.ascontiguousarray(stretches[a:b]) @ matrix
    return out.ravel()[:total]


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping frames; a recording shorter than one frame is filled with silence."""
    x = np.concatenate([x, np.zeros(size - len(x))]) if len(x) < size else x
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def magnitudes(x: np.ndarray, size: int, hop: int, taper: np.ndarray):
    """Blocks of magnitude spectra, ``(first frame, frames x bins)``, of unit level."""
    frames = framed(x, size, hop)
    step = max(1, SPECTRA // size)
    for a in range(0, len(frames), step):
        yield a, np.abs(np.fft.rfft(frames[a : a + step] * taper, axis=1)) * (2 / taper.sum())


def _mel(hertz: np.ndarray) -> np.ndarray:
    return np.where(hertz < MEL_KNEE, hertz / MEL_STEP, MEL_KNEE / MEL_STEP + np.log(np.maximum(hertz, MEL_KNEE) / MEL_KNEE) / np.log(MEL_RATIO))


def _hertz(mel: np.ndarray) -> np.ndarray:
    knee = MEL_KNEE / MEL_STEP
    return np.where(mel < knee, mel * MEL_STEP, MEL_KNEE * MEL_RATIO ** np.maximum(mel - knee, 0))


def mel_matrix(size: int, rate: int, bands: int = MEL_BANDS, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular bands (rows) over the bins of a frame, equally spaced in mel, of unit area."""
    edges = _hertz(np.linspace(_mel(np.array(low)), _mel(np.array(high or rate / 2)), bands + 2))
    bins = np.arange(size // 2 + 1) * rate / size
    rise = (bins[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def cosine_matrix(bands: int, n: int) -> np.ndarray:
    """The first ``n`` rows of the orthonormal cosine transform."""
    rows = np.cos(np.pi / bands * (np.arange(bands) + 0.5)[None, :] * np.arange(n)[:, None]) * np.sqrt(2 / bands)
    rows[0] /= np.sqrt(2)
    return rows


def cepstra(x: np.ndarray, rate: int, size: int, hop: int, bands: int = MEL_BANDS, n: int = CEPSTRA) -> np.ndarray:
    """Mel cepstra, frames x ``n``: cosine transform of the bands' power in dB."""
    mel, turn = mel_matrix(size, rate, bands), cosine_matrix(bands, n)
    blocks = [10 * np.log10(np.maximum(m**2 @ mel.T, 1e-10)) @ turn.T for _, m in magnitudes(x, size, hop, np.hamming(size))]
    return np.concatenate(blocks)


def pitch_classes(x: np.ndarray, rate: int, size: int, hop: int) -> np.ndarray:
    """Pitch class profiles, frames x 12 from A, the strongest class 1; silence is 0.

    The strongest spectral peaks are placed by a parabola through their neighbours and
    give their power to the two nearest classes.
    """
    out = []
    lowest, highest = max(1, int(PEAK_LOW * size / rate)), min(size // 2 - 1, int(PEAK_HIGH * size / rate))
    for _, m in magnitudes(x, size, hop, np.blackman(size)):
        mid, left, right = m[:, lowest : highest + 1], m[:, lowest - 1 : highest], m[:, lowest + 1 : highest + 2]
        row, col = np.nonzero((mid > left) & (mid >= right) & (mid > PEAK_FLOOR))
        level = mid[row, col]
        order = np.lexsort((col, -level, row))
        first = np.searchsorted(row[order], np.arange(len(m)))
        order = order[np.arange(len(order)) - first[row[order]] < PEAKS]
        row, col, level = row[order], col[order], level[order]
        a, b, c = (np.log(np.maximum(s[row, col], 1e-12)) for s in (left, mid, right))
        shift = np.where(a - 2 * b + c < 0, 0.5 * (a - c) / np.minimum(a - 2 * b + c, -1e-12), 0.0)
        pitch = 12 * np.log2((lowest + col + np.clip(shift, -0.5, 0.5)) * rate / size / TUNING)
        below = np.floor(pitch).astype(np.int64)
        profile = np.zeros((len(m), 12))
        np.add.at(profile, (row, below % 12), level**2 * (1 - (pitch - below)))
        np.add.at(profile, (row, (below + 1) % 12), level**2 * (pitch - below))
        top = profile.max(axis=1, keepdims=True)
        out.append(np.where(top > 0, profile / np.where(top > 0, top, 1), 0.0))
    return np.concatenate(out)


def onset_strength(x: np.ndarray, rate: int, size: int, hop: int) -> np.ndarray:
    """How much louder the mel bands get from frame to frame, on average, one value a frame."""
    mel = mel_matrix(size, rate)
    blocks = [10 * np.log10(np.maximum(m**2 @ mel.T, 1e-7)) for _, m in magnitudes(x, size, hop, np.hanning(size))]
    level = np.concatenate(blocks)
    return np.maximum(0, np.diff(level, axis=0, prepend=level[:1])).mean(axis=1)


def tempo(onsets: np.ndarray, per_second: float) -> float | None:
    """Beats a minute from the autocorrelation of the onsets; None without a repetition."""
    # A period is no whole number of frames: smoothed onsets meet at its multiples all the same.
    x = np.convolve(onsets, np.hanning(2 * SMOOTH + 1), "same")[: len(onsets)] if len(onsets) else onsets
    x = x - x.mean() if len(x) else x
    first, last = int(np.ceil(60 * per_second / TEMPO_HIGH)), int(60 * per_second / TEMPO_LOW)
    last = min(last, len(x) - 2)
    if last <= first or not np.any(x):
        return None
    spectrum = np.fft.rfft(x, 2 * len(x))
    auto = np.fft.irfft(spectrum * spectrum.conj())[: last + 2]
    lags = np.arange(first, last + 1)
    weight = np.exp(-0.5 * (np.log2(60 * per_second / lags / TEMPO_CENTRE) / TEMPO_WIDTH) ** 2)
    at = int(np.argmax(auto[lags] * weight))
    lag = lags[at]
    if auto[lag] <= 0:
        return None
    a, b, c = auto[lag - 1 : lag + 2]
    bend = a - 2 * b + c
    return float(60 * per_second / (lag + (np.clip(0.5 * (a - c) / bend, -0.5, 0.5) if bend < 0 else 0.0)))


def beat_frames(onsets: np.ndarray, per_second: float, bpm: float) -> np.ndarray:
    """Frames of the beats: the path of strong onsets with steps near the tempo.

    The best path that ends in a frame comes from one between half and twice a period
    before it; uneven steps cost the square of their logarithm.
    """
    period = 60 * per_second / bpm
    spread = np.exp(-0.5 * (np.arange(-int(period), int(period) + 1) * 32 / period) ** 2)
    score = np.convolve(onsets / (onsets.std() or 1.0), spread, "same")[: len(onsets)]
    back = np.arange(-int(round(2 * period)), -max(1, int(round(period / 2))) + 1)
    cost = -EVENNESS * np.log(-back / period) ** 2
    # The nearest beat before a frame is -back[-1] frames away: so many frames are settled at once.
    reach, step = -int(back[0]), -int(back[-1])
    total, before = np.concatenate([np.full(reach, -np.inf), score]), np.full(len(score), -1)
    ways = np.lib.stride_tricks.sliding_window_view(total, len(back))
    for t in range(0, len(score), step):
        n = min(step, len(score) - t)
        from_ = ways[t : t + n] + cost
        best = from_.argmax(axis=1)
        most = from_[np.arange(n), best]
        found = most > 0
        total[reach + t : reach + t + n][found] = (score[t : t + n] + most)[found]
        before[t : t + n][found] = (np.arange(t, t + n) + back[best])[found]
    total = total[reach:]
    if not len(score) or not np.any(onsets):
        return np.zeros(0, np.int64)
    tail = max(0, len(total) - int(round(period)))
    path = [tail + int(np.argmax(total[tail:]))]
    while before[path[-1]] >= 0:
        path.append(int(before[path[-1]]))
    return np.array(path[::-1])
