"""Numpy kernels used inside Arrow batches.

Every function takes a whole batch; Spark partitions the batches. ``models``
are rows of d means followed by d·d covariances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Fixed value: cut-off of the first-order high-pass, relative to Nyquist.
HIGH_PASS_CUTOFF = 0.1

# Bytes of symbols in a block of texts, and numbers in a block of correlations.
SYMBOL_BYTES = 64 << 20
BLOCK_VALUES = 1 << 21

# Below this many running pairs big integers beat numpy's cost per operation.
FEW_PAIRS = 96


def euclidean_to(batch: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = batch - query
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class GaussianBatch:
    """Per-model terms that do not depend on the other side of a pair."""

    def __init__(self, models: np.ndarray):
        self.d = d = int(round((np.sqrt(1 + 4 * models.shape[1]) - 1) / 2))
        if d * (d + 1) != models.shape[1]:
            raise ValueError(f"a model of {models.shape[1]} numbers is no mean and covariance")
        self.mean = models[:, :d]
        self.cov = models[:, d:].reshape(-1, d, d)
        rows, cols = np.triu_indices(d)
        self.flat = np.concatenate([self.mean, self.cov[:, rows, cols]], axis=1)

    def invert(self) -> None:
        known = np.isfinite(self.cov).all(axis=(1, 2))
        usable = np.where(known[:, None, None], self.cov, 0.0)
        self.invertible = known & (np.linalg.matrix_rank(usable) == self.d)
        safe = np.where(self.invertible[:, None, None], usable, np.eye(self.d))
        self.diag_cov = np.einsum("nii->ni", safe)
        self.diag_inv = np.einsum("nii->ni", np.linalg.inv(safe))

    def log_dets(self) -> None:
        self.log_det = log_det(self.cov)
        self.second_moment = self.cov + self.mean[:, None, :] ** 2


def log_det(matrices: np.ndarray) -> np.ndarray:
    """ln det; NaN below zero and -inf at zero, as the logarithm has it."""
    with np.errstate(all="ignore"):
        return np.log(np.linalg.det(matrices))


def sym_kl_to(batch: GaussianBatch, query: GaussianBatch, row: int) -> np.ndarray:
    if not query.invertible[row]:
        return np.full(len(batch.mean), np.inf)
    gap = (batch.mean - query.mean[row]) ** 2
    terms = (
        batch.diag_cov * query.diag_inv[row]
        + query.diag_cov[row] * batch.diag_inv
        + (batch.diag_inv + query.diag_inv[row]) * gap
    )
    return np.where(batch.invertible, terms.sum(axis=1) / 4 - batch.d / 2, np.inf)


def jensen_shannon_to(batch: GaussianBatch, query: GaussianBatch, row: int) -> np.ndarray:
    """Divergence to one query model.

    The squared means enter as one row added to every row of the covariance, not
    as an outer product. That is the contract of this distance.
    """
    middle = (batch.mean + query.mean[row]) / 2
    mixed = (batch.second_moment + query.second_moment[row]) / 2 - middle[:, None, :] ** 2
    with np.errstate(invalid="ignore"):
        divergence = log_det(mixed) / 2 - batch.log_det / 4 - query.log_det[row] / 4
    return np.abs(np.where(np.isnan(divergence), np.inf, divergence))


def high_pass_max(signals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Largest value of the high-passed rows, each row up to its own length.

    Row offsets are removed first. First-order Butterworth, bilinear transform:
    the loop runs along time only, all rows of the batch step together.
    """
    warped = np.tan(np.pi * HIGH_PASS_CUTOFF / 2)
    gain, feedback = 1 / (1 + warped), (1 - warped) / (1 + warped)
    steps = np.diff(signals, axis=1, prepend=signals[:, :1]).T * gain
    level = np.zeros(signals.shape[0])
    best = np.full(signals.shape[0], -np.inf)
    for t, step in enumerate(steps):
        level = step + feedback * level
        best = np.where(t < lengths, np.maximum(best, level), best)
    return best


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def edit_distances_to(texts: list[str], queries: list[str], block: int = 1 << 15) -> list[np.ndarray]:
    """Levenshtein distances of all texts to each query, bit-parallel.

    A column of the edit matrix is kept as bits that say where it steps up or
    down (Myers 1999), 64 rows to a word. All pairs of a block advance together,
    longest text first, so that the running ones are always a prefix. Queries of
    similar length share a block.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = [lengths.astype(float) for _ in queries]
    groups: dict[int, list[int]] = {}
    for n, query in enumerate(queries):
        if query:
            groups.setdefault(1 << ((len(query) - 1) // 64).bit_length(), []).append(n)
    order = np.argsort(-lengths, kind="stable")
    for words, members in groups.items():
        codes = [_codes(queries[n]) for n in members]
        alphabet = np.unique(np.concatenate(codes))
        match = np.zeros((words, len(alphabet) + 1, len(members)), dtype=np.uint64)
        valid = np.zeros((words, len(members)), dtype=np.uint64)
        for n, pattern in enumerate(codes):
            at = np.arange(len(pattern))
            bits = np.uint64(1) << (at % 64).astype(np.uint64)
            np.bitwise_or.at(match, (at // 64, np.searchsorted(alphabet, pattern) + 1, n), bits)
            np.bitwise_or.at(valid, (at // 64, n), bits)
        small = np.uint16 if len(alphabet) < 1 << 16 else np.uint32
        start = 0
        while start < len(order):
            longest = max(1, int(lengths[order[start]]))
            step = max(1, min(block // len(members), SYMBOL_BYTES // (longest * np.dtype(small).itemsize)))
            rows = order[start : start + step]
            start += step
            symbols = np.zeros((int(lengths[rows[0]]), len(rows)), dtype=small)
            for n, row in enumerate(rows):
                text = _codes(texts[row])
                found = np.minimum(np.searchsorted(alphabet, text), len(alphabet) - 1)
                symbols[: len(text), n] = np.where(alphabet[found] == text, found + 1, 0)
            ups, downs = _edit_columns(symbols, lengths[rows], match)
            climb = np.bitwise_count(ups & valid[:, None, :]).astype(np.int64).sum(axis=0)
            climb -= np.bitwise_count(downs & valid[:, None, :]).astype(np.int64).sum(axis=0)
            for n, member in enumerate(members):
                out[member][rows] = lengths[rows] + climb[:, n]
    return out


def _edit_columns(symbols, sizes, match) -> tuple[np.ndarray, np.ndarray]:
    """The step bits of every pair's last column: (words, texts, queries)."""
    one, last = np.uint64(1), np.uint64(63)
    words, _, width = match.shape
    ups = np.full((words, len(sizes) * width), ~np.uint64(0))
    downs = np.zeros_like(ups)
    running = np.searchsorted(-sizes, -np.arange(len(symbols)), side="left")
    for t, live in enumerate(running):
        chosen, end = symbols[t, :live], live * width
        if end < FEW_PAIRS:
            _finish_pairs(symbols[t:, :live], sizes[:live] - t, match, ups, downs)
            break
        rise, fall = one, None
        for w in range(words):
            up, down, eq = ups[w, :end], downs[w, :end], match[w][chosen].ravel()
            vertical = eq | down
            if fall is not None:
                eq |= fall
            horizontal = (((eq & up) + up) ^ up) | eq
            rises, falls = down | ~(horizontal | up), up & horizontal
            next_rise, next_fall = rises >> last, falls >> last
            rises, falls = (rises << one) | rise, falls << one
            if fall is not None:
                falls |= fall
            ups[w, :end] = falls | ~(vertical | rises)
            downs[w, :end] = rises & vertical
            rise, fall = next_rise, next_fall
    return ups.reshape(words, -1, width), downs.reshape(words, -1, width)


def _finish_pairs(symbols, sizes, match, ups, downs) -> None:
    """The remaining steps of a few pairs, each column as one big integer."""
    words, kinds, width = match.shape
    full = (1 << 64 * words) - 1
    tables = [[int.from_bytes(match[:, s, q].tobytes(), "little") for s in range(kinds)] for q in range(width)]
    for n, size in enumerate(sizes):
        text = symbols[:size, n].tolist()
        for q, table in enumerate(tables):
            at = n * width + q
            up, down = (int.from_bytes(bits[:, at].tobytes(), "little") for bits in (ups, downs))
            for symbol in text:
                eq = table[symbol]
                vertical = eq | down
                horizontal = ((((eq & up) + up) ^ up) | eq) & full
                rises = (down | (full & ~(horizontal | up))) << 1 | 1
                up, down = ((up & horizontal) << 1 | (full & ~(vertical | rises))) & full, rises & vertical
            for bits, value in ((ups, up), (downs, down)):
                bits[:, at] = np.frombuffer(value.to_bytes(8 * words, "little"), dtype=np.uint64)


def _fft_size(length: int) -> int:
    return 1 << max(int(length) - 1, 1).bit_length()


class ChromaQuery:
    """A 12-row query matrix with the spectra already asked for."""

    def __init__(self, vec: np.ndarray):
        self.matrix = np.asarray(vec, dtype=float).reshape(12, -1)
        self.length = self.matrix.shape[1]
        self.spectra: dict = {}

    def spectrum(self, size: int) -> np.ndarray:
        if size not in self.spectra:
            self.spectra[size] = np.fft.rfft(self.matrix, size, axis=1)
        return self.spectra[size]


def _pad(items: list[np.ndarray], rows: int, size: int) -> np.ndarray:
    block = np.zeros((len(items), rows, size))
    for n, item in enumerate(items):
        block[n, :, : item.shape[1]] = item
    return block


def chroma_xcorr_to(items: list[np.ndarray], query: ChromaQuery, max_values: int = 1 << 22) -> np.ndarray:
    """Peak of the high-passed, row-summed cross-correlation to one query.

    The longer matrix is the one slid over, the query on equal lengths; the
    output is as long as the longer one. Rows are summed in the frequency
    domain, so one inverse transform per item is enough. Items of one FFT size
    go together, in blocks of bounded memory.
    """
    out = np.empty(len(items))
    lengths = np.array([item.shape[1] for item in items])
    sizes = np.array([_fft_size(n + query.length - 1) for n in lengths])
    for size in np.unique(sizes):
        spectrum = query.spectrum(int(size))
        members = np.flatnonzero(sizes == size)
        step = max(1, max_values // (12 * int(size)))
        for at in range(0, len(members), step):
            block = members[at : at + step]
            own = np.fft.rfft(_pad([items[i] for i in block], 12, int(size)), axis=2)
            item_first = lengths[block] > query.length
            product = own * spectrum.conj()
            product = np.where(item_first[:, None, None], product, product.conj()).sum(axis=1)
            circular = np.fft.irfft(product, int(size), axis=1)
            longer = np.maximum(lengths[block], query.length)
            shorter = np.minimum(lengths[block], query.length)
            # lag of the first output: the shorter one overlaps by half
            lags = np.arange(longer.max()) - (shorter // 2)[:, None]
            signals = np.take_along_axis(circular, lags % int(size), axis=1)
            out[block] = high_pass_max(signals, longer)
    return out


def _by_length(items: list[np.ndarray], values: int) -> Iterator[np.ndarray]:
    """Places of items of one length, in blocks of bounded size."""
    lengths = np.array([item.size for item in items])
    for length in np.unique(lengths):
        members = np.flatnonzero(lengths == length)
        step = max(1, BLOCK_VALUES // max(1, values + int(length)))
        for at in range(0, len(members), step):
            yield members[at : at + step]


def _correlations(items: np.ndarray, query: np.ndarray, item_first: bool) -> np.ndarray:
    """Full 2-D correlations of a stack of items with a query, lag (0, 0) at the second one's size less 1."""
    shape = items.shape[1] + query.shape[0] - 1, items.shape[2] + query.shape[1] - 1
    a, b = (items, query[None]) if item_first else (query[None], items)
    spectrum = np.fft.rfft2(a, shape) * np.fft.rfft2(b[:, ::-1, ::-1], shape)
    return np.fft.irfft2(spectrum, shape)


def chroma_xcorr_2d_to(items: list[np.ndarray], query: ChromaQuery) -> np.ndarray:
    """Peak of the 2-D correlation, cropped to the longer matrix around its centre."""
    out = np.empty(len(items))
    for block in _by_length(items, 24 * query.length):
        stack = np.stack([items[i] for i in block])
        item_first = stack.shape[2] > query.length
        full = _correlations(stack, query.matrix, item_first)
        long_, short = (stack.shape[2], query.length) if item_first else (query.length, stack.shape[2])
        top, left = (12 - 1) // 2, (short - 1) // 2
        out[block] = full[:, top : top + 12, left : left + long_].max(axis=(1, 2))
    return out


def chroma_xcorr_full_to(items: list[np.ndarray], query: ChromaQuery) -> np.ndarray:
    """High-passed peak of the pitch-shift line that holds the largest 2-D value.

    The flat vectors are read as beats x 12 here.
    """
    out, own = np.empty(len(items)), query.matrix.reshape(-1, 12)
    for block in _by_length(items, 24 * query.length):
        stack = np.stack([items[i].reshape(-1, 12) for i in block])
        full = _correlations(stack, own, stack.shape[1] > len(own))
        best = full.max(axis=1).argmax(axis=1)
        lines = np.take_along_axis(full, best[:, None, None], axis=2)[:, :, 0]
        out[block] = high_pass_peak(np.diff(lines, axis=1, prepend=0.0))
    return out


def high_pass_peak(steps: np.ndarray) -> np.ndarray:
    """Largest value of the filter of ``high_pass_max``, all rows together, for rows given as steps."""
    warped = np.tan(np.pi * HIGH_PASS_CUTOFF / 2)
    gain, feedback = 1 / (1 + warped), (1 - warped) / (1 + warped)
    level, best = np.zeros(len(steps)), np.full(len(steps), -np.inf)
    for step in steps.T * gain:
        level = step + feedback * level
        best = np.maximum(best, level)
    return best
