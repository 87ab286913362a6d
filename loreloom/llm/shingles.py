"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of anything but ASCII white space, A-Z lower-cased.  A text is
read as bytes in pieces of about ``PIECE`` bytes that end between words, so
memory does not grow with the length of a text beyond 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 19
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


#: Independent odd factors: one for each place in a shingle, and one per length of a short text.
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class WordReader:
    """Hashes of the words of texts; keeps tables of powers between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def of_bytes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of ``data`` and their first bytes' positions."""
        if len(self.up) <= len(data):
            self.up, self.down = powers(_BASE, len(data) + 1), powers(_INVERSE, len(data) + 1)
        codes = np.frombuffer(data, dtype=np.uint8)
        blank = _BLANK[codes]
        edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.up[: len(codes)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts]), starts

    def words(self, text: str | None) -> np.ndarray:
        return next(self.groups([text]))[0]

    def groups(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word hashes, words per text) for runs of texts of about PIECE bytes, in order."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
            if held and size + len(data) > PIECE:
                yield self._group(held)
                held, size = [], 0
            held.append(data)
            size += len(data) + 1
        if held:
            yield self._group(held)

    def _group(self, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(held) == 1 and len(held[0]) > PIECE:
            parts = [self.of_bytes(piece)[0] for piece in _pieces(held[0])]
            hashes = np.concatenate(parts)
            return hashes, np.array([len(hashes)])
        hashes, starts = self.of_bytes(b" ".join(held))
        offsets = np.cumsum([0] + [len(data) + 1 for data in held])
        return hashes, np.diff(np.searchsorted(starts, offsets))


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; the whole sequence if there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix(np.sum(words * _FACTORS[:n], keepdims=True, dtype=np.uint64) + _FACTORS[63 - n])
    total = words[: n - k + 1] * _FACTORS[0]
    for place in range(1, k):
        total += words[place : n - k + 1 + place] * _FACTORS[place]
    return mix(total)
