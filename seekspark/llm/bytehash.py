"""Hashes of all words of many texts at once, in numpy.

A word's hash is a polynomial in its bytes modulo 2**64 over random byte values, cut out of running sums of the
whole buffer and then mixed, so the cost does not depend on the number of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at a time; longer texts are cut between words.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        both = []
        for base in (_BASE, _INVERSE):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a))
        _powers[:] = both
    return _powers[0], _powers[1]


#: White space as the contracts have it: a space and \t to \r.
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits of ASCII and every byte of other letters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _pieces(raw: Iterable[bytes], is_word: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(text number, bytes), long texts in several pieces that end between words."""
    for i, b in enumerate(raw):
        at = 0
        while len(b) - at > CHUNK:
            end = at + CHUNK
            while end > at:
                back = max(at, end - 4096)
                gaps = np.flatnonzero(~is_word[np.frombuffer(b, np.uint8, end - back, back)])
                if len(gaps):
                    end = back + int(gaps[-1]) + 1
                    break
                end = back
            if end <= at:  # one huge word
                break
            yield i, b[at:end]
            at = end
        yield i, b[at:] if at else b


def groups(raw: list[bytes], is_word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, lengths, text numbers) of about CHUNK bytes each; a byte that is in no word ends each text."""
    gap = bytes([int(np.flatnonzero(~is_word)[0])])
    own, size = [], 0
    for item in _pieces(raw, is_word):
        if own and size + len(item[1]) > CHUNK:
            yield _joined(own, gap)
            own, size = [], 0
        own.append(item)
        size += len(item[1]) + 1
    if own:
        yield _joined(own, gap)


def _joined(own: list[tuple[int, bytes]], gap: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(gap.join(b for _, b in own) + gap, np.uint8)
    return buf, np.array([len(b) + 1 for _, b in own]), np.array([i for i, _ in own])


def spans_of(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    inside = np.concatenate(([False], is_word[buf], [False])).view(np.int8)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class Sums:
    """Running sums of a buffer, from which any span's hash is cut."""

    def __init__(self, buf: np.ndarray):
        power, self.inverse = _tables(len(buf))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[buf] * power[: len(buf)])))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: list[bytes], is_word: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, text by text, and the number of words of each text."""
    parts, counts = [], np.zeros(len(raw), np.int64)
    for buf, lengths, texts in groups(raw, is_word):
        starts, ends = spans_of(buf, is_word)
        parts.append(Sums(buf).hashes(starts, ends))
        of = texts[np.searchsorted(np.cumsum(lengths), starts, side="right")]
        counts += np.bincount(of, minlength=len(raw))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts
