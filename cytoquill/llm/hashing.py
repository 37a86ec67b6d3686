"""Words and word shingles of texts as 64-bit hashes, computed over whole byte buffers with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. The hash of a word is a polynomial over
random byte values modulo 2^64, taken as a difference of running sums, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
#: Texts are hashed in pieces of about this many bytes, cut between words: it bounds the working memory.
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between alphanumeric words: all ASCII but digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPOTS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(buffer: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte buffer."""
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space[buffer], [True]))))
    return edges[::2], edges[1::2]


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the given spans of a byte buffer."""
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTES[buffer] * _power(_BASE, len(buffer)), dtype=np.uint64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(_INVERSE, len(buffer) + 1)[starts]
    return mix(value + (ends - starts).astype(np.uint64))


def _hash_buffer(buffer: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte buffer."""
    starts, ends = word_bounds(buffer, space)
    return hash_spans(buffer, starts, ends), starts


def _pieces(text: bytes, space: np.ndarray) -> Iterator[bytes]:
    """The text cut between words into pieces of about PIECE bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > PIECE:
        window = np.frombuffer(text, np.uint8, min(len(text) - at, 64 * PIECE) - PIECE, at + PIECE)
        gap = np.flatnonzero(space[window[:PIECE]])
        if not len(gap):
            gap = np.flatnonzero(space[window])
        if not len(gap):
            break
        end = at + PIECE + int(gap[0])
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: Sequence[str | None], space: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Over groups of texts: first index, end index, word hashes, and the bounds of each text's words in them.

    NULL counts as an empty text. Texts are joined into buffers of about PIECE bytes, so that short texts share
    one pass and long ones are hashed piece by piece. `space` marks the bytes between words; a blank is one of them.
    """
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if len(data) > PIECE:
            if held:
                yield first, i, *_together(held, space)
            words = np.concatenate([_hash_buffer(np.frombuffer(p, np.uint8), space)[0] for p in _pieces(data, space)])
            yield i, i + 1, words, np.array([0, len(words)])
            first, held, size = i + 1, [], 0
            continue
        held.append(data)
        size += len(data) + 1
        if size > PIECE:
            yield first, i + 1, *_together(held, space)
            first, held, size = i + 1, [], 0
    if held:
        yield first, first + len(held), *_together(held, space)


def _together(held: list[bytes], space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b" ".join(held), np.uint8)
    offsets = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in held], out=offsets[1:])
    words, starts = _hash_buffer(buffer, space)
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of one text, repeats included; a shorter text is one shingle, none is none."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * _SPOTS[j]
    return mix(total + np.uint64(k))
