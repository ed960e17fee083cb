"""Word and shingle hashes of many texts at once: array passes over the bytes of a batch instead of a loop over words."""

from __future__ import annotations

import numpy as np

# a word: [^\x20\x09-\x0D]+
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (three xor-shift-multiply rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# one random number per byte value, by rule
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept for the largest batch seen."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        base = int(_ODD) | 1
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, value in (("_POWERS", base), ("_INVERSES", inverse)):
                steps = np.full(size, np.uint64(value), dtype=np.uint64)
                steps[0] = 1
                globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS, _INVERSES


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash H with H[i] over the first i bytes (len + 1 numbers)."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), equal for equal bytes wherever they stand; the length takes part."""
    _, inverse = _powers(len(running))
    with np.errstate(over="ignore"):
        return mix((running[end] - running[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


# alternatively: ASCII letters and digits and everything beyond ASCII
_MARK = np.ones(256, dtype=bool)
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = _MARK[128:] = False


def words(data: np.ndarray, ends: np.ndarray, marks_divide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; ``ends`` are the n + 1 offsets of the texts in ``data``.

    Words are divided by ASCII white space, with ``marks_divide`` also by ASCII punctuation.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    letter = ~(_MARK if marks_divide else _SPACE)[data]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, letter[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, letter[1:]
    first = ends[:-1][ends[:-1] < len(data)]
    before[first] = False
    last = ends[1:][ends[1:] > 0] - 1
    after[last] = False
    start = np.flatnonzero(letter & ~before)
    end = np.flatnonzero(letter & ~after) + 1
    return start, end, np.searchsorted(ends, start, side="right") - 1


def shingles(word_hash: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``width`` words within a text, and the number of words per text.

    A text with fewer words, but at least one, gives its whole word sequence as one run.
    """
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        coefficient = mix((np.arange(width, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        n = len(word_hash) - width + 1
        if n > 0:
            total = np.zeros(n, dtype=np.uint64)
            for i in range(width):
                total += word_hash[i : i + n] * coefficient[i]
            whole = text[:n] == text[width - 1 :]
            hashes, owner = mix(total[whole] + np.uint64(width)), text[:n][whole]
        else:
            hashes, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            extra = np.zeros(len(short), dtype=np.uint64)
            for i in range(width - 1):
                has = count[short] > i
                at = np.minimum(first[short] + i, len(word_hash) - 1)
                extra += np.where(has, word_hash[at] * coefficient[i], np.uint64(0))
            hashes = np.concatenate([hashes, mix(extra + count[short].astype(np.uint64))])
            owner = np.concatenate([owner, short])
    return hashes, owner, count


def distinct_per_text(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order of text and hash."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        keep = np.ones(len(hashes), dtype=bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[keep], owner[keep]
    return hashes, owner
