"""Word shingles of texts as 64-bit hashes, by array operations over many texts at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _STEP[0]
    x = (x ^ (x >> np.uint64(27))) * _STEP[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word (A-Z lower-cased, parted by ASCII white space), and how many words each text has."""
    coded = [t.encode() if t else b"" for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*coded, b""]), np.uint8)] if coded else np.empty(0, np.uint8)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    first = np.flatnonzero(begins)
    doc_end = np.cumsum(np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded)))
    counts = np.diff(np.searchsorted(first, doc_end, "left"), prepend=0)
    if not len(first):
        return np.empty(0, np.uint64), counts
    letters = data[~space].astype(np.uint64)
    at = np.cumsum(~space)[first] - 1  # each word's place among the letters
    sizes = np.diff(at, append=len(letters))
    powers = np.ones(int(sizes.max()), np.uint64)
    np.multiply.accumulate(np.concatenate([powers[:1], np.full(len(powers) - 1, _BASE)]), out=powers)
    place = np.arange(len(letters)) - np.repeat(at, sizes)
    letters += np.uint64(1)
    letters *= powers.take(place)
    return mixed(np.add.reduceat(letters, at) + sizes.astype(np.uint64) * _STEP[2]), counts


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of ``width`` words; all words as one where there are fewer; none without words."""
    words, counts = word_hashes(texts)
    n = len(words) - width + 1
    joined = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        if n > 0:
            joined = mixed(joined + words[k : k + n] * _STEP[3])
    found = []
    end = 0
    for count in counts.tolist():
        begin, end = end, end + count
        if count >= width:
            found.append(np.unique(joined[begin : end - width + 1]))
        elif count:
            code = np.zeros(1, np.uint64)
            for k in range(begin, end):
                code = mixed(code + words[k : k + 1] * _STEP[4])
            found.append(code)
        else:
            found.append(np.empty(0, np.uint64))
    return found
