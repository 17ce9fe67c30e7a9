"""Word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

SIZE = 5
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# A-Z in lower case, ASCII white space as blanks: words as the contracts define them.
WORDS_BETWEEN_SPACE = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 64, as many as were ever needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                factors = np.full(max(n, SEGMENT + 1024), base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up, self.down


def _segments(data: np.ndarray) -> list[tuple[int, int]]:
    """Pieces of some 256 kB that end at blanks; a longer word stays in one piece."""
    cuts, at = [], 0
    while len(data) - at > SEGMENT:
        blanks = np.flatnonzero(data[at : at + SEGMENT] == 32)
        if len(blanks):
            stop = at + int(blanks[-1]) + 1
        else:
            later = np.flatnonzero(data[at + SEGMENT :] == 32)
            stop = at + SEGMENT + int(later[0]) + 1 if len(later) else len(data)
        cuts.append((at, stop))
        at = stop
    return [*cuts, (at, len(data))]


def hashed_words(texts: list[str | None], powers: Powers, table: bytes = WORDS_BETWEEN_SPACE) -> list[np.ndarray]:
    """64-bit hashes of each text's words, in order; ``table`` maps bytes, and blanks part words.

    All texts are hashed at once from running sums, so no word becomes an object of its own.
    """
    parts = [t.encode() if t else b"" for t in texts]
    data = np.frombuffer(b" ".join(parts).translate(table), np.uint8)
    hashes, begins = [], []
    for at, stop in _segments(data):
        piece = data[at:stop]
        edges = np.flatnonzero(np.diff(piece != 32, prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        up, down = powers.reach(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        hashes.append(mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        begins.append(start + at)
    offsets = np.cumsum([len(p) + 1 for p in parts])[:-1]
    return np.split(np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets))


def batches_of(texts: list[str | None], characters: int = SEGMENT) -> list[tuple[int, int]]:
    """Runs of texts (first, last) of some 256 kB; a longer text is a run of its own."""
    runs, first, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= characters:
            runs.append((first, i + 1))
            first, size = i + 1, 0
    return [*runs, (first, len(texts))] if first < len(texts) else runs


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    total = hashes[:n].copy()
    for k in range(1, size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mixed(total + np.uint64(size))


def shingle_set(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, min(size, len(hashes))))


def shingle_sets(texts: list[str | None], powers: Powers) -> list[np.ndarray]:
    return [shingle_set(h) for a, b in batches_of(texts) for h in hashed_words(texts[a:b], powers)]


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set, as two signed integers."""
    digest = hashlib.md5(shingles.tobytes()).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
