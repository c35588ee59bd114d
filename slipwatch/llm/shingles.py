"""Five-word shingles of whole texts as 64-bit hashes, computed over arrays of bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

WORDS = 5
GROUPS = 256  # groups of shingles whose counts are a document's point
_rng = np.random.default_rng(19)
_BYTE = _rng.integers(1, 2**63, 256, np.int64).astype(np.uint64) | np.uint64(1)
_SLOT = _rng.integers(1, 2**63, WORDS, np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
KEPT_POWERS = 1 << 18  # 4 MB that a worker keeps
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n places; long lists are not kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = 1 << max(16, int(n - 1).bit_length())
    made = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if size <= KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: runs of other characters than blanks, A-Z lower-cased."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    solid = np.concatenate(([False], ~_BLANK[raw], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _scale(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    words = word_hashes(text or "")
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return mix((words * _SLOT[:n]).sum(keepdims=True) + np.uint64(n))
    total = words[: n - WORDS + 1] * _SLOT[0]
    for k in range(1, WORDS):
        total = total + words[k : n - WORDS + 1 + k] * _SLOT[k]
    return np.unique(mix(total))


def point(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many shingles fall into each group, in 16 bits a count, or 32 where a text needs them."""
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint16 if counts.max(initial=0) <= 0xFFFF else np.uint32)


def stored_point(shingles: np.ndarray, groups: int = GROUPS) -> bytes:
    """The bytes of a point, in 8 bits a count where they suffice: points are most of what is shuffled."""
    counts = point(shingles, groups)
    return (counts.astype(np.uint8) if counts.max(initial=0) <= 0xFF else counts).tobytes()


def read_points(stored: Sequence[bytes], groups: int = GROUPS) -> np.ndarray:
    """The points whose bytes are `stored`, one row each."""
    kinds = {groups: np.uint8, 2 * groups: np.uint16, 4 * groups: np.uint32}
    sizes = np.array([len(x) for x in stored], np.int64)
    out = np.empty((len(stored), groups), np.int32 if sizes.max(initial=0) <= 2 * groups else np.int64)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        out[own] = np.frombuffer(b"".join([stored[k] for k in own]), kinds[int(size)]).reshape(len(own), groups)
    return out


def set_id(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set, whatever its order."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(shingles)) * np.uint64(_BASE)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
