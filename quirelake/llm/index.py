"""Keys of a symmetric-delete index."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def delete_hashes(word: str) -> np.ndarray:
    """Hashes of a word and of all forms with one character deleted, in time in proportion to its length.

    Two words meet if they are equal or one deletion in either or both makes them equal; whoever meets by a collision has
    to fail the comparison of the words themselves.
    """
    c = np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(7)
    n = len(c)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
        before = np.r_[np.uint64(0), np.cumsum(c * power[:n])]  # of the first i characters
        # behind a deleted character every power is one less
        less = before[:n] + (before[n] - before[1:]) * _INVERSE
        length = np.r_[np.uint64(n), np.full(n, np.uint64(max(n, 1) - 1))]
        return np.unique(np.r_[before[n], less] * np.uint64(0xC2B2AE3D27D4EB4F) ^ length).view(np.int64)


def deletes(word: str) -> list[str]:
    """A word and all forms with one character deleted, as keys.

    Forms of long words are filed by their hashes, as their characters would take space in proportion to the square of the length;
    words of the two lengths at the border are filed both ways, so no pair that differs by one deletion in either or both is missed.
    """
    out = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) <= BORDER + 1 else set()
    return sorted(out.union(f"#{h}" for h in delete_hashes(word).tolist()) if len(word) >= BORDER else out)


BORDER = 64
