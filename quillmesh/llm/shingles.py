"""Word shingles and their hashes, per text, in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII characters that are neither letters nor digits.
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of anything but ASCII characters that are neither
    letters nor digits (null: none)."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def spans(words: list[bytes], k: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each k-word shingle starts and ends
    there; fewer words: the whole sequence; none: no shingle."""
    joined = b" ".join(words)
    if not words:
        return joined, [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(k, len(words))
    return joined, starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included, as unsigned 64-bit."""
    joined, starts, ends = spans(words, k)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))


def shingle_set(words: list[bytes], k: int) -> set[bytes]:
    """The distinct k-word shingles."""
    joined, starts, ends = spans(words, k)
    return {joined[a:b] for a, b in zip(starts, ends)}
