"""Word shingles of UTF-8 texts, hashed without a Python object per word."""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` lower-cased (A-Z) words joined by one space, in order and with repeats;
    of the whole sequence if it has fewer words, of nothing if it has none."""
    raw = np.frombuffer(text.lower(), np.uint8)  # bytes.lower() changes A-Z only
    space = _SPACE[raw]
    keep = ~space
    keep[1:] |= keep[:-1].copy()  # a word's bytes and one separator behind it
    joined, space = np.where(space, np.uint8(0x20), raw)[keep], space[keep]
    ends = np.flatnonzero(space)
    if len(joined) and not space[-1]:
        ends = np.append(ends, len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    if len(ends) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    data, hashed = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((hashed(data[a:z], seed) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
