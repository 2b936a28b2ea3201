"""Words of texts, as bytes."""

from itertools import repeat

import numpy as np
import xxhash

_KEPT = frozenset(range(48, 58)) | frozenset(range(97, 123)) | frozenset(range(128, 256))
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def word_list(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TO_WORDS).split()


def spaced_words(text: bytes) -> list[bytes]:
    """What stands between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def hashes(items, n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of byte strings."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, items, repeat(seed)), np.uint64, n)
