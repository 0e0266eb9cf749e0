"""Hashes of words and grams, which find candidates, and the digest that decides about spans of text.

The 64-bit hashes only bring candidates together: two different words or grams that share one cost work, no right result. Whatever
text is removed for being equal to another is compared as bytes or by ``digests``: BLAKE2b of the span itself, 128 bits.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
#: Words of more bytes are hashed one by one.
_SHORT = 64
#: The bytes of a little-endian number of eight that belong to a word of so many bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Independent odd multipliers, one for each place of a gram.
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values, which are hashes themselves."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = values[:n] * _PLACES[0]
    for i in range(1, size):
        out += values[i : n + i] * _PLACES[i]
    return mix(out)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words between white space of a text in UTF-8.

    A word's hash takes in its length and eight bytes a step, each step mixed before the next; long words get BLAKE2b.
    """
    raw = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_GAP[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = ends - starts
    eight = np.ndarray((len(raw) + 1,), "<u8", text + bytes(8), strides=(1,))  # the number at each byte
    h = mix(size.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    if len(h):
        h = mix(h ^ (eight[starts] & _MASKS[np.minimum(size, 8)]))
    for j in range(8, _SHORT, 8):
        more = np.flatnonzero((size > j) & (size <= _SHORT))
        if not len(more):
            break
        h[more] = mix(h[more] ^ (eight[starts[more] + j] & _MASKS[np.minimum(size[more] - j, 8)]))
    for i in np.flatnonzero(size > _SHORT).tolist():
        h[i] = int.from_bytes(blake2b(text[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h, starts, ends


def word_hashes(text: bytes) -> np.ndarray:
    return word_spans(text)[0]


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z as a-z; nothing for null."""
    return (text or "").encode().translate(_UPPER)


def digests(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of each span, 128 bits, as two int64 arrays."""
    both = np.frombuffer(b"".join([blake2b(s, digest_size=16).digest() for s in spans]), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
