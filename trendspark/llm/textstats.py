"""Words of a batch of texts as arrays: hashes, shapes and places, without a loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Classes of bytes: 0 space, 1 a-z, 2 A-Z, 3 digit, 4 of other scripts, 5 .,;:'"?- and brackets, 6 |, 7 #$%&*@, 8 !, 9 other.
CLASSES = 10
_CLASS = np.full(256, 9, dtype=np.uint8)
for _k, _some in enumerate((b" \t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256)), b".,;:'\"?-()[]{}", b"|", b"#$%&*@", b"!")):
    _CLASS[list(_some)] = _k
_rng = np.random.default_rng(99)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # case doesn't count in hashes
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

#: Bytes of words that are hashed at once; a longer word is hashed whole.
PIECE = 1 << 18


@dataclass
class Words:
    """n: words of each text; of all words one after the other: hash, text, start and end in the joined bytes, classes."""

    n: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    #: Classes of all bytes of words, and where each word's bytes begin among them.
    bytes_class: np.ndarray
    bytes_start: np.ndarray
    #: Where each text starts in the joined bytes.
    offsets: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words_of(texts: list[bytes]) -> Words:
    """Some ten bytes are held for each byte of the texts; hashes are taken for about PIECE bytes at a time."""
    x = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    kind = _CLASS[x]
    word = kind != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    size = end - start
    head = np.cumsum(size) - size
    y, kinds = x[word], kind[word]
    sums = np.zeros(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(head, head[lo] + PIECE)))
        a, z = int(head[lo]), int(head[hi - 1] + size[hi - 1])
        place = np.arange(a, z, dtype=np.int64) - np.repeat(head[lo:hi], size[lo:hi])
        sums[lo:hi] = np.add.reduceat(_BYTE[y[a:z]] * _PLACE[place & 63], head[lo:hi] - a)
        lo = hi
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(
        n=np.bincount(text, minlength=len(texts)),
        hash=mix(sums + size.astype(np.uint64)),
        text=text,
        start=start,
        end=end,
        first=kinds[head] if len(head) else kinds,
        last=kinds[head + size - 1] if len(head) else kinds,
        bytes_class=kinds,
        bytes_start=head,
        offsets=offsets,
    )
