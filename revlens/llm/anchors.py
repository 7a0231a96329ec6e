"""Which suffixes of a text are needed to find all its repeated strings of a given length.

Of the window of every MATCH bytes, the K-gram of least hash (the first, if several) is the anchor. The choice depends
on the window's bytes only, so equal windows have their anchors at equal places, and two occurrences of a window are
found by comparing the suffixes at their anchors: about one suffix in MATCH / 2.4 bytes instead of every one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Length of the repeated strings, and of the grams that anchor them.
MATCH, K = 200, 32
#: Grams in a window.
W = MATCH - K + 1
#: Bytes that are hashed at a time.
TILE = 1 << 20
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_HIGH = np.uint64(0xFFFFFFFF00000000)


def gram_hashes(flat: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-grams of a buffer of bytes."""
    words = np.ndarray((len(flat) - 7,), "<u8", np.ascontiguousarray(flat), strides=(1,)) * _ODD[0]
    words ^= words >> np.uint64(31)
    words *= _ODD[1]
    words ^= words >> np.uint64(29)
    n = len(flat) - K + 1
    h = words[:n].copy()
    for i in range(1, K // 8):
        h += words[8 * i : 8 * i + n] * _ODD[i]
    h ^= h >> np.uint64(32)
    return h


def _window_minima(key: np.ndarray) -> np.ndarray:
    """Minima of all runs of W keys."""
    width = 1
    while 2 * width <= W:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = W - width
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors in order of text and place, in parts of about TILE bytes, whatever the texts' lengths: text, place, first
    and last window start, hash of the gram, and the number of the text's part.

    An anchor may come in two parts with adjacent windows where a long text is cut.
    """

    def run(segments: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        flat = np.frombuffer(b"".join(s for _, _, s in segments), np.uint8)
        h = gram_hashes(flat)
        place = _window_minima((h & _HIGH) | np.arange(len(h), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
        sizes = np.array([len(s) for _, _, s in segments])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inside = np.zeros(len(flat) + 1, np.int64)
        np.add.at(inside, begins, 1)
        np.add.at(inside, begins + sizes - MATCH + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside)[: len(place)])
        p = place[starts].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.concatenate([first[1:], [len(p)]]) - 1
        segment = np.searchsorted(begins, starts[first], "right") - 1
        text = np.array([i for i, _, _ in segments])[segment]
        from_ = np.array([b for _, b, _ in segments])[segment]
        shift = from_ - begins[segment]
        return text, p[first] + shift, starts[first] + shift, starts[last] + shift, h[p[first]].view(np.int64), from_ // TILE

    segments: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - MATCH + 1, TILE):
            segments.append((i, a, t[a : a + TILE + MATCH - 1]))
            held += len(segments[-1][2])
            if held >= TILE:
                yield run(segments)
                segments, held = [], 0
    if segments:
        yield run(segments)


def find(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All `parts` as one: text, place, first and last window start, hash of the gram."""
    out = list(parts(texts))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))[:5] if out else tuple(np.zeros(0, np.int64) for _ in range(5))
