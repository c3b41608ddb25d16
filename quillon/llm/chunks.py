"""A memo from text chunks to token ids, kept in sorted arrays and looked up for a whole slice of texts at once."""

from __future__ import annotations

import re

import numpy as np

from .common import prefix_hash, span_hash

MEMO_ENTRIES = 2_000_000
_ODD_SPACE = re.compile(r"[^\S \n]")
_SPECIAL_BYTE = np.zeros(256, dtype=bool)
_SPECIAL_BYTE[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class ChunkMemo:
    """``learn(chunks, heads)`` gives (sizes, ids end to end) for new chunks; a head chunk begins its text.

    Chunks are known by a 64-bit hash.  Past ``MEMO_ENTRIES`` the memo starts afresh: an entry costs about 30 bytes.
    """

    def __init__(self, learn):
        self.learn = learn
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _add(self, keys, sizes, ids) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), dtype=np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, starts)
        self.size = np.insert(self.size, at, sizes)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray):
        """Start in ``flat`` and number of ids of every chunk."""
        hashes = span_hash(prefix_hash(buf), starts, ends) ^ (heads.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != unique
        if new.any():
            if len(self.keys) + int(new.sum()) > MEMO_ENTRIES:
                self.reset()
                new[:] = True
            pick = where[new]
            chunks = [buf[s:e].tobytes().decode() for s, e in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
            sizes, ids = self.learn(chunks, heads[pick].tolist())
            self._add(unique[new], np.asarray(sizes, dtype=np.int32), np.asarray(ids, dtype=np.uint32))
            at = np.searchsorted(self.keys, unique)
        return self.start[at][inverse], self.size[at][inverse]

    def gather(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of the chunks end to end."""
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.arange(total) + np.repeat(start - (stop - size), size)]


def space_chunks(buf: np.ndarray, offsets: np.ndarray):
    """Cut every text at its spaces: starts, ends, first chunk of each text (one more entry), and which texts are odd.

    A space between two characters that aren't white space begins a pre-token of the byte-level pattern, whatever stands
    around.  An odd text has other white space or a space at another place; its chunks mean nothing.
    """
    space = buf == 32
    n = len(offsets) - 1
    filled = np.flatnonzero(np.diff(offsets) > 0)
    cuts = np.flatnonzero(space)
    white = space | (buf == 10)
    bad = np.zeros(len(buf) + 1, dtype=bool)
    bad[1:-1] = (space[1:] & white[:-1]) | (space[:-1] & white[1:])
    odd = np.zeros(n, dtype=bool)
    if bad.any():
        odd[np.searchsorted(offsets, np.flatnonzero(bad) - 1, side="right") - 1] = True
        odd[np.searchsorted(offsets, np.minimum(np.flatnonzero(bad), len(buf) - 1), side="right") - 1] = True
    odd[filled] |= space[offsets[filled]] | space[offsets[filled + 1] - 1]
    special = np.flatnonzero(_SPECIAL_BYTE[buf])
    for row in np.unique(np.searchsorted(offsets, special, side="right") - 1).tolist() if len(special) else []:
        odd[row] |= bool(_ODD_SPACE.search(buf[offsets[row] : offsets[row + 1]].tobytes().decode()))
    starts = np.sort(np.concatenate([offsets[filled], cuts + 1]))
    ends = np.sort(np.concatenate([offsets[filled + 1], cuts]))
    if odd.any():
        row = np.searchsorted(offsets, np.minimum(starts, max(len(buf) - 1, 0)), side="right") - 1
        keep = ~odd[row] & (starts <= ends)
        row_end = np.searchsorted(offsets, np.maximum(ends - 1, 0), side="right") - 1
        keep &= ~odd[row_end]
        starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets), odd
