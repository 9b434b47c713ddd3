"""Words of whole texts as arrays: bytes are classified and hashed with numpy, many texts at a time.

Texts are UTF-8 bytes with A-Z lower-cased. All class boundaries used here are ASCII, so a byte of a
longer character is simply a word byte.
"""

from collections.abc import Iterator

import numpy as np

#: Bytes of text that one block of arrays covers; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.ones(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = False

ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Block:
    """The words of some texts: where they lie, whose they are, and a hash of each."""

    def __init__(self, parts: list[bytes], word: np.ndarray):
        sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        # A zero byte between texts ends words; a zero byte inside a text is told apart by `word`.
        self.data = LOWER[np.frombuffer(b"\0".join(parts), np.uint8)]
        self.text_at = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        inside = word[self.data]
        inside[(self.text_at[1:] - 1)] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.count = len(self.start)
        self.texts = len(parts)
        self.first = np.searchsorted(self.start, self.text_at)
        self.last = np.append(self.first[1:], self.count)
        self.per_text = self.last - self.first
        self.owner = np.repeat(np.arange(self.texts), self.per_text)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every block."""
        out = np.empty(self.count, np.uint64)
        at = 0
        while at < self.count:  # some words at a time, so a long text needs no long arrays
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.start, base + BLOCK_BYTES)))
            start, end = self.start[at:to] - base, self.end[at:to] - base
            n = int(end[-1])
            values = _TABLE[self.data[base : base + n]]
            values *= _powers(_BASE, n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values, out=total[1:])
            own = (total[end] - total[start]) * _powers(_INVERSE, n + 1)[start]
            out[at:to] = mix(own ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            at = to
        return out

    def words(self, picked: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s:e] for s, e in zip(self.start[picked].tolist(), self.end[picked].tolist())]


def raw(texts) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    return [b"" if t is None else t for t in texts.cast("binary").to_pylist()]


def blocks(parts: list[bytes], word: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """Blocks of whole texts with the place of their first text; each about `size` bytes or one text."""
    at, held = 0, 0
    for i, p in enumerate(parts):
        if i > at and held + len(p) > size:
            yield at, Block(parts[at:i], word)
            at, held = i, 0
        held += len(p) + 1
    if at < len(parts):
        yield at, Block(parts[at:], word)


def word_hash(words: list[str]) -> np.ndarray:
    """The hashes that `Block.hashes` gives these words (already lower-case, each one word)."""
    parts = [w.encode() for w in words]
    if not parts:
        return np.zeros(0, np.uint64)
    b = Block(parts, np.ones(256, bool))
    return b.hashes()


def windows(block: Block, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every run of `width` words within one text."""
    n = block.count - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * np.uint64((_BASE * (2 * k + 3)) ** 3 & MASK | 1)
    keep = np.flatnonzero(block.owner[:n] == block.owner[width - 1 :])
    return mix(out[keep]), keep
