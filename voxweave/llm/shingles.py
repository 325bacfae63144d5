"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once.

Words are runs of bytes other than the six ASCII white-space bytes, with A-Z lower-cased. A shingle is five
words in a row; a text of one to four words has its whole sequence as its only shingle; a text without
words has none. A hash stands for its shingle: of 10**9 different shingles a pair collides with odds near
one in forty.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_rng = np.random.default_rng(20240501)
#: A random 64-bit value per byte, and odd multipliers for places in a word and words in a shingle.
_BYTE = _rng.integers(0, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 2**62)) * 4 + 3
_UNBASE = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype="u8") * np.uint64(2) + np.uint64(1)
_SIZE = _rng.integers(0, 2**63, SHINGLE + 1, dtype="u8")
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, "u8"), "down": np.ones(1, "u8")}


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, np.uint64(base), "u8")
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that lie one after another in data, and the number of words of each text."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = ~space & (np.concatenate([[True], space[:-1]]) | edge[:-1])
    ends = ~space & (np.concatenate([space[1:], [True]]) | edge[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    words = mixed((sums[last] - sums[first]) * down[first])
    return words, np.diff(np.searchsorted(first, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; offsets has one more entry than there are texts, and starts at 0."""
    words, counts = _word_hashes(data, offsets)
    n = len(words)
    if n >= SHINGLE:
        whole = np.zeros(n - SHINGLE + 1, "u8")
        for k in range(SHINGLE):
            whole += words[k : n - SHINGLE + 1 + k] * _PLACE[k]
        whole = mixed(whole + _SIZE[SHINGLE])
    out, at = [], 0
    for count in counts.tolist():
        if count >= SHINGLE:
            out.append(np.unique(whole[at : at + count - SHINGLE + 1]))
        elif count:
            out.append(mixed((words[at : at + count] * _PLACE[:count]).sum(keepdims=True, dtype="u8") + _SIZE[count]))
        else:
            out.append(np.zeros(0, "u8"))
        at += count
    return out


def column_sets(column, most: int = 1 << 20):
    """The shingle sets of an Arrow string column, row by row; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], "i8", len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, "i8")
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, "u1") if buffer is not None and buffer.size else np.zeros(0, "u1")
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        stop = min(stop, len(column))
        begin, end = int(offsets[at]), int(offsets[stop])
        yield from shingle_sets(data[begin:end], offsets[at : stop + 1] - begin)
        at = stop


def set_digest(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    total = mixed((mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15))).sum(keepdims=True, dtype="u8") + np.uint64(len(hashes)))
    return int(total.view("i8")[0])
