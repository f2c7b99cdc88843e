"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object per word.

A word is a run of bytes that aren't ASCII white space; in UTF-8 such bytes never are part of another character.
Hashes are the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_AT_ONCE = 1 << 18  # bytes
_PLACES = 1024  # of a word's bytes that have factors of their own; later ones take them times an odd number
_FACTORS = np.random.default_rng(20240).integers(0, 2**63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows in them; a null has none."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32, len(column) + 1, column.offset * (8 if large else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: For plain words: ASCII letters and digits, and whatever isn't ASCII.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(column: pa.Array, plain: bool = False, stem: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows, in order, and the offsets of the rows among them. plain: words have letters and
    digits only, and ASCII letters count as lower case. stem: hashes are of that many first bytes of each word."""
    raw, at = text_bytes(column)
    inside = _PLAIN[raw] if plain else ~_SPACES[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[0] = True
    first[1:-1] = ~inside[:-1]
    first[at[:-1]] = True
    first = first[:-1] & inside
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, at)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # some words at a time: their bytes take many times their size
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _AT_ONCE)))
        part = slice(starts[i], starts[j] if j < len(starts) else len(raw))
        out[i:j] = _hashes(raw[part], inside[part], first[part], plain, stem)
        i = j
    return out, counts


def _hashes(raw: np.ndarray, inside: np.ndarray, first: np.ndarray, plain: bool, stem: int | None) -> np.ndarray:
    """Hashes of words, given which bytes are inside words and which are first in one."""
    kept = raw[inside].astype(np.uint64)
    if plain:
        kept += np.uint64(32) * ((kept >= 65) & (kept <= 90))
    begins = np.flatnonzero(first[inside])
    place = np.arange(len(kept)) - np.repeat(begins, np.diff(np.append(begins, len(kept))))
    factors = _FACTORS[place % _PLACES] * (np.uint64(2) * (place // _PLACES).astype(np.uint64) + np.uint64(1))
    parts = (kept + np.uint64(1)) * factors
    if stem:
        return mix(np.add.reduceat(parts * (place < stem), begins) + np.uint64(stem))
    return mix(np.add.reduceat(parts, begins))


_WINDOW = np.random.default_rng(4711).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of size words of each row, in order, and the rows' offsets. A row of fewer words, but one
    at least, has one window of all its words."""
    n = np.diff(counts)
    windows = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(windows)])
    out = np.empty(out_at[-1], np.uint64)
    if len(words) >= size:
        every = words[: len(words) - size + 1] * _WINDOW[0]
        for k in range(1, size):
            every += words[k : len(words) - size + 1 + k] * _WINDOW[k]
        every = mix(every)
    else:
        every = np.zeros(0, np.uint64)
    full = n >= size
    # windows of full rows: their starts are those words that have size - 1 more words in the row
    left = np.repeat(counts[1:], n) - np.arange(len(words))
    out_full = np.repeat(full, windows)
    out[out_full] = every[left[: len(every)] >= size] if len(every) else every
    for i in np.flatnonzero(~full & (n > 0)):
        own = words[counts[i] : counts[i + 1]]
        out[out_at[i]] = mix(np.array([(own * _WINDOW[: len(own)]).sum() + np.uint64(len(own))], np.uint64))[0]
    return out, out_at
