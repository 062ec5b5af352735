"""Array helpers for tasks: words and shingles of texts as hash codes, and runs of sorted rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE_BYTES = 1 << 19
SHINGLE_WORDS = 5
# Any fixed odd multipliers do; powers of one modulo 2^64 weigh the bytes of a word and the words of a shingle.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit codes one-to-one over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64))


@functools.lru_cache(maxsize=64)
def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, dtype=np.uint64)]))[:n]


def _piece_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of one piece of text, and where they start."""
    inside = ~BLANK[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    # weights restart at each word, so equal words have equal sums wherever they stand
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) - np.repeat(first, lengths)
    longest = 1 << int(lengths.max()).bit_length()
    codes = BYTE_CODES[data[inside]] * _powers(BYTE_BASE, longest)[at]
    sums = np.add.reduceat(codes, first)
    return mixed(sums + lengths.astype(np.uint64)), starts


def word_codes(text: bytes) -> np.ndarray:
    """64-bit codes of the words (runs without ASCII white space) of a text, A-Z as a-z."""
    data = LOWER[np.frombuffer(text, dtype=np.uint8)]
    if len(data) <= PIECE_BYTES:
        return _piece_codes(data)[0]
    found, start = [], 0
    while start < len(data):
        end = min(start + PIECE_BYTES, len(data))
        while end < len(data) and not BLANK[data[end]]:  # pieces end at white space
            blank = np.flatnonzero(BLANK[data[end:end + PIECE_BYTES]])
            end = end + int(blank[0]) if len(blank) else min(end + PIECE_BYTES, len(data))
        found.append(_piece_codes(data[start:end])[0])
        start = end
    return np.concatenate(found)


def shingle_codes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Codes of all runs of ``size`` words; of a shorter text, of the whole sequence."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    total, weights = np.zeros(n - size + 1, dtype=np.uint64), _powers(WORD_BASE, size)
    for j in range(size):
        total += words[j:n - size + 1 + j] * weights[j]
    return mixed(total + np.uint64(size))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle codes of a text."""
    return np.unique(shingle_codes(word_codes(text))) if text else np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: Sequence[bytes | None]) -> list[np.ndarray]:
    """``shingle_set`` of each text; the words of many texts are read at once."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(texts)
    held, size = [], 0

    def flush() -> None:
        data = LOWER[np.frombuffer(b"\n".join(texts[i] for i in held), dtype=np.uint8)]
        begins = np.cumsum([0] + [len(texts[i]) + 1 for i in held])
        words, starts = _piece_codes(data)
        cuts = np.searchsorted(starts, begins)
        n = max(len(words) - SHINGLE_WORDS + 1, 0)
        total, weights = np.zeros(n, dtype=np.uint64), _powers(WORD_BASE, SHINGLE_WORDS)
        for j in range(SHINGLE_WORDS):
            total += words[j:n + j] * weights[j]
        codes = mixed(total + np.uint64(SHINGLE_WORDS))
        for i, a, b in zip(held, cuts[:-1].tolist(), cuts[1:].tolist()):
            own = codes[a:b - SHINGLE_WORDS + 1] if b - a >= SHINGLE_WORDS else shingle_codes(words[a:b])
            own = np.sort(own)
            repeat = own[1:] == own[:-1]
            out[i] = own[np.concatenate([[True], ~repeat])] if repeat.any() else own

    for i, text in enumerate(texts):
        if text and len(text) > PIECE_BYTES:
            out[i] = shingle_set(text)
        elif text:
            held.append(i)
            size += len(text)
            if size >= PIECE_BYTES:
                flush()
                held, size = [], 0
    if held:
        flush()
    return out


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal ``keys`` (integer columns) with the runs' bounds, from rows sorted by the keys."""
    held: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(len(table) - 1, dtype=bool)
        for k in keys:
            values = table[k].to_numpy()
            change |= values[1:] != values[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [len(table)]])

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        at = bounds(held)
        if len(at) > 2:
            yield held.slice(0, int(at[-2])).combine_chunks(), at[:-1]
            held = held.slice(int(at[-2]))
    if held is not None and len(held):
        yield held.combine_chunks(), bounds(held)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``n`` positions is linked with, directly or not."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            return root
        root = new
