"""Word hashes of whole batches of texts (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are turned into words at a time (or one word, if that is longer); bounds the memory of very long texts.
SLICE = 1 << 20
#: Bytes of text that an operator takes at a time (or one text, if that is longer).
CHUNK_BYTES = 1 << 19
LOWER = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
#: Lower-case A-Z and turn what separates words into spaces: space and U+0009 to U+000D, or all ASCII but letters and digits.
SPACED = np.array([0x20 if 0x09 <= b <= 0x0D else b for b in LOWER], np.uint8)
PLAIN = np.array([b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


#: A random number for each byte (0 for the separator), and the factor between places in a word.
BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BYTE_CODES[0x20] = 0
STEP = 0xD1342543DE82EF95


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def words(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and the byte that it starts at, for folded texts that lie side by side (ends: the first bytes of all but the first)."""
    hashes, at = [], []
    begin = 0
    while begin < len(text):
        end = min(begin + SLICE, len(text))
        if end < len(text):  # cut after the last separator; a longer word is taken whole
            gap = np.flatnonzero(text[begin:end] == 0x20)
            if len(gap):
                end = begin + int(gap[-1]) + 1
            else:
                after = np.flatnonzero(text[end:] == 0x20)
                end = end + int(after[0]) + 1 if len(after) else len(text)
        part = text[begin:end]
        inside = part != 0x20
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        border = ends[(ends >= begin) & (ends < end)] - begin
        new[border] = inside[border]  # texts without a separator between them
        starts = np.flatnonzero(new)
        if len(starts):
            lengths = np.diff(np.append(starts, len(part)))
            place = np.arange(len(part) - starts[0]) - np.repeat(starts - starts[0], lengths)
            with np.errstate(over="ignore"):
                longest = int(place[inside[starts[0] :]].max()) + 1
                powers = np.cumprod(np.concatenate([[U(1)], np.full(longest, STEP, U)]))
                place[~inside[starts[0] :]] = 0
                hashes.append(mix(np.add.reduceat(BYTE_CODES[part[starts[0] :]] * powers[place], starts - starts[0])))
            at.append(starts + begin)
        begin = end
    return (np.concatenate(hashes), np.concatenate(at)) if hashes else (np.zeros(0, U), np.zeros(0, np.int64))


def coded(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and its text, for texts whose bytes are offsets[i] to offsets[i + 1]."""
    offsets = np.asarray(offsets, np.int64)
    codes, at = words(fold[data[offsets[0] : offsets[-1]]], offsets[1:-1] - offsets[0])
    return codes, np.searchsorted(offsets[1:] - offsets[0], at, "right")


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a binary column of about CHUNK_BYTES: first row, row after the last, bytes of the column and offsets of the rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + CHUNK_BYTES, "right")) - 1)
        yield at, end, data, offsets[at : end + 1]
        at = end


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """A list of longs a row."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), longs(values))
