"""UTF-8 bytes of Arrow string columns, without a Python string for each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """(rows, their bytes, n + 1 offsets): runs of rows of about ``most`` bytes; one longer text is a run of its own.

    Null texts are empty.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            end = min(end, len(texts))
            part = data.slice(int(at[row]), int(at[end] - at[row])).to_pybytes() if data is not None and at[end] > at[row] else b""
            yield batch.slice(row, end - row), part, at[row : end + 1] - at[row]
            row = end


def runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes that are at least ``least`` long; a run never crosses a row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(mask) + 1, dtype=bool)
    change[0] = change[-1] = True
    np.not_equal(mask[1:], mask[:-1], out=change[1:-1])
    change[offsets] = True
    cuts = np.nonzero(change)[0]
    starts, ends = cuts[:-1], cuts[1:]
    keep = (ends - starts >= least) & mask[starts]
    return starts[keep], ends[keep]


#: Bytes of words: ASCII letters, digits, underscore, and every byte of a character beyond ASCII.
WORD_BYTE = np.array([chr(b).isalnum() and b < 128 or b == 95 or b >= 128 for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
PRIME = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(1, n), dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


#: Bytes whose words are hashed at once; their hashes don't depend on it.
BLOCK = 1 << 18
POWERS, BACK = _powers(PRIME, BLOCK), _powers(pow(PRIME, -1, 1 << 64), BLOCK)


def _long_word(raw: np.ndarray) -> np.uint64:
    """What ``word_hashes`` mixes for one word of any length, from blocks of it."""
    h = 0
    for i in range(0, len(raw), BLOCK):
        part = raw[i : i + BLOCK]
        h += int(((FOLD[part] + np.uint64(1)) * POWERS[: len(part)]).sum()) * pow(PRIME, i, 1 << 64)
    return np.uint64(h % (1 << 64))


def word_hashes(data: bytes | np.ndarray, offsets: np.ndarray, of: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each lower-cased word (a run of bytes in ``of``), and the n + 1 offsets of the rows among the words.

    Bytes are widened to hashes for a block of words at a time, so that memory beyond a few bytes for each byte has a bound.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends = runs(of[raw], offsets, 1)
    rows = np.searchsorted(starts, offsets)
    hashes, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + BLOCK, side="right"))
        if j == i:  # a word longer than a block
            hashes[i] = _long_word(raw[low : ends[i]])
            i += 1
            continue
        part, first, last = raw[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((FOLD[part] + np.uint64(1)) * POWERS[: len(part)], out=total[1:])
        hashes[i:j] = (total[last] - total[first]) * BACK[first]
        i = j
    return mix(hashes), rows


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for the ``n`` words from each position; the last n - 1 positions have none."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = words[:count].copy()
    for i in range(1, n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + count]
    return mix(h)
