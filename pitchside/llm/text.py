"""Byte-level text helpers shared by the operators (numpy, run inside Spark tasks).

All hashes are 64 bits wide. A span's hash depends on its bytes alone, so the same
word, shingle or window has the same hash in every task.
"""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part words in the contracts of operators 1 and 9: space and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


#: Powers that a process keeps (8 bytes each, twice); a longer text's are made anew each time.
KEPT_POWERS = 1 << 21


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse)."""
    p = _powers[kind]
    if len(p) < n:
        p = np.full(max(n, 1 << 20), np.uint64(_BASE if kind == "up" else _INVERSE), np.uint64)
        p[0] = 1
        p = np.cumprod(p, out=p)
        if n <= KEPT_POWERS:
            _powers[kind] = p
    return p[:n]


def give_back(again_after: float = 1.0) -> None:
    """Return freed memory to the system: a worker lives on after its task, idle or in another stage.

    Once now and once ``again_after`` seconds later, when the task's last batches are freed, too. The powers
    of the hash base go with it (up to 32 MB, made again in some milliseconds).
    """
    _powers.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    if again_after:
        later = threading.Timer(again_after, give_back, (0,))
        later.daemon = True
        later.start()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):   # a C library without it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of the bytes; with ``span_hash`` any span's hash is O(1)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end)."""
    h = (sums[ends] - sums[starts]) * _power("down", len(sums))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def blocks(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = 4 << 20, max_rows: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of at most ``max_bytes`` of text (one row at least), with their UTF-8 bytes; null is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        start, size, texts = 0, 0, []
        for i, text in enumerate(column.cast(pa.large_binary())):
            raw = text.as_py() or b""
            if texts and (size + len(raw) > max_bytes or len(texts) == max_rows):
                yield batch.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(raw)
            size += len(raw)
        if texts:
            yield batch.slice(start), texts
    give_back()


def join_texts(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, a newline after each, and each text's offset (one more at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return (LOWER[data] if lower else data), offsets


def word_spans(data: np.ndarray, is_gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no gap; the last byte must be a gap."""
    inside = np.empty(len(data) + 1, bool)
    inside[0] = False
    np.logical_not(is_gap[data], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def sorted_counts(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs (or the sum of its weights)."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if weights is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(weights, first)
