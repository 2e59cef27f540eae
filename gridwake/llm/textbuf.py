"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch.

Texts stay bytes: every word class used here is defined by ASCII characters, so a byte table decides it, and
bytes of longer characters always belong to words. Words, lines and n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U = np.uint64
#: Bytes of text handled at once in a task; one longer text is still handled whole.
SLICE = 1 << 20
#: Bytes that are hashed at once.
CHUNK = 1 << 17
#: Bytes of rows that a batch may hold on its way to a task's Python; Spark's own limit is 64 MB.
BATCH = 4 << 20
_STEP = U(0x9E3779B97F4A7C15)
_BASE = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


with np.errstate(over="ignore"):
    _BYTE = mix((np.arange(256, dtype=U) + U(1)) * _STEP)
_POWERS = np.ones(1, U)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Words [^\x20\x09-\x0D]+
SPACED = ~_BLANK
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text in lower case
PLAIN = _ALNUM
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def small_batches(spark: SparkSession, most: int = BATCH) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to `most`, if it is higher.

    Batches lie outside the heap, and their buffers double as they grow, so each task can hold several times the limit
    beside a heap that is full already. Rows are not affected: one that is longer travels alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if now <= 0 or now > most:
        spark.conf.set(name, most)


def release() -> None:
    """Hand freed memory back to the system: a worker lives on after its task, beside the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with freed memory handed back at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most about `limit` bytes of text, so that memory is bounded by text and not by rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        ends, k, n = np.cumsum(sizes, dtype=np.int64), 0, batch.num_rows
        while k < n:
            done = ends[k - 1] if k else 0
            to = max(k + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(k, to - k)
            k = to
        del batch
    release()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `inside`; no run crosses from one text into the next."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | edge[1:])) + 1


def per_text(at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the ascending byte positions fall into each text."""
    return np.diff(np.searchsorted(at, off))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 1024), _BASE, U)
        more[0] = 1
        _POWERS = np.cumprod(more, dtype=U)
    return _POWERS


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; 0 bytes are allowed."""
    lens = ends - starts
    out = np.zeros(len(starts), U)
    some = np.flatnonzero(lens)
    s, n = starts[some], lens[some]
    done, k = np.cumsum(n), 0
    while k < len(some):  # CHUNK bytes at a time, as eight bytes or more stand for each
        to = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + CHUNK, "right")))
        m = n[k:to]
        at = np.cumsum(m) - m
        inner = np.arange(int(m.sum()), dtype=np.int64) - np.repeat(at, m)
        values = _BYTE[data[inner + np.repeat(s[k:to], m)]]
        values *= _powers(int(m.max()))[inner]
        out[some[k:to]] = np.add.reduceat(values, at)
        k = to
    return mix(out + (lens.astype(U) + U(1)) * _STEP)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with first places and inverse, of integers: by hashing, with a sort of the distinct ones alone."""
    which, found = pd.factorize(values)
    first = np.zeros(len(found), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], first[order], place[which]


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; those that reach over the end are left out."""
    if len(words) < n:
        return np.zeros(0, U)
    g = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        g = g * _BASE + words[k : len(words) - n + 1 + k]
    return mix(g + U(n))


def keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between owners, to count within each owner by one sort."""
    return mix(hashes + owner.astype(U) * _STEP)
