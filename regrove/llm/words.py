"""Words and stable hashes of whole Arrow text columns, computed on their byte buffers.

A word is a run of bytes other than space and 0x09-0x0D.  These separators are ASCII, so the
byte view of UTF-8 gives the same words as the code-point view.  All functions work on any
text length: hashing walks the buffer in blocks cut between words.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
import types
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK = 1 << 19
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def worker_memo(name: str) -> dict:
    """A dictionary that lives as long as the Python worker; callers keep it bounded."""
    home = sys.modules.setdefault("_text_worker_memo", types.ModuleType("_text_worker_memo"))
    return home.__dict__.setdefault(name, {})


def memos() -> dict[str, dict]:
    return {k: v for k, v in vars(sys.modules.get("_text_worker_memo", types.ModuleType("none"))).items() if isinstance(v, dict)}


def lean(scan, keep: tuple[str, ...] = ("powers",)):
    """The same Arrow function for workers that are used again: a task drops what other stages remembered, and gives free memory back at its end.

    ``keep`` names the memos it uses itself.  Workers outlive their stage, and what they hold on to lies beside all later ones.
    """
    @functools.wraps(scan)
    def run(batches):
        for name, memo in memos().items():
            if name not in keep:
                memo.clear()
        try:
            yield from scan(batches)
        finally:
            give_back()
    return run


def give_back() -> None:
    """Memory that Arrow and the C library keep for later returns to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark, rows: int = 1000):
    """Arrow batches of fewer rows while tables are written: long texts come in pieces that fit beside the rest."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    memo = worker_memo("powers")
    if n > BLOCK:
        return _power_row(BASE, n), _power_row(BASE_INVERSE, n)
    if not memo:
        memo["p"], memo["q"] = _power_row(BASE, BLOCK), _power_row(BASE_INVERSE, BLOCK)
    return memo["p"], memo["q"]


def _power_row(base: np.uint64, n: int) -> np.ndarray:
    row = np.full(n + 1, base, U64)
    row[0] = 1
    return np.multiply.accumulate(row)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; spans are disjoint and ascending."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + BLOCK, "right")))
        m = int(ends[j - 1] - a)
        power, inverse = _powers(m)
        prefix = np.zeros(m + 1, U64)
        np.cumsum((data[a:a + m].astype(U64) + U64(1)) * power[:m], out=prefix[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


@dataclass
class Words:
    """Words of some texts: row of each word, byte span in ``data``, stable hash."""
    rows: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """First word of each row, with the total at the end."""
        return np.searchsorted(self.doc, np.arange(self.rows + 1))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    data, offsets = text_buffer(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    blank = SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)      # position i follows a separator or a row edge
    before[0] = True
    before[1:] = blank
    before |= edge
    start = np.flatnonzero(~blank & before[:n])
    after = edge[1:].copy()
    after[:-1] |= blank[1:]
    end = np.flatnonzero(~blank & after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(len(offsets) - 1, doc, start, end, data, span_hashes(data, start, end))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 20):
    """Cut a batch into row ranges of about ``size`` text bytes (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + size, "right")))
        yield batch.slice(i, j - i)
        i = j


#: Odd multipliers that tell the places of a window apart.
PLACE = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def window_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words inside a row, and the row of each.

    A row with fewer words (but one at least) has its whole sequence as its one window.
    """
    h, doc = words.hash, words.doc
    n = len(h) - k + 1
    if n > 0:
        total = np.zeros(n, U64)
        for t in range(k):
            total += h[t:t + n] * PLACE[t]
        inside = doc[:n] == doc[k - 1:]
        full, full_doc = mix(total[inside]), doc[:n][inside]
    else:
        full, full_doc = np.zeros(0, U64), np.zeros(0, np.int64)
    bounds = words.bounds()
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short) == 0:
        return full, full_doc
    total = np.zeros(len(short), U64)
    for t in range(k - 1):
        has = count[short] > t
        total[has] += h[bounds[short[has]] + t] * PLACE[t]
    few = mix(total + count[short].astype(U64) * PLACE[63])
    every, docs = np.concatenate([full, few]), np.concatenate([full_doc, short])
    order = np.argsort(docs, kind="stable")
    return every[order], docs[order]
