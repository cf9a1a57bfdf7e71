"""Compression bands: zstandard ratios of whole documents and of fixed chunks.

A text that compresses far better than prose of its length repeats itself; one that hardly
compresses is noise.  Short texts compress less (the frame and an empty window cost more), so
each length has its own pair of limits.  Texts of at least two chunks are also judged chunk by
chunk, so a repetitive or random stretch is not averaged away by the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Bands:
    """Limits on plain bytes / compressed bytes, by length of the text in UTF-8 bytes.

    ``limits`` holds (bytes below which the row applies, least ratio, greatest ratio) in ascending
    order.  Under 128 bytes noise and prose cannot be told apart, so only the upper limit works
    there.  At most ``bad_chunks`` of a text's chunks may leave ``chunk_limits``.
    """
    level: int = 3
    limits: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 2.0), (256, 0.9, 2.4), (1024, 1.15, 2.8), (4096, 1.3, 3.2), (16384, 1.4, 3.8), (float("inf"), 1.45, 4.5))
    chunk: int = 4096
    chunk_limits: tuple[float, float] = (1.3, 3.2)
    bad_chunks: float = 0.25


BASE_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
               "n_bytes long, ratio double, n_chunks long, low_chunk double, high_chunk double, bad_chunks long, "
               "verdict string, kept boolean")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words inside repeated three-word windows."""
    words = WORD.findall(text)
    symbols = sum(map(text.count, "#*$%&|<>"))
    return len(words), sum(map(len, words)), symbols, repeated_lines(text), repeated_words(words)


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def repeated_words(words: list[str], k: int = 3) -> int:
    windows = list(zip(*(words[i:] for i in range(k))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + k - max(i, upto)
            upto = i + k
    return covered


class Press:
    """Ratios and verdicts; one compressor for a whole task."""

    def __init__(self, bands: Bands):
        self.bands = bands
        self.tool = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)

    def ratio(self, data) -> float:
        return len(data) / len(self.tool.compress(data))

    def judge(self, data: bytes) -> tuple:
        b, n = self.bands, len(data)
        if n == 0:
            return 0, None, 0, None, None, 0, "empty"
        ratio = self.ratio(data)
        view = memoryview(data)
        # The tail shorter than a chunk joins the last one, so that every byte is judged.
        cuts = [*range(0, n - b.chunk + 1, b.chunk)] if n >= 2 * b.chunk else []
        chunks = [self.ratio(view[a:a + b.chunk] if a != cuts[-1] else view[a:]) for a in cuts]
        bad = sum(not b.chunk_limits[0] <= r <= b.chunk_limits[1] for r in chunks)
        low, high = next((lo, hi) for most, lo, hi in b.limits if n < most)
        if ratio > high:
            verdict = "repetitive"
        elif ratio < low:
            verdict = "incompressible"
        elif bad > b.bad_chunks * len(chunks):
            verdict = "uneven"
        else:
            verdict = "fits"
        return n, ratio, len(chunks), min(chunks, default=None), max(chunks, default=None), bad, verdict


def compression_bands(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bands: Bands = Bands(),
                      least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """Counts, ratios and verdict of every text beside the columns named in ``keep``.

    ``kept`` is false for texts with fewer words than ``least_words``, with more than the share
    ``most_repeated`` of words in repeated windows, or outside their band.  A null or empty text has
    no words and no ratio and is not kept.  Repeated rows are judged one by one; other columns,
    whatever their names, are not read.  One pass, no shuffle.
    """
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + BASE_SCHEMA
    names = [x.split()[0] for x in BASE_SCHEMA.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = Press(bands)
        for batch in batches:
            rows = []
            for value in batch.column(len(keep)):
                s = value.as_py() or ""
                base = base_counts(s)
                failed = base[0] < least_words or base[4] > most_repeated * base[0]
                found = press.judge(s.encode("utf-8", "surrogatepass"))
                rows.append((*base, failed, *found, not failed and found[-1] == "fits"))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            kinds_out = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(),
                                           pa.int64(), pa.string(), pa.bool_()]
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(c, k) for c, k in zip(columns, kinds_out)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(judged, schema)
