"""Brown class-based bigrams.

Words of training texts are counted over the whole corpus.  The most frequent ``VOCABULARY`` words
are put into ``CLASSES`` classes by exchange clustering, which moves a word to the class that most
raises the likelihood of the class bigrams.  From there the whole vocabulary is exchanged: each round counts
the classes beside every word, however rare, and moves words in the tasks that hold their counts.  Before its first
move a word belongs to a class of words of its length; the end of a text has its own class.  A word's
probability is that of its class after the previous class times that of the word in its class, smoothed.  An unseen word counts as
one more word of the class that holds most words of its length that were seen once.

Only the classes of the ``HEAD`` most frequent words travel to every task; all other words lie in buckets by their hash, with the words
beside them and their classes.  Pairs of head words are dealt once to the task of each of their words, so that a round counts the classes
beside them where they lie, and a word outside the head tells its class to the words beside it.
Counts and words pass from task to task as compressed arrays, one for a bucket, not one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard, staged
from .frequent import most_frequent
from .words import U64, lean, mix, slices, small_batches, words_of

VOCABULARY = 2048           # words that form the classes to begin with
CLASSES = 64
LENGTHS = 8                 # classes of words that have not moved yet, four bytes of length each, the last one open
KINDS = CLASSES + LENGTHS + 1
HEAD = 1 << 18              # most frequent words whose counts and classes every task has (8 MB); others are joined
ROUNDS = 6
WHOLE_ROUNDS = 3            # rounds over the whole vocabulary
PRIOR = 20.0                # weight of the class unigram in a transition
SHARE = 0.8                 # share of the class bigrams in a transition; the rest is the smoothed class unigram
ADD = 0.1
END = np.int64(mix(np.array([77], U64)).view(np.int64)[0])      # stands for the end of a text
GATHER = 1 << 21            # tokens counted together before they leave a task
ROWS_PER_TASK = 2_000_000   # counts gathered in one task
BLOBS = 16                  # rows of arrays in an Arrow batch
TOGETHER = 256              # words whose gains are computed at once
FEW = 16                    # counts whose gains are looked up
TAIL = np.int64(-1 << 63)   # added to the hashes of words outside the head: they are negative, head words are numbered


def length_class(words) -> np.ndarray:
    return np.minimum((words.end - words.start - 1) // 4, LENGTHS - 1)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return key[at], np.add.reduceat(n[order], at) if len(at) else n


class Tally:
    """Sums counts by key and hands them on when many distinct keys have gathered."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        key, n = np.unique(keys, return_counts=True) if counts is None else summed([keys], [counts])
        self.keys.append(key)
        self.counts.append(n)
        self.held += len(key)

    def full(self) -> bool:
        if self.held < GATHER:
            return False
        key, n = summed(self.keys, self.counts)
        self.keys, self.counts, self.held = [key], [n], len(key)
        return self.held > GATHER // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = summed(self.keys, self.counts) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.keys, self.counts, self.held = [], [], 0
        return key, n


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, band, n) of every word hash and of the end token."""
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = [Tally() for _ in range(LENGTHS)]
        ends = 0

        def rows(t, band):
            key, n = t.take()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), band, np.int32)), pa.array(n)],
                                              ["word", "band", "n"])

        for batch in batches:
            ends += batch.num_rows
            for piece in slices(batch, "__text"):
                words = words_of(piece.column(0))
                band, h = length_class(words), words.hash.view(np.int64)
                for b, t in enumerate(bands):
                    t.add(h[band == b])
                    if t.full():
                        yield rows(t, b)
        for b, t in enumerate(bands):
            yield rows(t, b)
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([LENGTHS], pa.int32()), pa.array([ends])], ["word", "band", "n"])

    found = texts.select(F.col(text).alias("__text")).mapInArrow(scan, "word long, band int, n long")
    return found.groupBy("word", "band").agg(F.sum("n").alias("n")).filter("n > 0")


class Symbols:
    """Word hashes to symbols: 0 .. V-1 clustered words, then the length classes, then the end."""

    def __init__(self, clustered: np.ndarray):
        self.size = len(clustered) + LENGTHS + 1
        self.end = self.size - 1
        self.order = np.argsort(clustered)
        self.sorted = clustered[self.order]
        self.first_band = len(clustered)

    def of(self, words) -> np.ndarray:
        h = words.hash.view(np.int64)
        out = self.first_band + length_class(words)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            hit = self.sorted[at] == h
            out[hit] = self.order[at[hit]]
        return out

    def chained(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in order with an end after each, and the row of each."""
        count = np.diff(words.bounds())
        where = np.arange(len(words.doc)) + words.doc
        out = np.full(len(words.doc) + words.rows, self.end)
        out[where] = self.of(words)
        return out, np.repeat(np.arange(words.rows), count + 1)


def symbol_bigrams(texts: DataFrame, clustered: np.ndarray, text: str = "text") -> DataFrame:
    """(a, b, n): how often symbol b follows a; a text's first word follows an end."""
    shared = texts.sparkSession.sparkContext.broadcast(clustered)       # VOCABULARY numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, tally = Symbols(shared.value), Tally()

        def rows():
            key, n = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for piece in slices(batch, "__text"):
                s, _ = symbols.chained(words_of(piece.column(0)))
                before = np.concatenate([[symbols.end], s[:-1]])        # texts follow each other over their ends
                tally.add(before * symbols.size + s)
                if tally.full():
                    yield rows()
        yield rows()

    size = len(clustered) + LENGTHS + 1
    found = texts.select(F.col(text).alias("__text")).mapInArrow(scan, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n")).select(
        F.expr(f"pair div {size}").alias("a"), (F.col("pair") % size).alias("b"), "n")


def class_context(bigrams: DataFrame, classes: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each symbol before and after each class, and of each symbol after itself.

    The sums run in the tasks; symbols times classes numbers reach the driver.
    """
    shared = bigrams.sparkSession.sparkContext.broadcast(classes)
    size = len(classes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value
        table = np.zeros((2 * size * kinds,))
        own = np.zeros(size)
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            table[:size * kinds] += np.bincount(a * kinds + cls[b], weights=n, minlength=size * kinds)
            table[size * kinds:] += np.bincount(b * kinds + cls[a], weights=n, minlength=size * kinds)
            own += np.bincount(a[a == b], weights=n[a == b], minlength=size)
        every = np.concatenate([table, own])
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at].astype(np.int64))], ["at", "n"])

    got = bigrams.select("a", "b", "n").mapInArrow(scan, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros(2 * size * kinds + size)
    every[got["at"].to_numpy()] = got["n"].to_numpy()
    shared.unpersist()
    return every[:size * kinds].reshape(size, kinds), every[size * kinds:2 * size * kinds].reshape(size, kinds), every[2 * size * kinds:]


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_moves(after: np.ndarray, before: np.ndarray, own: np.ndarray, classes: np.ndarray, movable: int,
               open_classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Best class and gain of every movable symbol, the others staying, and the likelihood now.

    ``after[w, c]`` counts class c behind w, ``before[w, c]`` ahead of it, ``own[w]`` w behind itself.
    """
    kinds = after.shape[1]
    grid = np.zeros((kinds, kinds))
    np.add.at(grid, classes, after)
    left, right = grid.sum(axis=1), grid.sum(axis=0)
    likelihood = float(xlogx(grid).sum() - xlogx(left).sum() - xlogx(right).sum())
    target, gain = classes.copy(), np.zeros(len(classes))
    pick = np.arange(open_classes)
    for w in range(movable):
        a, r, l, s = classes[w], after[w].copy(), before[w].copy(), own[w]
        nr, nl = r.sum(), l.sum()
        if nr + nl == 0:
            continue
        r[a] -= s
        l[a] -= s
        g = grid.copy()
        g[a, :] -= r
        g[:, a] -= l
        g[a, a] -= s
        gl, gr = left.copy(), right.copy()
        gl[a] -= nr
        gr[a] -= nl
        rows, columns = g[:open_classes] + r, (g[:, :open_classes] + l[:, None]).T
        rows[pick, pick] += l[pick] + s
        delta = (xlogx(rows) - xlogx(g[:open_classes])).sum(axis=1) + (xlogx(columns) - xlogx(g[:, :open_classes].T)).sum(axis=1)
        corner = g[pick, pick]
        delta -= xlogx(corner + l[pick]) - xlogx(corner)         # the corner belongs to the row
        delta -= xlogx(gl[pick] + nr) - xlogx(gl[pick]) + xlogx(gr[pick] + nl) - xlogx(gr[pick])
        c = int(delta.argmax())
        target[w], gain[w] = c, delta[c] - delta[a]
    return target, gain, likelihood


def exchange(bigrams: DataFrame, clustered: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """Class of every symbol, and the likelihood after each round.

    All words of a round see the classes of its start.  Moves are made for every other word in turn,
    so that words that attract each other do not swap for ever, and the best round is kept.
    """
    size, kinds = clustered + LENGTHS + 1, classes + LENGTHS + 1
    cls = np.concatenate([np.arange(clustered) % classes, classes + np.arange(LENGTHS + 1)])
    best, history = (None, -np.inf), []
    for n in range(rounds + 1):
        after, before, own = class_context(bigrams, cls, kinds)
        target, gain, likelihood = best_moves(after, before, own, cls, clustered if n < rounds else 0, classes)
        history.append(likelihood)
        if likelihood > best[1]:
            best = (cls, likelihood, after)
        if n < rounds:
            turn = (np.arange(size) + n) % 2 == 0
            cls = np.where(turn & (gain > 0), target, cls)
    return (best[0] if best[0] is not None else cls), history


class Head:
    """Places of word hashes in the head (ascending hashes), looked up by their leading bits, which are spread evenly."""

    def __init__(self, head: np.ndarray):
        bits = len(head).bit_length() + 1
        self.shift, self.half = 64 - bits, 1 << (bits - 1)
        self.first = np.searchsorted(head, np.arange(-self.half, self.half) << self.shift).astype(np.int32)
        self.hashes = np.append(head, np.iinfo(np.int64).max)

    def symbols(self, words) -> np.ndarray:
        """The place in the head of each word, or its negative hash."""
        h = words.hash.view(np.int64)
        at = self.first[(h >> self.shift) + self.half]
        found = self.hashes[at]
        later = np.flatnonzero(found < h)
        while len(later):
            at[later] += 1
            found[later] = self.hashes[at[later]]
            later = later[found[later] < h[later]]
        return np.where(found == h, at, h | TAIL)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of one length, their bytes sorted by significance (leading ones that are 0 left out) and compressed."""
    import zstandard
    planes, widths = [], []
    for x in arrays:
        x = np.ascontiguousarray(x.astype(np.int64))
        low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        widths.append(8 if low < 0 else max(1, (high.bit_length() + 7) // 8))
        planes.append(x.view(np.uint8).reshape(-1, 8)[:, :widths[-1]].T.tobytes())
    return bytes(widths) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, arrays: int) -> list[np.ndarray]:
    import zstandard
    widths = list(blob[:arrays])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[arrays:]), np.uint8).reshape(sum(widths), -1)
    out, at = [], 0
    for width in widths:
        x = np.zeros((planes.shape[1], 8), np.uint8)
        x[:, :width] = planes[at:at + width].T
        out.append(x.view(np.int64).ravel())
        at += width
    return out


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, which compress better; ``np.cumsum`` brings them back."""
    return np.diff(sorted_keys, prepend=0)


PACKED = "bucket int, kind int, blob binary"
COMMON, RARE = 0, 1         # kinds of ``PACKED`` rows: sorted keys and counts, or three arrays
#: ``words`` has the sorted hashes (as steps), length classes and classes of the tail words of a bucket; ``pairs`` has the pairs of each: the
#: place of the word (as steps), the other word, whether that is ahead (LENGTHS) or behind (0) plus its length class, and the count.
TAILS = "words binary, pairs binary"
DEALT = f"{PACKED}, {TAILS}"
BESIDE = f"bucket int, common binary, rare binary, {TAILS}, grid binary"


def binary_rows(names: str, *rows: tuple) -> pa.RecordBatch:
    """Rows of such a schema."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in names.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def tail_words(words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending hashes, length classes and classes of the tail words of a bucket."""
    name, band, cls = unpacked(words, 3)
    return np.cumsum(name), band, cls


def tail_pairs(pairs: bytes) -> tuple[np.ndarray, ...]:
    """Place of the word, other word, 1 if that is ahead, length class of it if it is no head word, count."""
    place, other, mark, n = unpacked(pairs, 4)
    return np.cumsum(place), other, mark // LENGTHS, mark % LENGTHS, n


def packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "kind", "blob"])


def edges(size: int, buckets: int) -> np.ndarray:
    """First head word of each bucket; head words are in the order of their hashes, so buckets are alike."""
    return np.arange(buckets + 1) * size // buckets


def dealt_keys(key: np.ndarray, n: np.ndarray, first: np.ndarray, width: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Packed rows of sorted keys (word * ``width`` + something) by the bucket of the word."""
    cut = np.searchsorted(key, first * width)
    for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        p = slice(cut[b], cut[b + 1])
        yield b, kind, packed(steps(key[p]), n[p])


def dealt_arrays(bucket: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [x[order] for x in arrays]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for i, j in zip(at, np.append(at[1:], len(bucket)) if len(bucket) else []):
        yield int(bucket[i]), kind, packed(*(x[i:j] for x in arrays))


def bucket_of(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word.view(U64)) % U64(buckets)).astype(np.int64)


def dealt_bigrams(texts: DataFrame, head: np.ndarray, tasks: int, text: str = "text") -> DataFrame:
    """How often one word follows another, over the whole vocabulary, as a few rows for each bucket of words; the end is ``len(head)``.

    Rows with a ``blob`` hold pairs of head words: sorted keys word * (len(head) + 1) + other and counts of all words of a ``bucket``;
    other is the word behind (``kind`` 0) or ahead (1), so each pair is in two of them.  The others hold all tail words of a bucket, in the
    classes of their lengths, and their pairs (``TAILS``), so pairs of two tail words are in two of them as well.
    """
    shared, buckets = texts.sparkSession.sparkContext.broadcast(head), 2 * tasks        # HEAD numbers
    size = len(head) + 1

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tally, first = Head(shared.value), Tally(), edges(size, buckets)
        held, rare = [], 0

        def common_rows():
            key, n = tally.take()
            rows = list(dealt_keys(key, n, first, size, 0))
            other = key % size * size + key // size
            order = np.argsort(other)
            return packed_rows(rows + list(dealt_keys(other[order], n[order], first, size, 1)))

        def rare_rows():
            word, other, mark = (np.concatenate(x) for x in zip(*held))
            return packed_rows(list(dealt_arrays(bucket_of(word, buckets), 2, word, other, mark)))

        for batch in batches:
            for piece in slices(batch, "__text"):
                words = words_of(piece.column(0))
                place = np.arange(len(words.doc)) + words.doc
                b, band = np.full(len(words.doc) + words.rows, size - 1), np.zeros(len(words.doc) + words.rows, np.int64)
                b[place] = head.symbols(words)
                band[place] = length_class(words)
                a = np.concatenate([[size - 1], b[:-1]])         # texts follow each other over their ends
                common = (a >= 0) & (b >= 0)
                tally.add(a[common] * size + b[common])
                band[b >= 0] = 0
                band_a = np.concatenate([[0], band[:-1]])
                behind, ahead = np.flatnonzero(a < 0), np.flatnonzero(b < 0)
                held.append((np.append(a[behind], b[ahead]), np.append(b[behind], a[ahead]),
                             np.append(band_a[behind] * LENGTHS + band[behind], (band[ahead] + LENGTHS) * LENGTHS + band_a[ahead])))
                rare += len(held[-1][0])
                if rare >= GATHER // 2:
                    yield rare_rows()
                    held, rare = [], 0
                if tally.full():
                    yield common_rows()
        if rare:
            yield rare_rows()
        yield common_rows()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict = {}
        tails: dict = {}
        for batch in batches:
            for bucket, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind == 2:
                    tails.setdefault(bucket, []).append(unpacked(blob, 3))
                else:
                    key, n = unpacked(blob, 2)
                    keys.setdefault((bucket, kind), []).append((np.cumsum(key), n))
        for bucket, kind in list(keys):
            key, n = summed(*zip(*keys.pop((bucket, kind))))
            yield binary_rows(DEALT, (bucket, kind, packed(steps(key), n), None, None))
        for bucket in list(tails):
            word, other, mark = (np.concatenate(x) for x in zip(*tails.pop(bucket)))
            order = np.lexsort((other, mark, word))
            word, other, mark = word[order], other[order], mark[order]
            new = np.append(True, word[1:] != word[:-1])
            at = np.flatnonzero(new | np.append(True, (other[1:] != other[:-1]) | (mark[1:] != mark[:-1])))
            name, place, band = word[new], np.cumsum(new) - 1, mark[new] // LENGTHS % LENGTHS
            side = mark // LENGTHS ** 2 * LENGTHS + mark % LENGTHS
            yield binary_rows(DEALT, (bucket, None, None, packed(steps(name), band, band + CLASSES),
                                      packed(steps(place[at]), other[at], side[at], np.diff(np.append(at, len(word))))))

    found = texts.select(F.col(text).alias("__text")).mapInArrow(scan, PACKED)
    return found.repartition(tasks, "bucket").mapInArrow(gather, DEALT)


def word_bigrams(texts: DataFrame, head: np.ndarray, tasks: int, text: str = "text") -> DataFrame:
    """``dealt_bigrams`` with the pairs of tail words as rows (a, b, n), each once."""
    schema = f"{PACKED}, a long, b long, n long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, kind, blob, words, pairs in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if blob is not None:
                    yield binary_rows(schema, (bucket, kind, blob, None, None, None))
                    continue
                place, other, ahead, _, n = tail_pairs(pairs)
                word, once = tail_words(words)[0][place], (ahead == 0) | (other >= 0)
                a, b = np.where(ahead, other, word)[once], np.where(ahead, word, other)[once]
                none = [pa.nulls(len(a), k) for k in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(a), pa.array(b), pa.array(n[once])], ["bucket", "kind", "blob", "a", "b", "n"])

    return dealt_bigrams(texts, head, tasks, text).mapInArrow(rows, schema)


def seed_bigrams(bigrams: DataFrame, symbol: np.ndarray, first_band: int) -> DataFrame:
    """``symbol_bigrams`` of the texts of ``dealt_bigrams``; ``symbol`` has those of the head and the end."""
    shared, size, symbols = bigrams.sparkSession.sparkContext.broadcast(symbol), len(symbol), first_band + LENGTHS + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, tally = shared.value, Tally()

        def rows():
            key, n = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for blob, words, pairs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if blob is not None:
                    key, n = unpacked(blob, 2)
                    key = np.cumsum(key)
                    tally.add(symbol[key // size] * symbols + symbol[key % size], n)
                else:
                    place, other, ahead, band, n = tail_pairs(pairs)
                    word = first_band + tail_words(words)[1][place]
                    beside = np.where(other >= 0, symbol[np.maximum(other, 0)], first_band + band)
                    once = (ahead == 0) | (other >= 0)
                    tally.add(np.where(ahead, beside * symbols + word, word * symbols + beside)[once], n[once])
                if tally.full():
                    yield rows()
        yield rows()

    found = bigrams.filter("kind = 0 or kind is null").select("blob", "words", "pairs").mapInArrow(scan, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n")).select(
        F.expr(f"pair div {symbols}").alias("a"), (F.col("pair") % symbols).alias("b"), "n")


def neighbours(bigrams: DataFrame, head_class: np.ndarray, tails: DataFrame, tasks: int) -> DataFrame:
    """The classes beside each word as rows of ``BESIDE``; ``tails`` has the buckets of tail words (``TAILS``).

    ``common`` (head words) and ``rare`` (tail words of a bucket, with their ``words`` and ``pairs``) are sorted keys
    word * (2 * KINDS + 1) + at and counts; a tail word is named by its place.  ``at`` is the class behind the word, or ``KINDS`` and the class
    ahead of it, or ``2 * KINDS`` for the word behind itself.  ``grid`` holds the class bigrams of a task.
    ``head_class`` includes the end; ``bigrams`` are those of ``dealt_bigrams``.
    """
    spark, buckets = bigrams.sparkSession, 2 * tasks
    shared = spark.sparkContext.broadcast(head_class)
    own, width, size = 2 * KINDS, 2 * KINDS + 1, len(head_class)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, first = shared.value, edges(size, buckets)
        for batch in batches:
            for bucket, side, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key, n = unpacked(blob, 2)
                key = np.cumsum(key)
                word = key // size
                other = key - word * size
                word -= first[bucket]
                rows = int(first[bucket + 1] - first[bucket])
                table = np.bincount(word * width + cls[other] + side * KINDS, weights=n, minlength=rows * width)
                if side == 0:
                    same = word + first[bucket] == other
                    table[word[same] * width + own] = n[same]
                at = np.flatnonzero(table)
                yield binary_rows(DEALT, (bucket, COMMON, packed(steps(at + first[bucket] * width), table[at]), None, None))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, tally, held, rare = edges(size, buckets), Tally(), [], 0

        def rows(some):
            return binary_rows(DEALT, *((*row, None, None) for row in some))

        def rare_rows():
            word, at, n = (np.concatenate(x) for x in zip(*held))
            return rows(dealt_arrays(bucket_of(word, buckets), RARE, word, at, n))

        for batch in batches:
            for bucket, words, pairs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield binary_rows(DEALT, (bucket, None, None, words, pairs))
                place, other, ahead, _, n = tail_pairs(pairs)
                at = tail_words(words)[2][place] + KINDS * (1 - ahead)      # the word is ahead of the one behind it
                head = other >= 0
                tally.add(other[head] * width + at[head], n[head])
                held.append((other[~head], at[~head], n[~head]))
                rare += len(held[-1][0])
                if rare >= GATHER // 2:
                    yield rare_rows()
                    held, rare = [], 0
                if tally.full():
                    yield rows(dealt_keys(*tally.take(), first, width, COMMON))
        if rare:
            yield rare_rows()
        key, n = tally.take()
        if len(key):
            yield rows(dealt_keys(key, n, first, width, COMMON))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_class, grid = shared.value, np.zeros(KINDS * KINDS)
        keys, rare, tails = {}, {}, []

        def add(cls, at, n):
            grid[:] += np.bincount((cls * KINDS + at)[at < KINDS], weights=n[at < KINDS], minlength=KINDS * KINDS)

        for batch in batches:
            for bucket, kind, blob, words, pairs in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if blob is None:
                    tails.append((bucket, words, pairs))
                elif kind == COMMON:
                    key, n = unpacked(blob, 2)
                    keys.setdefault(bucket, []).append((np.cumsum(key), n))
                else:
                    rare.setdefault(bucket, []).append(unpacked(blob, 3))
        for bucket in list(keys):
            key, n = summed(*zip(*keys.pop(bucket)))
            word = key // width
            add(head_class[word], key - word * width, n)
            yield binary_rows(BESIDE, (bucket, packed(steps(key), n), None, None, None, None))
        for bucket, words, pairs in tails:
            name, _, cls = tail_words(words)
            place, other, ahead, _, n = tail_pairs(pairs)
            head, same = other >= 0, (other == name[place]) & (ahead == 0)
            found = [(place[head] * width + head_class[other[head]] + ahead[head] * KINDS, n[head]), (place[same] * width + own, n[same])]
            found += [(np.searchsorted(name, word) * width + at, m) for word, at, m in rare.pop(bucket, [])]
            key, n = summed(*zip(*found))
            place = key // width
            add(cls[place], key - place * width, n)
            yield binary_rows(BESIDE, (bucket, None, packed(steps(key), n), words, pairs, None))
        some = np.flatnonzero(grid)
        if len(some):
            yield binary_rows(BESIDE, (None, None, None, None, None, packed(some, grid[some])))

    beside = (bigrams.filter("blob is not null").select("bucket", "kind", "blob").mapInArrow(common, DEALT)
              .union(tails.select("bucket", "words", "pairs").mapInArrow(told, DEALT)))
    return beside.repartition(tasks, "bucket").mapInArrow(gather, BESIDE)


def class_grid(beside: DataFrame) -> np.ndarray:
    """Class bigrams, as ``neighbours`` has them."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS * KINDS, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                at, n = unpacked(blob, 2)
                total[at] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    got = (beside.filter("grid is not null").select("grid").mapInArrow(add, "at long, n long")
           .groupBy("at").agg(F.sum("n").alias("n")).toArrow())
    grid = np.zeros(KINDS * KINDS)
    grid[got["at"].to_numpy()] = got["n"].to_numpy()
    return grid.reshape(KINDS, KINDS)


def likelihood_of(grid: np.ndarray) -> float:
    return float(xlogx(grid).sum() - xlogx(grid.sum(axis=1)).sum() - xlogx(grid.sum(axis=0)).sum())


def few_more(grid: np.ndarray, open_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``n`` up to ``FEW`` more of a class behind or ahead add to each open class: tables by n, class beside, open class."""
    n = np.arange(FEW + 1)[:, None, None]
    return tuple(xlogx(cells + n) - xlogx(cells) for cells in (grid[:open_classes].T, grid[:, :open_classes]))


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, classes: np.ndarray, grid: np.ndarray,
                 open_classes: int, few: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What ``best_moves`` finds, for some words only, at the cost of the classes that are beside them.

    Counts are whole; ``few`` is ``few_more`` of the grid, for calls that share it.
    """
    few = few or few_more(grid, open_classes)
    rows, word = len(classes), np.arange(len(classes))
    left, right = grid.sum(axis=1), grid.sum(axis=0)
    nr, nl = after.sum(axis=1), before.sum(axis=1)
    r, l = after.copy(), before.copy()
    r[word, classes] -= own
    l[word, classes] -= own
    pick = np.arange(open_classes)
    corner = grid[pick, pick]
    change = r[:, :open_classes] + l[:, :open_classes] + own[:, None]
    i, j = np.nonzero(change)
    change[i, j] = xlogx(corner[j] + change[i, j]) - xlogx(corner)[j]
    (sizes, which), (sizes_ahead, ahead) = np.unique(nr, return_inverse=True), np.unique(nl, return_inverse=True)
    change -= ((xlogx(left[pick] + sizes[:, None]) - xlogx(left[pick]))[which] + xlogx(right[pick] + sizes_ahead[:, None])[ahead]
               - xlogx(right[pick]))
    middle = grid[classes, classes]
    stay = xlogx(middle) - xlogx(middle - r[word, classes] - l[word, classes] - own)
    stay -= xlogx(left[classes]) - xlogx(left[classes] - nr) + xlogx(right[classes]) - xlogx(right[classes] - nl)
    for table, other, g, known in ((r, l, grid, few[0]), (l, r, grid.T, few[1])):
        i, j = np.nonzero(table)
        if len(i) == 0:
            continue
        n, home = table[i, j], j == classes[i]
        part = known[np.minimum(n, FEW).astype(np.int64), j]
        rest = np.flatnonzero(home | (n > FEW))
        cells = g[:open_classes, j[rest]].T.copy()
        left_it = home[rest]
        cells[left_it] -= other[i[rest[left_it]], :open_classes]        # the word itself has left its class
        part[rest] = xlogx(cells + n[rest, None]) - xlogx(cells)
        inside = np.flatnonzero(j < open_classes)
        part[inside, j[inside]] = 0                         # in ``corner``
        at = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        change[i[at]] += np.add.reduceat(part, at)
        now = g[classes[i], j]
        stay += np.bincount(i, weights=np.where(home, 0, xlogx(now) - xlogx(now - n)), minlength=rows)
    inside = np.flatnonzero(classes < open_classes)
    change[inside, classes[inside]] = stay[inside]
    target = change.argmax(axis=1)
    return target, change[word, target] - stay


def taken(word: np.ndarray, cls: np.ndarray, key: np.ndarray, n: np.ndarray, grid: np.ndarray, few, turn: int, end: int, open_classes: int) -> np.ndarray:
    """Classes of some words after a round in which every word that has its turn takes its best class, the others staying.

    First all words of length classes have their turn and leave these, then halves of the vocabulary, so that words that attract
    each other do not swap for ever.  ``key`` and ``n`` are those of ``neighbours``, words named by their places here.
    """
    kinds, cls = len(grid), cls.copy()
    width = 2 * kinds + 1
    place = key // width
    at, cut = key - place * width, np.searchsorted(place, np.arange(len(word) + 1))
    movable = (cls >= open_classes) if turn == 0 else (mix(word.view(U64)) & U64(1) == U64(turn & 1))
    todo = np.flatnonzero(movable & (word != end))
    for k in range(0, len(todo), TOGETHER):
        some = todo[k:k + TOGETHER]
        size = cut[some + 1] - cut[some]
        owner = np.repeat(np.arange(len(some)), size)
        from_ = np.repeat(cut[some] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        table = np.zeros((len(some), width))
        table[owner, at[from_]] = n[from_]
        target, gain = best_classes(table[:, :kinds], table[:, kinds:2 * kinds], table[:, -1], cls[some], grid, open_classes, few)
        cls[some] = np.where((gain > 0) | (cls[some] >= open_classes), target, cls[some])
    return cls


def moved_head(beside: DataFrame, grid: np.ndarray, head_class: np.ndarray, turn: int) -> np.ndarray:
    """``head_class`` after a round; at most ``HEAD`` numbers reach the driver."""
    shared = beside.sparkSession.sparkContext.broadcast((grid, head_class))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, head_class = shared.value
        few, width = few_more(grid, CLASSES), 2 * KINDS + 1
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                key, n = unpacked(blob, 2)
                key = np.cumsum(key)
                first = int(key[0]) // width
                word = np.arange(first, int(key[-1]) // width + 1)          # every head word has words beside it
                cls = taken(word, head_class[word], key - first * width, n, grid, few, turn, len(head_class) - 1, CLASSES)
                yield binary_rows("blob binary", (packed(word, cls),))

    after = head_class.copy()
    with small_batches(beside.sparkSession, BLOBS):
        for r in beside.filter("common is not null").select("common").mapInArrow(scan, "blob binary").collect():
            word, cls = unpacked(r["blob"], 2)
            after[word] = cls
    return after


def moved_tails(beside: DataFrame, grid: np.ndarray, turn: int) -> DataFrame:
    """Buckets of tail words (``TAILS``) after a round."""
    shared = beside.sparkSession.sparkContext.broadcast(grid)
    schema = f"bucket int, {TAILS}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        few = few_more(grid, CLASSES)
        for batch in batches:
            for bucket, rare, words, pairs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                name, band, cls = tail_words(words)
                key, n = unpacked(rare, 2)
                cls = taken(name, cls, np.cumsum(key), n, grid, few, turn, 0, CLASSES)        # hashes of tail words are negative
                yield binary_rows(schema, (bucket, packed(steps(name), band, cls), pairs))

    return beside.filter("rare is not null").select("bucket", "rare", "words", "pairs").mapInArrow(scan, schema)


def exchange_all(bigrams: DataFrame, head_class: np.ndarray, tasks: int,
                 rounds: int = WHOLE_ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray, list[float]]:
    """``neighbours``, classes of the head and class bigrams of the best round, and the likelihood after each.

    The classes of the head (at most ``HEAD``) and the class bigrams reach the driver, nothing of other words does.
    """
    best, history, tails = None, [], bigrams.filter("words is not null")
    for turn in range(rounds + 1):
        with small_batches(bigrams.sparkSession, BLOBS):
            beside = staged(neighbours(bigrams, head_class, tails, tasks), "neighbours")
        grid = class_grid(beside)
        history.append(likelihood_of(grid))
        if turn <= 1 or history[-1] > best[3]:       # the classes to begin with are not the same kind of classes
            discard(*(best[:1] if best else ()))
            best = (beside, head_class, grid, history[-1])
        else:
            discard(beside)
            break
        if turn < rounds:
            head_class, tails = moved_head(beside, grid, head_class, turn), moved_tails(beside, grid, turn)
    return best[0], best[1], best[2], history


def totals(beside: DataFrame, head_class: np.ndarray, head_band: np.ndarray) -> DataFrame:
    """(cls, band, n, v, once) of a part of the words but the end: how many words a class has of a length class, and how often they occur."""
    shared = beside.sparkSession.sparkContext.broadcast((head_class, head_band))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_class, head_band = shared.value
        width, end = 2 * KINDS + 1, len(head_class) - 1
        found = np.zeros((3, KINDS * (LENGTHS + 1)))
        for batch in batches:
            for common, rare, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key, n = unpacked(common or rare, 2)
                key = np.cumsum(key)
                word = key // width
                behind = key - word * width < KINDS
                if common is not None:
                    first = int(word[0])
                    total = np.bincount(word[behind] - first, weights=n[behind], minlength=int(word[-1]) - first + 1)
                    name = np.arange(first, first + len(total))
                    name, total = name[name != end], total[name != end]
                    cls, band = head_class[name], head_band[name]
                else:
                    _, band, cls = tail_words(words)
                    total = np.bincount(word[behind], weights=n[behind], minlength=len(cls))
                cell = cls * (LENGTHS + 1) + band
                for i, weight in enumerate((total, np.ones(len(cell)), total == 1)):
                    found[i] += np.bincount(cell, weights=weight, minlength=found.shape[1])
        some = np.flatnonzero(found[1])
        yield pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in (np.arange(found.shape[1]) // (LENGTHS + 1), np.arange(found.shape[1]) % (LENGTHS + 1), *found)],
                                         ["cls", "band", "n", "v", "once"])

    return (beside.filter("common is not null or rare is not null").select("common", "rare", "words")
            .mapInArrow(scan, "cls long, band long, n long, v long, once long"))


def tail_table(beside: DataFrame) -> DataFrame:
    """(word, c, cls) of all words outside the head."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rare, words in zip(*(batch.column(i).to_pylist() for i in range(2))):
                name, _, cls = tail_words(words)
                key, n = unpacked(rare, 2)
                key = np.cumsum(key)
                word = key // (2 * KINDS + 1)
                behind = key - word * (2 * KINDS + 1) < KINDS
                total = np.bincount(word[behind], weights=n[behind], minlength=len(name)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(total), pa.array(cls.astype(np.int32))], ["word", "c", "cls"])

    return beside.filter("rare is not null").select("rare", "words").mapInArrow(scan, "word long, c long, cls int")


@dataclass
class Model:
    """All that scoring needs but the counts and classes of words outside the head."""
    head: np.ndarray            # word hashes, ascending
    head_count: np.ndarray
    head_class: np.ndarray      # class of each head word, then of the end
    transition: np.ndarray      # log10, class after class
    class_total: np.ndarray     # log10 of the smoothed size of each class
    unseen: np.ndarray          # class of an unseen word of each length class
    tokens: int
    kinds: int                  # distinct training tokens
    ends: int                   # training texts
    history: list[float]


def train(texts: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table (word, c, cls) of all training words outside the head."""
    spark = texts.sparkSession
    with small_batches(spark):
        counts = staged(word_counts(texts, text), "word-counts")
    bands = {r["band"]: (r["n"], r["v"]) for r in counts.groupBy("band").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tokens, kinds = sum(n for n, _ in bands.values()), sum(v for _, v in bands.values())
    top = most_frequent(counts.filter(F.col("band") < LENGTHS), "word", "n", HEAD).toArrow()     # bounded by HEAD
    head, n, band = (top[c].to_numpy() for c in ("word", "n", "band"))
    order = np.lexsort((head, -n))
    clustered = head[order][:VOCABULARY]
    by_hash = np.argsort(head)
    head, n, band = head[by_hash], n[by_hash], band[by_hash].astype(np.int64)
    tasks = 1 + 2 * tokens // ROWS_PER_TASK         # follows the tokens alone: a task that has counts for every bucket writes as many rows
    with small_batches(spark):
        bigrams = staged(dealt_bigrams(texts, head, tasks, text), "bigrams")
    symbol = np.append(band, LENGTHS) + len(clustered)
    symbol[np.searchsorted(head, clustered)] = np.arange(len(clustered))
    with small_batches(spark, BLOBS):
        seeds = staged(seed_bigrams(bigrams, symbol, len(clustered)), "seeds")
    classes, history = exchange(seeds, len(clustered))
    head_class = np.append(band + CLASSES, KINDS - 1)
    head_class[np.searchsorted(head, clustered)] = classes[:len(clustered)]
    beside, head_class, grid, later = exchange_all(bigrams, head_class, tasks)
    discard(counts, seeds, bigrams)
    prior = (grid.sum(axis=0) + 1) / (grid.sum() + KINDS)
    transition = (grid + PRIOR * prior) / (grid.sum(axis=1, keepdims=True) + PRIOR)
    size, once, words = np.zeros(KINDS), np.zeros((LENGTHS, KINDS)), np.zeros((LENGTHS, KINDS))
    for r in totals(beside, head_class, np.append(band, LENGTHS)).groupBy("cls", "band").agg(*(F.sum(c).alias(c) for c in ("n", "v", "once"))).collect():
        size[r["cls"]] += r["n"]
        words[r["band"], r["cls"]], once[r["band"], r["cls"]] = r["v"], r["once"]
    words[np.arange(LENGTHS), CLASSES + np.arange(LENGTHS)] += 1e-9         # a length that no training word has
    unseen = np.where(once.any(axis=1), once.argmax(axis=1), words.argmax(axis=1))
    held = words.round().sum(axis=0) + np.bincount(unseen, minlength=KINDS)
    rest = tail_table(beside)
    held[-1], size[-1] = 1, bands.get(LENGTHS, (0, 0))[0]
    total = size + ADD * held
    transition = SHARE * transition + (1 - SHARE) * total / total.sum()     # words that occur once fit their classes too well
    return Model(head, n, head_class, np.log10(transition), np.log10(np.maximum(total, ADD)), unseen,
                 tokens, kinds, bands.get(LENGTHS, (0, 0))[0], history + later), rest


def score(docs: DataFrame, model: Model, rest: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_tokens``, ``n_known``, ``base_score`` (smoothed unigram) and ``score`` beside ``keep``; log10.

    Tokens are the lower-cased words and one end.  A null or empty text is its end alone.  With no
    training text every word has the smoothed probability of an unseen one.  Repeated rows and null
    keys are scored like others; other columns are not read.  Words outside the head leave the tasks with the classes beside them
    and are joined with their counts and classes, so no task needs the whole vocabulary.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.select(*keep).dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + (
        "n_tokens long, n_known long, base_part double, score_part double, tail array<long>, tail_band array<int>, ahead array<int>, behind array<int>")

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        head, end = Head(m.head), len(m.head)
        whole = np.log10(m.tokens + ADD * (m.kinds + 1))
        ends = m.ends
        # One more place, class and transition stand for words outside the head: they add nothing here.
        log_count = np.append(np.log10(m.head_count + ADD), [np.log10(ends + ADD), 0.0])
        emission = np.append(log_count[:-2] - m.class_total[m.head_class[:-1]], [0.0, 0.0])
        head_class, transition = np.append(m.head_class, KINDS), np.zeros((KINDS + 1, KINDS + 1))
        transition[:KINDS, :KINDS] = m.transition
        for batch in batches:
            for piece in slices(batch, "__text"):
                words = words_of(piece.column("__text"))
                rows = words.rows
                s = np.full(len(words.doc) + rows, end)
                place = np.arange(len(words.doc)) + words.doc       # of each word in the chain
                s[place] = head.symbols(words)
                row = np.repeat(np.arange(rows), np.diff(words.bounds()) + 1)
                rare = np.flatnonzero(s < 0)
                at = s.copy()
                at[rare] = end + 1
                cls = head_class[at]
                before = np.concatenate([[head_class[end]], cls[:-1]])
                base = log_count[at] - whole
                value = emission[at] + transition.ravel()[before * (KINDS + 1) + cls]
                known = np.diff(words.bounds()) - np.bincount(row[rare], minlength=rows) + (1 if ends else 0)
                outside = lambda x: np.where(x < KINDS, x, -1).astype(np.int32)
                cut = np.searchsorted(row[rare], np.arange(rows + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x))
                bands = np.zeros(len(s), np.int32)
                bands[place] = length_class(words)
                after = np.append(cls[1:], KINDS)                   # every text ends with its end
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:len(keep)], pa.array(np.diff(words.bounds()) + 1), pa.array(known),
                     pa.array(np.bincount(row, weights=base, minlength=rows)), pa.array(np.bincount(row, weights=value, minlength=rows)),
                     lists(s[rare]), lists(bands[rare]), lists(outside(before[rare])), lists(outside(after[rare]))],
                    [*keep, "n_tokens", "n_known", "base_part", "score_part", "tail", "tail_band", "ahead", "behind"])

    parts = docs.select(*keep, F.col(text).alias("__text")).mapInArrow(scan, schema)
    with small_batches(spark):
        parts = staged(parts.withColumn("__row", F.monotonically_increasing_id()), "scored")
    tail = parts.select("__row", F.posexplode(F.arrays_zip("tail", "tail_band", "ahead", "behind")).alias("pos", "z")).select(
        "__row", "pos", F.col("z.tail").alias("word"), F.col("z.tail_band").alias("band"), F.col("z.ahead").alias("ahead"), F.col("z.behind").alias("behind"))
    table = lambda x, names: spark.createDataFrame(list(x), names)          # at most KINDS squared rows
    unseen = table([(b, int(c)) for b, c in enumerate(model.unseen)], "band int, new int")
    totals = table([(c, float(x)) for c, x in enumerate(model.class_total)], "cls int, size double")
    steps = [(a, b, float(model.transition[a, b])) for a in range(KINDS) for b in range(KINDS)]
    classed = (tail.join(rest, "word", "left").join(F.broadcast(unseen), "band")
               .select("__row", "pos", "ahead", "behind", "c", F.coalesce("cls", "new").alias("cls")))
    follows = F.lag("cls").over(Window.partitionBy("__row").orderBy("pos"))
    linked = classed.withColumn("ahead", F.when(F.col("ahead") < 0, follows).otherwise(F.col("ahead")))
    met = (linked.join(F.broadcast(totals), "cls")
           .join(F.broadcast(table(steps, "ahead int, cls int, enter double")), ["ahead", "cls"])
           .join(F.broadcast(table(steps, "cls int, behind int, leave double")), ["cls", "behind"], "left")
           .withColumn("log", F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD)))
           .groupBy("__row")
           .agg(F.sum("log").alias("__log"), F.sum(F.col("log") - F.col("size") + F.col("enter") + F.coalesce("leave", F.lit(0.0))).alias("__step"),
                F.count("c").alias("__known")))
    part = lambda c: F.coalesce(c, F.lit(0.0))
    return parts.join(met, "__row", "left").select(
        *keep, "n_tokens", (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        (F.col("base_part") + part("__log")).alias("base_score"), (F.col("score_part") + part("__step")).alias("score"))
