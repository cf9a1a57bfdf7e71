"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of
a word is the sum over all its segmentations into pieces, found by a forward pass; a text's is the
product over its words.  Piece probabilities are learnt by expectation maximisation with the same
sums, so no segmentation is ever chosen.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import U64, lean, mix, worker_memo

LONGEST = 48                    # letters of words that are scored as whole matrices; longer ones are scored one by one
LETTERS = re.compile(r"[^\W\d_]+")
START = 0x2581                  # the vocabulary's mark of a word's first piece
SAMPLE = 1500                   # training documents of each language, about; chosen by hash
FLOOR = 1e-9                    # probability of a letter that is in no piece, and of a piece never expected
ROUNDS = 3
REMEMBERED = 100_000            # words a worker remembers
MEMOS = ("vocabulary", "language")


def public_pieces(path: str) -> list[str]:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Vocabulary:
    """Pieces of letters (lower case), looked up by hash and length for whole matrices of words."""

    def __init__(self, pieces: list[str]):
        mark = chr(START)
        kept = sorted({p for p in pieces if p.lower() == p and (p == mark or LETTERS.fullmatch(p.removeprefix(mark)))})
        self.pieces = kept
        self.longest = max(map(len, kept), default=1)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(kept):
            by_length.setdefault(len(p), []).append(i)
        self.tables = {n: PieceTable([kept[i] for i in at], np.array(at)) for n, at in by_length.items()}

    def __len__(self) -> int:
        return len(self.pieces)

    def lookup(self, codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each length, the piece at every start (-1: none) of words given as rows of code points."""
        out, h = [], None
        width = codes.shape[1]
        for n in range(1, min(self.longest, width) + 1):
            tail = codes[:, n - 1:].astype(U64)
            h = mix(tail + U64(n)) if h is None else mix(h[:, :width - n + 1] * U64(0x100000001B3) + tail + U64(n))
            if n in self.tables:
                out.append((n, self.tables[n].find(h)))
        return out


class PieceTable:
    """Pieces of one length by hash: two arrays addressed by different bits, the rest sorted."""
    BITS = 16

    def __init__(self, pieces: list[str], ids: np.ndarray):
        keys = np.array([piece_hash(p) for p in pieces], U64)
        self.levels = []
        for shift in (64 - self.BITS, 64 - 2 * self.BITS):
            place = self._place(keys, shift)
            table, found = np.zeros(1 << self.BITS, U64), np.full(1 << self.BITS, -1, np.int32)
            table[place], found[place] = keys, ids
            self.levels.append((shift, table, found))
            left = table[place] != keys
            keys, ids = keys[left], ids[left]
        order = np.argsort(keys)
        self.rest, self.rest_ids = keys[order], ids[order].astype(np.int32)

    def _place(self, h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> U64(shift)) & U64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        for shift, table, found in self.levels:
            place = self._place(h, shift)
            out = np.where(table[place] == h, found[place], out)
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h), len(self.rest) - 1)
            out = np.where(self.rest[at] == h, self.rest_ids[at], out)
        return out


def piece_hash(piece: str) -> np.uint64:
    h = None
    for n, c in enumerate(np.array([ord(c) for c in piece], U64), 1):
        c = np.array([c])
        h = mix(c + U64(n)) if h is None else mix(h * U64(0x100000001B3) + c + U64(n))
    return h[0]


def letters_only(word: str) -> str:
    """The word without numerals that the pattern takes for letters, such as superscripts."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def cut_words(text: str) -> list[str]:
    """Runs of letters in lower case; ``letters_only`` of each distinct one is the word that is scored."""
    return LETTERS.findall(text.lower())


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of equal length: their positions and code points, the start mark in front."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), 8192):
            part = at[i:i + 8192]
            codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield part, np.column_stack([np.full(len(part), START, np.uint32), codes.reshape(len(part), n)])


@dataclass
class Pieces:
    """Languages and the probability of each piece in each (pieces x languages)."""
    languages: list[str]
    probability: np.ndarray


def forward(codes: np.ndarray, vocabulary: Vocabulary, p: np.ndarray):
    """Sums over segmentations of every prefix, the piece matrices used, and the unknown-letter steps."""
    rows, width = codes.shape
    found = vocabulary.lookup(codes)
    padded = np.vstack([p, np.zeros((1, p.shape[1]))])       # index -1: no such piece
    missing = unknown_letters(found, rows, width)
    sums = np.zeros((width + 1, rows, p.shape[1]))
    sums[0] = 1.0
    for end in range(1, width + 1):
        for n, ids in found:
            if n <= end:
                sums[end] += sums[end - n] * padded[ids[:, end - n]]
        if missing[:, end - 1].any():
            sums[end] += sums[end - 1] * np.where(missing[:, end - 1], FLOOR, 0.0)[:, None]
    return sums, found, padded


def unknown_letters(found, rows: int, width: int) -> np.ndarray:
    return next((ids < 0 for n, ids in found if n == 1), np.ones((rows, width), bool))


def word_scores(words: list[str], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """log probability of each word in each language; of the empty word 0."""
    out = np.zeros((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if 0 < len(w) <= LONGEST]
    for at, codes in by_length([words[i] for i in short]):
        out[np.array(short)[at]] = np.log(np.maximum(forward(codes, vocabulary, p)[0][-1], 1e-300))
    for i, w in enumerate(words):
        if len(w) > LONGEST:
            out[i] = long_word_score(w, vocabulary, p)
    return out


def long_word_score(word: str, vocabulary: Vocabulary, p: np.ndarray, block: int = 4096) -> np.ndarray:
    """The same sum for a word of any length: only the last prefix sums are kept, scaled before they get too small."""
    codes = np.concatenate([[START], np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)])
    padded = np.vstack([p, np.full((1, p.shape[1]), FLOOR), np.zeros((1, p.shape[1]))])     # last rows: an unknown letter, no piece
    reach, unknown, none = vocabulary.longest, len(p), len(p) + 1
    last = np.zeros((reach, p.shape[1]))        # sums of the prefixes before, the nearest first
    last[0] = 1.0
    scale = np.zeros(p.shape[1])
    for a in range(0, len(codes), block):
        part = codes[max(0, a - reach + 1):a + block]
        ends = np.full((len(part), reach), none, np.int64)
        known = np.zeros(len(part), bool)
        for n, ids in vocabulary.lookup(part[None, :]):
            ends[n - 1:, n - 1] = np.where(ids[0] >= 0, ids[0], none)
            if n == 1:
                known = ids[0] >= 0
        ends[~known, 0] = unknown
        for row in ends[len(part) - min(block, len(codes) - a):]:
            now = (last * padded[row]).sum(axis=0)
            last = np.concatenate([now[None], last[:-1]])
            if now.min() < 1e-150:
                top = np.maximum(last.max(axis=0), 1e-300)
                last, scale = last / top, scale + np.log(top)
    return scale + np.log(np.maximum(last[0], 1e-300))


def expected(words: list[str], counts: np.ndarray, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations, words weighted by ``counts`` (words x languages)."""
    total = np.zeros((len(vocabulary), p.shape[1]))
    for at, codes in by_length(words):
        sums, found, padded = forward(codes, vocabulary, p)
        rows, width = codes.shape
        back = np.zeros_like(sums)
        back[width] = 1.0
        missing = unknown_letters(found, rows, width)
        for start in range(width - 1, -1, -1):
            for n, ids in found:
                if start + n <= width:
                    back[start] += back[start + n] * padded[ids[:, start]]
            if missing[:, start].any():
                back[start] += back[start + 1] * np.where(missing[:, start], FLOOR, 0.0)[:, None]
        weight = counts[at] / np.maximum(sums[-1], 1e-300)
        pieces, uses = [], []
        for n, ids in found:
            for start in range(width - n + 1):
                hit = np.flatnonzero(ids[:, start] >= 0)
                piece = ids[hit, start]
                pieces.append(piece)
                uses.append(sums[start][hit] * back[start + n][hit] * padded[piece] * weight[hit])
        if pieces:
            piece, use = np.concatenate(pieces), np.concatenate(uses)
            for lang in range(total.shape[1]):
                total[:, lang] += np.bincount(piece, weights=use[:, lang], minlength=len(total))
    return total


def remembered_vocabulary(pieces: list[str]) -> Vocabulary:
    """One vocabulary for each Python worker, kept from task to task."""
    memo = worker_memo("vocabulary")
    if memo.get("pieces") != pieces:
        memo.update(pieces=pieces, vocabulary=Vocabulary(pieces))
    return memo["vocabulary"]


def learn(rows: DataFrame, text: str, language: str, pieces: list[str], order: str = "doc_id") -> Pieces:
    """Piece probabilities from a bounded sample of labelled rows: about ``SAMPLE`` of each language, chosen by hash.

    Labelled rows are counted per language first; a language of at most ``SAMPLE`` rows is learnt from all
    of them, however many rows the others have.  Word counts per language are gathered once; each round
    spreads the words over tasks, which return only sums of the size of the vocabulary.  Without labelled
    rows there is no language.
    """
    spark = rows.sparkSession
    labelled = rows.filter(F.col(language).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("t"), F.col(language).alias("l"), F.pmod(F.xxhash64(order, text), F.lit(1_000_000_007)).alias("h"))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}      # one row per language
    # A threshold on the hash takes that share of a language without sorting or moving any text.
    limits = spark.createDataFrame([(l, int(min(1.0, SAMPLE / n) * 1_000_000_007)) for l, n in sizes.items()], "l string, below long")
    sample = labelled.join(F.broadcast(limits), "l").filter("h < below")

    def count(batches):
        from collections import Counter
        for batch in batches:
            table: dict = {}
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table.setdefault(l, Counter()).update(cut_words(t))
            for l, runs in table.items():
                c: Counter = Counter()
                for w, n in runs.items():
                    w = letters_only(w)
                    for i in range(0, len(w), LONGEST):     # learning cuts longer words
                        c[w[i:i + LONGEST]] += n
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(c), pa.string()), pa.array(list(c), pa.string()),
                                                  pa.array(list(c.values()), pa.int64())], ["l", "w", "n"])

    counted = (sample.select("t", "l").repartition(max(8, 2 * len(sizes))).mapInArrow(lean(count, MEMOS), "l string, w string, n long")
               .groupBy("w", "l").agg(F.sum("n").alias("n")).groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("m")))
    counted = counted.persist()      # bounded by the sample; a lost part is counted again
    languages = [r[0] for r in counted.select(F.explode(F.map_keys("m")).alias("l")).distinct().orderBy("l").collect()]
    vocabulary = Vocabulary(pieces)
    p = np.tile(np.array([[1 / 27.0 ** len(x)] for x in vocabulary.pieces]), (1, max(len(languages), 1)))
    p /= p.sum(axis=0)
    for _ in range(ROUNDS if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, p, languages))

        def step(batches):
            known, prob, names = shared.value
            vocab = remembered_vocabulary(known)
            total = np.zeros((len(vocab), len(names)))
            for batch in batches:
                words = batch.column(0).to_pylist()
                maps = [dict(m) for m in batch.column(1).to_pylist()]
                counts = np.array([[m.get(l, 0) for l in names] for m in maps], float).reshape(len(words), len(names))
                total += expected(words, counts, vocab, prob)
            at, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang), pa.array(total[at, lang])], ["piece", "lang", "n"])

        table = counted.mapInArrow(lean(step, MEMOS), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        new = np.zeros_like(p)       # at most vocabulary x languages numbers
        new[table["piece"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
        p = (new + 0.01) / (new + 0.01).sum(axis=0)
        shared.unpersist()
    counted.unpersist()
    return Pieces(languages, np.maximum(p, FLOOR))


def identify(docs: DataFrame, model: Pieces, pieces: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             temper: float = 0.25) -> DataFrame:
    """``lang_pred`` and ``score`` (posterior of that language under equal priors) beside ``keep``.

    Words depend on each other, so log likelihoods are multiplied by ``temper`` before they become a
    posterior.  A text that is null or has no letter, and every text when nothing was learnt, is ``und``
    with score 0.  Ties go to the first language by name.  Whole texts are scored, words of any length
    too.  Repeated rows give repeated rows; an empty table gives none.  Columns that are not kept are not read; a
    kept column may not be named ``lang_pred`` or ``score``.  One pass without a shuffle.
    """
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("kept columns may not be named lang_pred or score")
    kinds = dict(docs.select(*keep).dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast((pieces, model.probability, model.languages, uuid.uuid4().hex))
    place = keep.index(text) if text in keep else len(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, p, names, version = shared.value
        memo = worker_memo("language")
        if memo.get("version") != version:      # words stay known from task to task of the same model
            memo.clear()
            memo.update(version=version, index={}, table=np.zeros((1 << 16, len(names))), lettered=np.zeros(1 << 16, bool))
        vocabulary, index = remembered_vocabulary(known), memo["index"]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [cut_words(t) if t else [] for t in part.column(place).to_pylist()]
                if len(index) > REMEMBERED:
                    index.clear()
                flat = list(itertools.chain.from_iterable(found)) if names else []
                at = list(map(index.get, flat))
                if None in at:
                    fresh = list(dict.fromkeys(w for w, i in zip(flat, at) if i is None))
                    first, last = len(index), len(index) + len(fresh)
                    if last > len(memo["table"]):
                        memo["table"] = np.vstack([memo["table"][:first], np.zeros((last, len(names)))])
                        memo["lettered"] = np.append(memo["lettered"][:first], np.zeros(last, bool))
                    clean = [letters_only(w) for w in fresh]
                    memo["table"][first:last] = word_scores(clean, vocabulary, p)
                    memo["lettered"][first:last] = [bool(w) for w in clean]
                    index.update(zip(fresh, range(first, last)))
                    at = list(map(index.__getitem__, flat))
                at = np.array(at, np.int64)
                values, lettered = memo["table"][at], memo["lettered"][at]
                ends = np.cumsum([len(ws) for ws in found]) if names else np.zeros(len(found), np.int64)
                pred, score = [], []
                for ws, end in zip(found, ends):
                    if not names or not lettered[end - len(ws):end].any():
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = values[end - len(ws):end].sum(axis=0) * temper
                    best = int(total.argmax())
                    pred.append(names[best])
                    score.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                                 [*keep, "lang_pred", "score"])

    # A kept text is sent to Python once.
    return docs.select(*keep, *([] if text in keep else [F.col(text).alias("__text")])).mapInArrow(lean(scan, MEMOS), schema)
