"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text.  Labelled documents give preference
pairs (a good one over a bad one); the weights minimise the logistic loss on feature differences,
by Newton steps whose sums run on the cluster.  A quantile of the scores of the labelled documents
is the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ..session import staged
from .words import slices, text_buffer, window_hashes, words_of

FEATURES = ("log_words", "word_length", "distinct_words", "distinct_triples", "repeats_before", "distinct_lines", "line_length",
            "upper", "digits", "blanks", "stops", "marks", "symbols", "quotes", "brackets", "beyond_ascii", "log_ratio",
            "ratio_for_length", "short", "capital_starts")
BLOCK_ROWS = 20_000         # labelled rows that one task numbers at a time; without effect on results
ROUNDS = 12
PENALTY = 1e-3
CUT = 0.3                   # score at the threshold


def _group(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


GROUPS = [_group("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _group("0123456789"), _group(" \t\n\r\v\f"), _group(".,;:"), _group("!?"),
          _group("#$%&*|<>=_~^@+/\\"), _group("\"'`"), _group("()[]{}"), np.arange(256) >= 128]


def distinct_share(value: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values / values of each row; 1 for a row without any."""
    cut = np.searchsorted(doc, np.arange(rows + 1))
    n = np.diff(cut)
    found = np.array([len(np.unique(value[cut[i]:cut[i + 1]])) for i in range(rows)], float)
    return np.where(n > 0, found / np.maximum(n, 1), 1.0)


def text_features(texts: pa.Array, press: zstandard.ZstdCompressor) -> np.ndarray:
    """One row of ``FEATURES`` per text; shares of bytes or words, logarithms of sizes."""
    data, offsets = text_buffer(texts)
    words = words_of(texts, lower=False)
    rows = words.rows
    n_bytes, n_words = np.diff(offsets), np.diff(words.bounds())
    some = np.maximum(n_bytes, 1)
    count = np.maximum(n_words, 1)
    hist = np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(rows, 256)
    shares = [hist[:, g].sum(axis=1) for g in GROUPS]
    letters = np.maximum(hist[:, 65:91].sum(axis=1) + hist[:, 97:123].sum(axis=1), 1)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    first = data[words.start]
    triples, triple_doc = window_hashes(words, 3)
    raw = data.tobytes()
    lines = [raw[a:b].split(b"\n") for a, b in zip(offsets[:-1], offsets[1:])]
    packed = np.array([len(press.compress(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:])], float)
    log_ratio = np.where(n_bytes > 0, np.log(some / np.maximum(packed, 1)), 0.0)
    log_words = np.log1p(n_words)
    columns = [
        log_words, np.add.reduceat(np.append(words.end - words.start, 0), words.bounds()[:-1]) * (n_words > 0) / count
        if rows else np.zeros(0), distinct_share(words.hash, words.doc, rows), distinct_share(triples, triple_doc, rows),
        np.bincount(words.doc[again], minlength=rows) / count, np.array([len(set(x)) / len(x) for x in lines]),
        np.log1p(n_bytes / np.array([len(x) for x in lines])), shares[0] / letters, *(s / some for s in shares[1:]),
        log_ratio, log_ratio / np.maximum(np.log(n_bytes + 2.0), 1), np.exp(-n_words / 50.0),
        np.bincount(words.doc[(first >= 65) & (first <= 90)], minlength=rows) / count]
    return np.column_stack(columns).astype(float) if rows else np.zeros((0, len(FEATURES)))


def featured(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``features`` beside ``keep``; a null or empty text has the features of no bytes."""
    kinds = dict(docs.select(*keep).dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "features array<double>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_content_size=False)
        for batch in batches:
            for piece in slices(batch, "__text"):
                x = text_features(piece.column("__text"), press)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:len(keep)], lists], [*keep, "features"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(scan, schema)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(FEATURES))


def cluster_sums(frame: DataFrame, column: str, terms) -> np.ndarray:
    """Sum over all rows of ``terms(matrix)``, a vector of fixed length; one partial vector per task."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + terms(matrix(batch.column(0)))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    got = frame.select(column).mapInArrow(scan, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(max(len(got), 1))
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out


def preference_pairs(labelled: DataFrame, label: str, key: str) -> DataFrame:
    """Differences of features, good minus bad.

    Rows of each label are numbered without gaps, in hashed order.  The larger side is dealt in turn to
    the rows of the smaller one, so every row of both sides is in a pair however rare a label is, and the
    pairs number as many as the larger side: no product is formed.  Repeated rows count as often as they
    come.  With one kind of label there are no pairs; labels other than 0 and 1 are not read.
    """
    rows = labelled.filter(F.col(label).isin(0, 1))
    blocks = 1 + rows.count() // BLOCK_ROWS
    rows = rows.withColumn("__h", F.xxhash64(key, "features")).withColumn("__b", F.pmod("__h", F.lit(blocks)))
    sizes = rows.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    totals = {r[0]: r[1] for r in sizes.groupBy(label).agg(F.sum("__n")).collect()}         # two rows at most
    fewer = max(min(totals.get(0, 0), totals.get(1, 0)), 1)
    # One row per label and BLOCK_ROWS rows.
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(label).orderBy("__b")) - F.col("__n")).drop("__n")
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h")) - 1)
    dealt = ranked.join(before, [label, "__b"]).withColumn("__s", (F.col("__before") + F.col("__r")) % fewer)
    good = dealt.filter(F.col(label) == 1).select("__s", F.col("features").alias("g"))
    bad = dealt.filter(F.col(label) == 0).select("__s", F.col("features").alias("f"))
    return good.join(bad, "__s").select(F.zip_with("g", "f", lambda x, y: x - y).alias("difference"))


@dataclass
class Ranker:
    weights: np.ndarray         # on plain features
    threshold: float
    losses: list[float]


def fit(labelled: DataFrame, label: str = "label", key: str = "doc_id") -> Ranker:
    """Weights and threshold from rows with ``features`` and a 0/1 label; all labelled rows are used.

    The threshold is the quantile of the labelled rows' scores at the share of label 0.  Without pairs
    (no row, or one kind of label) all weights are 0.
    """
    d = len(FEATURES)
    pairs = staged(preference_pairs(labelled, label, key), "preferences")
    moments = cluster_sums(pairs, "difference", lambda x: np.concatenate([[len(x)], (x * x).sum(axis=0)]))
    n = moments[0]
    if len(moments) == 1 or n == 0:
        return Ranker(np.zeros(d), 0.0, [])
    scale = np.sqrt(moments[1:] / n)
    inverse = np.where(scale > 1e-12, 1 / np.maximum(scale, 1e-12), 0.0)
    w, losses = np.zeros(d), []

    def terms(v):
        def part(x):
            z = x * inverse
            m = z @ v
            p = 1 / (1 + np.exp(np.clip(m, -700, 700)))
            return np.concatenate([[np.logaddexp(0, -m).sum()], z.T @ p, ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
        return part

    step, best = np.zeros(d), np.inf
    for _ in range(ROUNDS):
        got = cluster_sums(pairs, "difference", terms(w + step))
        loss = got[0] / n + PENALTY * float((w + step) @ (w + step)) / 2
        if loss > best:         # too long a step
            step = step / 2
            continue
        w, gain, best = w + step, best - loss, loss
        losses.append(loss)
        if gain < 1e-7:
            break
        gradient = got[1:1 + d] / n - PENALTY * w
        hessian = got[1 + d:].reshape(d, d) / n + PENALTY * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
    weights = w * inverse
    scored = labelled.select(linear(weights).alias("s"), label)
    share, = labelled.agg(F.avg((F.col(label) == 0).cast("double"))).first()
    threshold = scored.agg(F.percentile_approx("s", float(share), 100_000)).first()[0]
    return Ranker(weights, float(threshold), losses)


def linear(weights: np.ndarray):
    """Sum of weights times features, in the engine."""
    terms = [F.lit(float(v)) * F.element_at("features", i + 1) for i, v in enumerate(weights) if v != 0]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def score(rows: DataFrame, model: Ranker, cut: float = CUT) -> DataFrame:
    """``score`` in 0 .. 1, equal to ``cut`` at the threshold, and ``predicted``."""
    shift = float(np.log(cut / (1 - cut)))
    s = 1 / (1 + F.exp(-(linear(model.weights) - F.lit(model.threshold) + F.lit(shift))))
    # The comparison is made before rounding by the logistic function can move the threshold itself.
    above = linear(model.weights) >= F.lit(model.threshold)
    fixed = F.when(above, F.greatest(s, F.lit(cut))).otherwise(F.least(s, F.lit(cut - 1e-12)))
    return rows.withColumn("score", fixed).withColumn("predicted", (F.col("score") >= cut).cast("int")).drop("features")
