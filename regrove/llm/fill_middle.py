"""Fill-in-the-middle transformation, cut by an indexable skip list.

A text is a list of tokens: each word with the separators before it, and separators at the end as
one more.  Each text of a batch has an indexable skip list over its tokens: lane 0 links
every token to the next, lane k + 1 links those of lane k that a hash of their rank promotes (one in four).  Every
link carries its width in tokens and in code points.  To cut after r tokens, the search starts at the head of the
top lane, follows links while their token widths still fit into r, and goes down a lane when they do not;
the code-point widths it has followed add up to the place of the cut.  All cuts of a batch descend together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PROMOTE = 2         # bits of the hash that must be zero for each lane above: one token in four


@dataclass
class Lane:
    """Links of one lane over all texts of a batch.

    Nodes of a text are consecutive, the head first; ``below`` is the node's place in the lane below
    (in lane 0 nodes are heads and tokens themselves), ``units`` and ``points`` the widths of the
    link that leaves it.  The last node of a text has no link: its width exceeds any rank.
    """
    below: np.ndarray
    units: np.ndarray
    points: np.ndarray


NO_LINK = np.int64(1) << 62


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and code points of every token, in order."""
    found = words.words_of(texts, lower=False)
    data, offsets = words.text_buffer(texts)
    size = np.diff(offsets)
    last = data[np.maximum(offsets[1:] - 1, 0)] if len(data) else np.zeros(len(size), np.uint8)
    trailing = np.flatnonzero((size > 0) & words.SEPARATOR[last])
    doc = np.concatenate([found.doc, trailing])
    end = np.concatenate([found.end, offsets[1:][trailing]])
    order = np.lexsort((end, doc))
    doc, end = doc[order], end[order]
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    return doc, before[end] - before[start]


def skip_list(doc: np.ndarray, points: np.ndarray, texts: int) -> list[Lane]:
    """Lanes over the tokens of some texts, lane 0 first."""
    count = np.bincount(doc, minlength=texts)
    heads = np.cumsum(count + 1) - (count + 1)                     # node of each head in lane 0
    nodes = len(doc) + texts
    is_head = np.zeros(nodes, bool)
    is_head[heads] = True
    owner = np.repeat(np.arange(texts), count + 1)
    rank = np.arange(nodes) - heads[owner]
    height = words.mix((rank.astype(np.uint64) + np.uint64(1)) * words.BASE)
    # Lane 0: the link that leaves a node leads over the token behind it.
    wide = np.zeros(nodes, np.int64)
    if len(doc):
        wide[np.flatnonzero(~is_head) - 1] = points
    last = np.append(is_head[1:], True)
    lanes = [Lane(np.arange(nodes), np.where(last, NO_LINK, 1), wide)]
    place, upto = np.arange(nodes), np.concatenate([[0], np.cumsum(wide)])
    level = 0
    while True:
        level += 1
        mask = np.uint64((1 << (PROMOTE * level)) - 1)
        keep = is_head[place] | ((height[place] & mask) == 0)
        if keep.sum() == texts:
            return lanes
        below, place = np.flatnonzero(keep), place[keep]
        nxt = np.append(place[1:], 0)
        end = np.append(owner[place[1:]] != owner[place[:-1]], True)
        lanes.append(Lane(below, np.where(end, NO_LINK, nxt - place), np.where(end, 0, upto[nxt] - upto[place])))


def descend(lanes: list[Lane], head: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Code points before the cut after ``rank`` tokens, for a text and rank each.

    ``head`` is the number of the text; as heads are in every lane and texts are in order, it is also
    the order of its head among the heads of a lane.
    """
    at = _heads(lanes)[head]
    left, points = rank.astype(np.int64).copy(), np.zeros(len(rank), np.int64)
    for lane in reversed(lanes):
        moving = np.flatnonzero(lane.units[at] <= left)
        while len(moving):
            here = at[moving]
            left[moving] -= lane.units[here]
            points[moving] += lane.points[here]
            at[moving] = here + 1
            moving = moving[lane.units[here + 1] <= left[moving]]
        at = lane.below[at] if lane is not lanes[0] else at
    return points


def _heads(lanes: list[Lane]) -> np.ndarray:
    """Places of the heads in the top lane: the first node, and each node after one without a link."""
    ends = np.flatnonzero(lanes[-1].units == NO_LINK)
    return np.concatenate([[0], ends[:-1] + 1])


def assemble(text: str, form: str, a: int, b: int) -> str:
    """The output for cuts after ``a`` and ``b`` code points."""
    if form == "psm":
        return f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
    if form == "spm":
        return f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return text


def restore(output: str = "output", form: str = "form") -> Column:
    """The text again, from output and form alone.

    Transformed texts hold no mark, and a mark cannot overlap a part of itself, so the first
    occurrence of each mark is the one that was set.
    """
    o = F.col(output)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(o, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(F.col(form) == "psm", F.concat(p, m, s)).when(F.col(form) == "spm", F.concat(p2, m2, s2)).otherwise(o)


def draws(key: str, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of 8 digits of the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",),
                   seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``keep``, tokens ``n``, ``form``, cuts (``prefix_chars``, ``middle_chars``) and ``output`` of every text.

    Of 100 texts ``rate`` are transformed, of these ``spm`` with the suffix first; the draws depend on ``seed`` and
    ``key`` only, so a text is cut alike whatever stands beside it.  Both cut ranks lie in 0 .. n, so any part may be empty.

    Null and empty texts, and texts that hold one of the marks, come out as they are (a null text as
    the empty one), with null widths.  A null key draws as an empty one; equal keys draw alike.  Repeated
    rows give repeated rows; an empty table gives none.  Texts of any length are cut whole.  Other columns
    are not read, so names such as ``n`` or ``output`` in ``docs`` cannot clash; a kept column of such a name is refused.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    if set(made) & set(keep):
        raise ValueError(f"kept columns may not be named {made}")
    names = [f"__keep{i}" for i in range(len(keep))]
    kinds = dict(docs.dtypes)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").cast("string").alias("__text"),
                       *[d.alias(f"__h{i}") for i, d in enumerate(draws(key, seed))])
    out_type = ", ".join([*[f"{n} {kinds[c]}" for c, n in zip(keep, names)],
                          "n long, form string, prefix_chars long, middle_chars long, output string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for part in words.slices(batch, "__text"):
                columns = _transform(part, rate, spm)
                arrays = [part.column(n) for n in names] + columns
                schema = schema or pa.schema([*[part.schema.field(n) for n in names],
                                              *[pa.field(n, a.type) for n, a in zip(made, columns)]])
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.mapInArrow(run, out_type).toDF(*keep, *made)


def _transform(part: pa.RecordBatch, rate: int, spm: int) -> list[pa.Array]:
    texts = part.column("__text")
    doc, points = tokens_of(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    h = [part.column(f"__h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
    strings = ["" if t is None else t for t in texts.to_pylist()]
    forms = ["plain"] * len(strings)
    for i in np.flatnonzero((h[2] % 100 < rate) & (n > 0)):
        t = strings[i]
        if not (PREFIX in t or SUFFIX in t or MIDDLE in t):
            forms[i] = "spm" if h[3][i] % 100 < spm else "psm"
    cut = np.array([i for i, f in enumerate(forms) if f != "plain"], np.int64)
    a = b = np.zeros(0, np.int64)
    if len(cut):
        ranks = np.sort(np.stack([h[0][cut] % (n[cut] + 1), h[1][cut] % (n[cut] + 1)]), axis=0)
        found = descend(skip_list(doc, points, len(strings)), np.tile(cut, 2), ranks.ravel())
        a, b = found[:len(cut)], found[len(cut):]
    prefix, middle = [None] * len(strings), [None] * len(strings)
    for i, x, y in zip(cut.tolist(), a.tolist(), b.tolist()):
        prefix[i], middle[i] = x, y - x
        strings[i] = assemble(strings[i], forms[i], x, y)
    return [pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
            pa.array(strings, pa.string())]
