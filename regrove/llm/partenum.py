"""N-gram Jaccard join with PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity 3/4 or more differ in at most (a + b) / 7
elements.  Sizes fall into bands whose ends differ by a factor of 4/3, so a linked pair lies in
one band or in two neighbouring ones; each band has an instance of the scheme that signs its own
sets and those of the band below.

Very frequent features carry no evidence but fill buckets, and leaving out any fixed set of
features only lowers differences.  So the domain of the other features is first divided by hash into many parts, alike for five neighbouring bands.
A pair that differs in at most k features differs in at most k parts, so of any k + 1 parts that
one set fills, one is equal in both: a set is signed by the contents of its first k + 1 filled parts (subsets of one part each).
Features of that domain are rare, so one or two of them are evidence enough.

Sets that fill too few of those parts consist of frequent features (members of large groups of copies, mostly).  They are signed over the
whole domain by the two-level scheme, which gathers more evidence: n1 parts, one of which differs in at most K2 features,
each cut into N2 sub-parts, of which N2 - K2 are then equal; every subset of N2 - K2 sub-parts gives a signature.  In the instances of the smallest
sizes they are signed by the smallest elements of their prefix instead, which also is exact.

Candidates must agree in size and, by a bitmap of parities, in their least possible difference; all that do are verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, staged
from .components import connected_components
from .frequent import most_frequent
from .words import U64, lean, mix, slices, small_batches, window_hashes, words_of

WORDS = 5
#: Similarity 75 / 100.
NEED, OF = 75, 100
FREQUENT = 1 << 20          # most features left out of the domain (8 MB sent to each task)
COUNTED = 1 << 20           # shingles counted together before only the frequent ones are kept
LOCALLY, OVERALL = 2, 6     # least texts of one count, and of all counts, for a frequent feature
ROWS_PER_TASK = 1_000_000   # signatures met in one task
SPREAD = 32                 # tasks over which a signature that may be met by very many sets is dealt
BLOOM_WORDS = 1 << 20       # 64-bit words of the filter of candidate classes (8 MB, whatever the input)
FINE = 130                  # parts of a domain for 100 elements of the largest set
GROUPED = 5                 # neighbouring bands that share these parts, so that few sets need two lots of signatures
K2, N2 = 1, 3               # differences that a first-level part may hold, sub-parts of a part
SUBSETS = [c for c in itertools.combinations(range(N2), N2 - K2)]
SMALLEST = 24               # largest size of an instance whose sets are signed by prefixes instead of two levels
PARITY = 2048               # bits of the parity bitmap
FIRST_WORDS = 8             # words of it that settle most pairs
SALT = mix(np.arange(101, 113, dtype=U64))


class Sets:
    """Distinct shingle hashes of some texts, row after row."""

    def __init__(self, texts: pa.Array):
        words = words_of(texts)
        shingles, doc = window_hashes(words, WORDS)
        rows = len(texts)
        cut = np.searchsorted(doc, np.arange(rows + 1))
        parts = [np.unique(shingles[cut[i]:cut[i + 1]]) for i in range(rows)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.value = np.concatenate(parts) if parts else np.zeros(0, U64)
        self.doc = np.repeat(np.arange(rows), self.size)

    def identity(self) -> np.ndarray:
        """One hash per set; equal sets have equal ones (64 bits, and the size goes in)."""
        total = np.zeros(len(self.size), U64)
        filled = self.size > 0
        if filled.any():
            total[filled] = np.add.reduceat(mix(self.value ^ SALT[0]), self.start[:-1][filled])
        return mix(total + self.size.astype(U64) * SALT[1]).view(np.int64)

    def parities(self) -> np.ndarray:
        """For each set, ``PARITY`` bits: is the number of elements that hash to the bit odd?  Two sets differ in at least as many elements as bits."""
        rows = len(self.size)
        place = self.doc * PARITY + (mix(self.value ^ SALT[8]) % U64(PARITY)).astype(np.int64)
        odd = (np.bincount(place, minlength=rows * PARITY) & 1).astype(np.uint8).reshape(rows, PARITY)
        return np.packbits(odd, axis=1).view(np.int64)

    def only(self, rows: np.ndarray) -> "Sets":
        """The sets of some rows (a mask)."""
        out = object.__new__(Sets)
        keep = rows[self.doc] if len(self.doc) else np.zeros(0, bool)
        out.size = self.size[rows]
        out.start = np.concatenate([[0], np.cumsum(out.size)])
        out.value = self.value[keep]
        out.doc = np.repeat(np.arange(len(out.size)), out.size)
        return out


def band_ends(largest: int) -> np.ndarray:
    """Largest size of each band, up to one that holds ``largest``."""
    ends, low = [], 1
    while not ends or ends[-1] < largest:
        ends.append(low * OF // NEED)
        low = ends[-1] + 1
    return np.array(ends, np.int64)


class Frequent:
    """Membership in a sorted array, behind a bit per hash prefix."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.first = np.zeros(1 << 22, bool)
        self.first[(values >> U64(42)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        found = self.first[(x >> U64(42)).astype(np.int64)]
        at = np.flatnonzero(found)
        if len(at):
            place = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
            found[at] = self.values[place] == x[at]
        return found


def parts_signed(value: np.ndarray, doc: np.ndarray, instance: np.ndarray, parts: np.ndarray, most: np.ndarray,
                 salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the first ``most + 1`` filled parts of each set, the set of each, sets that fill too few."""
    rows = len(parts)
    part = mix(value ^ SALT[2]) % parts[doc].astype(U64)
    order = np.lexsort((part, doc)) if len(doc) and int(parts.max()) >= 1 << 31 else np.argsort(
        (doc.astype(U64) << U64(32)) | part, kind="stable")
    part, owner, content = part[order], doc[order], mix(value[order] ^ SALT[3])
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    if len(at) == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.ones(rows, bool)
    total = np.add.reduceat(content, at)
    owner, part = owner[at], part[at]
    first = np.searchsorted(owner, np.arange(rows + 1))
    rank = np.arange(len(owner)) - first[owner]
    keep = rank <= most[owner]
    signature = mix(total + mix(instance[owner].astype(U64) * SALT[4] + part * SALT[5] + salt))
    return signature[keep], owner[keep], np.diff(first) <= most


def two_level_signed(value: np.ndarray, doc: np.ndarray, rows: np.ndarray, instance: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures over all subsets of sub-parts, of the sets in ``rows``, and the set of each.

    ``value`` and ``doc`` are the elements of those sets; ``instance`` is the instance of every set.  All parts are signed, an empty one too: it may be
    the one in which a pair agrees.
    """
    k = 2 * ends[instance[rows]] // 7
    n1 = k // (K2 + 1) + 1
    start = np.cumsum(n1) - n1                          # first part of each set
    local = np.searchsorted(rows, doc)
    h = mix(value ^ SALT[9])
    part = start[local] + ((h >> U64(32)) % n1[local].astype(U64)).astype(np.int64)
    content = np.zeros(int(n1.sum()) * N2, U64)
    np.add.at(content, part * N2 + ((h & U64(0xFFFFFFFF)) % U64(N2)).astype(np.int64), mix(value ^ SALT[3]))
    content = content.reshape(-1, N2)
    owner = np.repeat(np.arange(len(rows)), n1)
    name = mix(instance[rows][owner].astype(U64) * SALT[4] + (np.arange(len(owner)) - start[owner]).astype(U64) * SALT[5] + SALT[7])
    placed = mix(content + np.arange(1, N2 + 1, dtype=U64) * SALT[10])
    out = [mix(placed[:, list(c)].sum(axis=1, dtype=U64) + name + U64(n) * SALT[11]) for n, c in enumerate(SUBSETS)]
    return np.concatenate(out), np.tile(rows[owner], len(SUBSETS))


def signatures(sets: Sets, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of the sets, the row of each, and whether it may be met by very many sets."""
    rows = np.flatnonzero(sets.size > 0)
    if len(rows) == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
    n = sets.size
    ends = band_ends(int(n.max()) * OF // NEED + 1)
    ends = np.append(ends, band_ends(int(ends[-1]) * 4)[len(ends):])      # whole groups of bands
    band = np.searchsorted(ends, n)
    largest = n * OF // NEED                       # of a linked partner
    rare = ~frequent(sets.value)
    out, own, wide = [], [], []
    too_few = np.zeros(len(n), bool)
    for step in (0, 1):                            # the parts of the own group of bands, and those of the next group if a partner may lie there
        group = (band + step) // GROUPED
        last = ends[group * GROUPED + GROUPED - 1]
        reach = np.minimum(largest, ends[band // GROUPED * GROUPED + GROUPED - 1]) if step == 0 else largest
        wanted = n > 0 if step == 0 else (n > 0) & (group > band // GROUPED) & (largest > ends[band])
        use = wanted[sets.doc] & rare
        sig, who, few = parts_signed(sets.value[use], sets.doc[use], group, last * FINE // 100 + 2, (n + reach) // 7, SALT[6])
        out.append(sig)
        own.append(who)
        wide.append(np.zeros(len(sig), bool))
        too_few |= few & wanted
    for step in (0, 1):                            # the instance of the own band, and of the next one
        instance = band + step
        wanted = too_few if step == 0 else too_few & (largest > ends[band])
        deep = wanted & (ends[instance] > SMALLEST)
        if deep.any():
            use = deep[sets.doc]
            sig, who = two_level_signed(sets.value[use], sets.doc[use], np.flatnonzero(deep), instance, ends)
            out.append(sig)
            own.append(who)
            wide.append(np.ones(len(sig), bool))
        for row in np.flatnonzero(wanted & (ends[instance] <= SMALLEST)):
            values = sets.value[sets.start[row]:sets.start[row + 1]]     # ascending
            prefix = values[:len(values) - -(-len(values) * NEED // OF) + 1]
            out.append(mix(prefix + SALT[0]))
            own.append(np.full(len(prefix), row))
            wide.append(np.ones(len(prefix), bool))
    return np.concatenate(out), np.concatenate(own), np.concatenate(wide)


def describe(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """A row per text with its set's size and identity; further rows count features frequent in a task."""
    kinds = dict(docs.select(*keep).dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_shingles long, cls long, parity array<long>, feature long, texts long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, empty = [*keep, "n_shingles", "cls", "parity", "feature", "texts"], None
        held, amount, seen = [], 0, set()

        def counted():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCALLY
            value, n = value[often].view(np.int64), n[often]
            none = [pa.nulls(len(value), c.type) for c in empty]
            return pa.RecordBatch.from_arrays([*none, pa.nulls(len(value), pa.int64()), pa.nulls(len(value), pa.int64()), pa.nulls(len(value), pa.list_(pa.int64())),
                                               pa.array(value), pa.array(n)], names)

        for batch in batches:
            for piece in slices(batch, "__text"):
                empty = [c.slice(0, 0) for c in piece.columns[:len(keep)]]
                sets = Sets(piece.column("__text"))
                cls = sets.identity()
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:len(keep)], pa.array(sets.size), pa.array(cls, mask=sets.size == 0), parity_lists(sets),
                     pa.nulls(len(cls), pa.int64()), pa.nulls(len(cls), pa.int64())], names)
                fresh = first_seen(cls, seen)
                held.append(sets.value[fresh[sets.doc]])
                amount += len(held[-1])
                if amount >= COUNTED:
                    yield counted()
                    held, amount = [], 0
        if held:
            yield counted()

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(lean(scan), schema)


def parity_lists(sets: Sets) -> pa.Array:
    bits = sets.parities()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))


def first_seen(cls: np.ndarray, seen: set) -> np.ndarray:
    """Rows whose set was not met before in this task."""
    fresh = np.zeros(len(cls), bool)
    for i, c in enumerate(cls.tolist()):
        if c not in seen:
            seen.add(c)
            fresh[i] = True
    return fresh


def frequent_features(described: DataFrame) -> np.ndarray:
    """The most frequent features, at most ``FREQUENT``; any choice leaves the join exact."""
    counts = staged(described.filter("feature is not null").groupBy("feature").agg(F.sum("texts").alias("texts"))
                    .filter(F.col("texts") >= OVERALL), "frequent")
    top = most_frequent(counts, "feature", "texts", FREQUENT).select("feature")
    return np.sort(np.array(top.toArrow().column(0).to_numpy(), np.int64).view(U64))


def signed(docs: DataFrame, text: str, frequent: np.ndarray) -> DataFrame:
    """(sig, cls, part) of every text; copies of a set within a task are signed once.

    ``part`` is 0, or deals a wide signature over ``SPREAD`` tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)      # bounded by FREQUENT

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = Frequent(shared.value), set()
        for batch in batches:
            for piece in slices(batch, "__text"):
                sets = Sets(piece.column(0))
                cls = sets.identity()
                fresh = first_seen(cls, seen)
                sig, who, wide = signatures(sets.only(fresh), often)
                own = cls[fresh][who]
                part = np.where(wide, 1 + own.view(U64) % U64(SPREAD), 0).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(own), pa.array(part)], ["sig", "cls", "part"])

    return docs.select(F.col(text).alias("__text")).mapInArrow(lean(scan), "sig long, cls long, part byte")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the buckets that hold several sets; a task has all rows of its (signature, part).

    A bucket of part 0 is complete, so its ``centre``, the least member, is known here; buckets of equal
    members are one.  Wide rows pass on without a centre.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    sig, cls, part = (np.concatenate([b.column(i).to_numpy() for b in tables]) for i in range(3))
    del tables
    order = np.argsort(sig, kind="stable")
    sig, cls, part = sig[order], cls[order], part[order]
    same = np.zeros(len(sig), bool)
    same[1:] = sig[1:] == sig[:-1]
    group = same.copy()
    group[:-1] |= same[1:]
    group |= part > 0
    sig, cls, part = sig[group], cls[group], part[group]
    order = np.lexsort((cls, sig))
    sig, cls, part = sig[order], cls[order], part[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    sig, cls, part = sig[new], cls[new], part[new]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    at = np.flatnonzero(first)
    if len(at) == 0:
        return
    size = np.diff(np.append(at, len(sig)))
    content = mix(np.add.reduceat(mix(cls.view(U64)), at) + size.astype(U64))
    once = np.zeros(len(at), bool)
    once[np.unique(content, return_index=True)[1]] = True
    wide = part[at] > 0
    keep = np.repeat(wide | (once & (size > 1)), size)
    centre, size = np.repeat(cls[at], size), np.repeat(size, size)
    sig, cls, part, centre, size = sig[keep], cls[keep], part[keep], centre[keep], size[keep]
    for i in range(0, len(sig), 1 << 16):
        p = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(sig[p]), pa.array(cls[p]), pa.array(centre[p], mask=part[p] > 0),
                                          pa.array((size[p] > 2) | (part[p] > 0))], ["sig", "cls", "centre", "many"])


def bloom_filter(classes: DataFrame) -> np.ndarray:
    """A filter of fixed size of the ``cls`` values, combined on the cluster; false hits only cost work."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BLOOM_WORDS, U64)
        for batch in batches:
            word, bit = bloom_places(batch.column(0).to_numpy())
            np.bitwise_or.at(table, word, bit)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], ["at", "bits"])

    got = classes.select("cls").mapInArrow(lean(bits), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BLOOM_WORDS, U64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy().view(U64)
    return table


def bloom_places(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word and three bits in it."""
    h = mix(cls.view(U64) ^ SALT[1])
    bit = (U64(1) << (h & U64(63))) | (U64(1) << ((h >> U64(6)) & U64(63))) | (U64(1) << ((h >> U64(12)) & U64(63)))
    return ((h >> U64(20)) % U64(BLOOM_WORDS)).astype(np.int64), bit


def may_be_among(classes: DataFrame):
    """A function of a column of hashes: may each be one of the ``cls`` values?  Only hashes pass Python, beside rows of any width."""
    shared = classes.sparkSession.sparkContext.broadcast(bloom_filter(classes))        # BLOOM_WORDS numbers

    def scan(cls: pa.Array) -> pa.Array:
        word, bit = bloom_places(cls.to_numpy(zero_copy_only=False))
        return pa.array((shared.value[word] & bit) == bit)

    return F.arrow_udf(scan, "boolean")


def text_table(docs: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """(cls, blob) of the texts whose class passes the filter, each class once per task; ``blob`` is the text, compressed.

    Text takes less room than its shingles, and they are made again where two sets meet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)        # BLOOM_WORDS numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        table, seen, packer = shared.value, set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for piece in slices(batch, "__text"):
                texts = piece.column(0)
                cls = Sets(texts).identity()
                word, bit = bloom_places(cls)
                keep = (table[word] & bit) == bit
                keep[keep] = first_seen(cls[keep], seen)
                kept = texts.filter(pa.array(keep)).to_pylist()
                blobs = [packer.compress((t or "").encode()) for t in kept]
                yield pa.RecordBatch.from_arrays([pa.array(cls[keep]), pa.array(blobs, pa.binary())], ["cls", "blob"])

    return docs.select(F.col(text).alias("__text")).mapInArrow(lean(scan), "cls long, blob binary")


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, x, y) whose texts x and y have sets that link: 100 * common >= 75 * all."""
    import zstandard
    unpacker = zstandard.ZstdDecompressor()
    last, centre = None, None
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        for i in range(0, len(a), 64):
            texts = [unpacker.decompress(y.as_py()).decode() for y in batch.column("y")[i:i + 64]]
            sets = Sets(pa.array(texts, pa.large_string()))
            for j in range(len(texts)):
                if a[i + j] != last:        # rows of one centre mostly follow each other
                    last, centre = a[i + j], Sets(pa.array([unpacker.decompress(batch.column("x")[i + j].as_py()).decode()])).value
                other = sets.value[sets.start[j]:sets.start[j + 1]]
                common = len(np.intersect1d(centre, other, assume_unique=True))
                keep.append(OF * common >= NEED * (len(centre) + len(other) - common))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Those of the (staged) pairs of classes that link.

    One text of every class in question is sent to its class and from there to each centre ``a`` it is compared with.
    """
    need = pairs.selectExpr("b as cls", "a").union(pairs.selectExpr("a as cls", "a").distinct())
    texts = text_table(docs, text, bloom_filter(need)).dropDuplicates(["cls"])
    sent = staged(texts.join(need, "cls"), "sets")
    centres = sent.filter("cls = a").selectExpr("a", "blob as x")
    members = sent.filter("cls <> a").selectExpr("a", "cls as b", "blob as y")
    links = staged(members.join(centres, "a").select("a", "b", "x", "y").mapInArrow(lean(linked), "a long, b long"), "links")
    discard(sent)
    return links


def possible(n: str = "n", parity: str = "parity") -> Column:
    """Whether two sets can link at all, by their sizes and parities (columns ``<n>_a``, ``<n>_b`` and so on).

    Most pairs differ in too many of the first words.  Only these are written out: an expression of all words makes a method
    of more than 8,000 bytes, which the Java compiler leaves to its interpreter.
    """
    na, nb = F.col(f"{n}_a"), F.col(f"{n}_b")
    few = reduce(Column.__add__, [F.bit_count(F.element_at(f"{parity}_a", i + 1).bitwiseXOR(F.element_at(f"{parity}_b", i + 1)))
                                  for i in range(FIRST_WORDS)])
    bits = F.aggregate(F.zip_with(f"{parity}_a", f"{parity}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), Column.__add__)
    return (OF * F.least(na, nb) >= NEED * F.greatest(na, nb)) & (7 * few <= na + nb) & (7 * bits <= na + nb)


def pruned(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs of classes (``a, b``) that can link; ``facts`` has size and parities of every class."""
    side = lambda e: facts.select(F.col("cls").alias(e), F.col("n").alias(f"n_{e}"), F.col("parity").alias(f"parity_{e}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(possible()).select("a", "b")


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``key`` and ``keep`` columns with ``n_shingles``, ``class_id`` and ``component_id``.

    Sets of distinct five-word shingles of the lower-cased words link at a similarity of 75 / 100.
    ``class_id`` is the least key among rows with an equal set, ``component_id`` the least one reachable by
    links.  A text of fewer words has its whole sequence as one shingle; a null or empty text has no
    set, links with nothing and gets its own key.  Rows with a null key take part and get the least key of
    their group (null if there is none).  Repeated rows are copies; clashing names of other columns are
    not read.  ``group`` names the component even where keys are null (null: no set).

    Components need no more links than hold them together.  First each bucket of a signature compares
    its members with one of them; then only members of different components are compared.  No link
    between different components is lost, and a bucket of near copies costs one comparison each.
    """
    with small_batches(docs.sparkSession):
        return _similar_groups(docs, text, key, keep)


def _similar_groups(docs: DataFrame, text: str, key: str, keep: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    cols = (key, *[c for c in keep if c != key])
    every = staged(describe(docs, text, cols), "described")
    rows = every.filter("feature is null").select(*cols, "n_shingles", "cls")
    facts = every.filter("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("parity").alias("parity"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    often = frequent_features(every)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + int(total * 0.75) // ROWS_PER_TASK)
    buckets = staged(signed(docs, text, often).repartition(tasks, "sig", "part")
                     .mapInArrow(lean(met), "sig long, cls long, centre long, many boolean"), "buckets")
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("__copies"))

    wide = buckets.filter("centre is null").select("sig", "cls")
    least = wide.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi")
    star = (buckets.filter("centre < cls").select(F.col("centre").alias("a"), F.col("cls").alias("b"))
            .union(wide.join(least, "sig").filter("cls <> lo").select(F.col("lo").alias("a"), F.col("cls").alias("b"))).distinct())
    met_pairs = staged(star, "met-pairs")
    star = staged(pruned(met_pairs, facts), "star")
    links = verified(star, docs, text)
    labels = connected_components(links)
    # A bucket of two was compared in full; of the others those remain that hold several components.
    several = buckets.filter("many").select("sig", "cls").join(labels, F.col("cls") == F.col("node"), "left").select(
        "sig", "cls", F.coalesce("label", "cls").alias("label")).distinct()
    several = staged(several, "several")
    open_sigs = several.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("sig")
    rest = several.join(open_sigs, "sig", "left_semi").join(facts, "cls")
    side = lambda e: rest.select("sig", F.col("cls").alias(e), F.col("label").alias(f"l{e}"), F.col("n").alias(f"n_{e}"), F.col("parity").alias(f"parity_{e}"))
    cross = side("a").join(side("b"), "sig").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & possible()).select("a", "b").distinct()
    cross = cross.join(met_pairs, ["a", "b"], "left_anti")
    cross = staged(cross, "cross")
    discard(buckets, several, star, met_pairs)
    if not cross.isEmpty():
        more = verified(cross, docs, text)
        if not more.isEmpty():
            labels = connected_components(links.union(more))

    found = classes.join(labels, classes.cls == labels.node, "left").withColumn("group", F.coalesce("label", "cls"))
    least = found.filter("label is not null").groupBy("group").agg(F.min("class_id").alias("__least"))
    # Sets met once only need no row here.
    shared = (found.filter("__copies > 1 or label is not null").join(least, "group", "left")
              .select(F.col("cls").alias("__cls"), "class_id", F.coalesce("__least", "class_id").alias("component_id"),
                      F.col("group").alias("__group")))
    joined = rows.join(shared, rows.cls == shared["__cls"], "left")
    lone = F.col("__cls").isNull()
    return joined.select(*cols, "n_shingles", F.when(lone, F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
                         F.when(lone, F.col(key)).otherwise(F.col("component_id")).alias("component_id"),
                         F.coalesce("__group", "cls").alias("group"))
