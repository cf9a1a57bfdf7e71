"""Prefix trie of conversations, with subtree totals by centroid decomposition.

Every distinct sequence of first turns is a node.  A node is known by two 64-bit sums (exclusive or)
of position-bound turn hashes, so all prefixes of a conversation come from one running aggregate; a node's rows are
combined before they are shuffled, however many conversations share it.

Subtree totals go bottom-up through a tree that may be as deep as its longest conversation and may have a
node with a third of all others below it.  Level by level that takes as many rounds as there are turns.  Instead the
parent-edge forest is decomposed: in each round every large component is split at its centroid, the deepest node with more
than half of the component's weight below it.  The total of all that lies below the centroid is added to the nodes from the centroid
up to the component's top; then the part above, and every subtree right below the centroid, is a component of its own.
The path needs no walk: its nodes are just those with more than half of the weight.  Weights halve every
round, so the rounds grow with the logarithm of the table.  Components of at most ``LOCAL`` nodes are
decomposed the same way inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import discard, staged
from . import running

LOCAL = 1024        # nodes of a component that one task decomposes by itself
BLOCK = 512         # turns of a conversation whose prefixes are built together
WORD_GAP = r"[\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD_GAP, " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``c``, place ``p`` from 1, turn hashes ``x`` and ``y`` and ``words`` of every turn.

    Turns are ordered by ``turn`` (null first), ties by role, then text; a null role or text is empty.  Turns without
    a conversation id belong to none and are left out.  Repeated rows are repeated turns.
    """
    clean = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("role", "text")])
    rows = running.range_sorted(clean, ["c", "turn", "role", "text"], [
        "c", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(7), "text", "role").alias("y"), word_count().alias("words"),
        F.lit(1).cast("long").alias("one")], "turns")
    return running.total_before(rows, ["c"], "one", "p").select("c", (F.col("p") + 1).alias("p"), "x", "y", "words")


def with_shared_openings(turns: DataFrame, of: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (``c, d, x, y, words``) and conversations (``c, turns``).

    Conversation c gets the first h turns of conversation c - c % ``of`` (all if it has fewer, none if there
    is no such one), then its own turns after the first h; h is crc32 of the decimal id, modulo ``most``.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    known = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    convs = known.select("c", "n", h("c").alias("h"), (F.col("c") - F.col("c") % of).alias("base"))
    first = known.filter(F.col("c") % of == 0).select(F.col("c").alias("base"), F.least("n", F.lit(most - 1)).alias("given"))
    convs = convs.join(first, "base", "left").withColumn("given", F.least(F.coalesce("given", F.lit(0)), "h"))
    convs = staged(convs.withColumn("turns", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    opening = turns.filter((F.col("p") < most) & (F.col("c") % of == 0)).withColumnRenamed("c", "base")
    shared = opening.join(convs.select("c", "base", "given"), "base").filter("p <= given").select(
        "c", F.col("p").alias("d"), "x", "y", "words")
    own = turns.filter(F.col("p") > h("c")).join(convs.select("c", "h", "given"), "c").select(
        "c", (F.col("p") - F.col("h") + F.col("given")).alias("d"), "x", "y", "words")
    return shared.union(own), convs.select("c", "turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """Node (``a, b``) and parent node (``pa, pb``) of every turn (``c, d, x, y, words``), the root being (0, 0).

    A conversation's turns are cut into blocks, so a very long one is spread over tasks.
    """
    placed = turns.select("c", "d", "words", F.floor((F.col("d") - 1) / BLOCK).cast("long").alias("block"),
                          F.xxhash64("x", "y", "d").alias("e"), F.xxhash64(F.lit(3), "d", "y", "x").alias("f"))
    inside = Window.partitionBy("c", "block").orderBy("d")
    placed = placed.withColumns({"a": F.bit_xor("e").over(inside), "b": F.bit_xor("f").over(inside)})
    whole = placed.groupBy("c", "block").agg(F.bit_xor("e").alias("e"), F.bit_xor("f").alias("f"))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)     # one row per block
    shift = whole.select("c", "block", F.bit_xor("e").over(before).alias("sa"), F.bit_xor("f").over(before).alias("sb"))
    zero = F.lit(0).cast("long")
    moved = placed.join(shift.filter("block > 0"), ["c", "block"], "left")
    a, b = (F.col(k).bitwiseXOR(F.coalesce(s, zero)) for k, s in (("a", "sa"), ("b", "sb")))
    return moved.select("c", "d", "words", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("e")).alias("pa"), b.bitwiseXOR(F.col("f")).alias("pb"))


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: key ``a, b``, parent's key, ``depth``, smallest member ``conv_id``, parent's ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``words`` of the last turn and ``weight``, the (conversation, turn) rows in its subtree."""
    zero = F.lit(0).cast("long")
    met = rows.join(convs, "c").groupBy("a", "b").agg(
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("d").cast("long").alias("depth"), F.min("c").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.sum(F.col("turns") - F.col("d") + 1).cast("long").alias("weight"))
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("turns") + 1).cast("long").alias("weight")).filter(
        "n_convs > 0").select(zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("depth"), "conv_id", "n_convs",
                              zero.alias("words"), "weight")
    nodes = staged(met.unionByName(root), "nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero)).join(above, ["pa", "pb"], "left")
    out = staged(full, "trie")
    discard(nodes)
    return out


def subtree_totals(nodes: DataFrame, rows: DataFrame, values: Sequence[str], local: int = LOCAL) -> DataFrame:
    """``a, b`` and, for each of ``values`` (long), ``sum_<value>`` over the node's subtree, itself included.

    ``nodes`` have key, parent key, ``depth``, ``conv_id``, ``weight`` (any positive number of which every subtree has the total); ``rows``
    give the node of a conversation at a depth, which tells the part of a component that a node falls into.
    """
    zero = F.lit(0).cast("long")
    way = rows.select(F.col("c").alias("conv_id"), F.col("d").cast("long").alias("at"), F.col("a").alias("na"), F.col("b").alias("nb"),
                      F.col("pa").alias("ua"), F.col("pb").alias("ub"))
    state = nodes.select("a", "b", "pa", "pb", "depth", "conv_id", "weight", *values, *[zero.alias(f"sum_{v}") for v in values],
                         zero.alias("ca"), zero.alias("cb"))
    same = state.columns
    done, ready, spent = [], [], []
    while True:
        sizes = staged(state.groupBy("ca", "cb").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("top")).filter(
            F.col("n") > local).drop("n"), "components")
        if sizes.isEmpty():
            ready.append(state)
            break
        ready.append(state.join(sizes, ["ca", "cb"], "left_anti").select(*same))
        large = state.join(sizes, ["ca", "cb"])
        heavy = F.col("weight") * 2 > F.col("top")
        centre = staged(large.filter(heavy).groupBy("ca", "cb", "top").agg(F.max_by(F.struct("a", "b", "depth", "weight"), "depth").alias("m")), "centroids")
        aimed = state.join(centre, ["ca", "cb"]).withColumn("at", F.col("m.depth") + 1)
        deeper = aimed.filter("depth >= at").join(way, ["conv_id", "at"])
        under = (F.col("ua") == F.col("m.a")) & (F.col("ub") == F.col("m.b"))
        marked = deeper.withColumn("under", under).drop("ua", "ub").unionByName(
            aimed.filter("depth < at").withColumns({"na": zero, "nb": zero, "under": F.lit(False)}))
        central = (F.col("a") == F.col("m.a")) & (F.col("b") == F.col("m.b"))
        marked = staged(marked.withColumn("central", central).withColumn("path", heavy).drop("at"), "marked")
        totals = marked.filter("under or central").groupBy("ca", "cb").agg(*[F.sum(v).alias(f"part_{v}") for v in values])
        grown = {f"sum_{v}": F.col(f"sum_{v}") + F.when(F.col("path"), F.col(f"part_{v}")).otherwise(zero) for v in values}
        left = F.when(F.col("path"), F.col("weight") - F.col("m.weight")).otherwise(F.col("weight"))
        after = staged(marked.join(totals, ["ca", "cb"]).withColumns(grown).withColumns({
            "weight": left, "ca": F.when(F.col("under"), F.col("na")).otherwise(F.col("ca")),
            "cb": F.when(F.col("under"), F.col("nb")).otherwise(F.col("cb"))}).select(*same, "central"), "split")
        discard(marked, centre)
        done.append(after.filter("central"))
        state = after.filter("not central").select(*same)
        spent += [sizes]
    sums = [f"sum_{v}" for v in values]
    small = ready[0]
    for r in ready[1:]:
        small = small.unionByName(r)
    out = _decompose(small, list(values))
    for d in done:
        out = out.unionByName(d.select("a", "b", *sums))
    return out


def _decompose(small: DataFrame, values: list[str]) -> DataFrame:
    """Subtree totals of components of few nodes, each inside one task."""
    sums = [f"sum_{v}" for v in values]
    rows = small.select("ca", "cb", "depth", "a", "b", "pa", "pb", *values, *sums).repartition("ca", "cb").sortWithinPartitions("ca", "cb", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if kept and (kept[0]["ca"], kept[0]["cb"]) != (row["ca"], row["cb"]):
                    out += component_totals(kept, values)
                    kept = []
                kept.append(row)
            yield _table(out, sums)
        if kept:
            yield _table(component_totals(kept, values), sums)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("a", "b", *sums)))


def _table(rows: list[tuple], sums: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * (2 + len(sums))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", *sums])


def component_totals(rows: list[dict], values: list[str]) -> list[tuple]:
    """Node key and subtree totals inside one component, by centroid decomposition; ``rows`` are in order of depth."""
    place = {(r["a"], r["b"]): i for i, r in enumerate(rows)}
    parent = [place.get((r["pa"], r["pb"]), -1) for r in rows]
    children: list[list[int]] = [[] for _ in rows]
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    preorder, todo = [], [i for i, p in enumerate(parent) if p < 0]
    while todo:
        i = todo.pop()
        preorder.append(i)
        todo += children[i]
    own = [[r[v] for v in values] for r in rows]
    sums = [[r[f"sum_{v}"] for v in values] for r in rows]
    size, parts = [0] * len(rows), [preorder]
    while parts:
        nodes = parts.pop()
        for i in nodes:
            size[i] = 1
        for i in reversed(nodes[1:]):
            size[parent[i]] += size[i]
        path = [i for i in nodes if 2 * size[i] > size[nodes[0]]]
        centre = path[-1]
        at = nodes.index(centre)
        below = nodes[at:at + size[centre]]
        for k in range(len(values)):
            total = sum(own[i][k] for i in below)
            for i in path:
                sums[i][k] += total
        if at:
            parts.append(nodes[:at] + nodes[at + size[centre]:])
        j = 1
        while j < len(below):
            parts.append(below[j:j + size[below[j]]])
            j += size[below[j]]
    return [(r["a"], r["b"], *s) for r, s in zip(rows, sums)]


def ends_digest(ends: DataFrame) -> DataFrame:
    """``a, b`` and the SHA-256 (``ends_sha256``) of the decimal ids ``c`` of each node, ascending, comma-joined.

    Ids are range-sorted and joined in runs of at most 1,024 inside the sorted partitions; the runs of a node are then fed to one
    digest in order.  SHA-256 is sequential by nature, so a node's runs pass through one task, as a stream of a thousandth of its rows.
    """
    rows = running.range_sorted(ends, ["a", "b", "c"], ["a", "b", "c"], "ends")
    place = Window.partitionBy("__part", "a", "b").orderBy("__at")
    runs = rows.withColumn("run", F.floor((F.row_number().over(place) - 1) / 1024)).groupBy("a", "b", "__part", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    runs = runs.repartition("a", "b").sortWithinPartitions("a", "b", "__part", "run")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _digests(out)
        if key:
            yield _digests([(*key, state.hexdigest())])

    return runs.mapInArrow(digest, "a long, b long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.string())], ["a", "b", "ends_sha256"])


def conversation_trie(conversations: DataFrame, openings: bool = False, local: int = LOCAL) -> DataFrame:
    """All nodes of the trie of ``conversations`` (``conv_id, turn, role, text``), a row each.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in the
    subtree), ``saved_tokens`` (words that sharing saves in the subtree) and ``ends_sha256`` (digest of the ids that end here).
    With ``openings`` conversations are rebuilt first (``with_shared_openings``).

    Null roles and texts are empty ones, a null turn comes first, tied turns go by role and text, repeated rows are repeated turns; rows without a
    conversation id are left out.  An empty table has no node, not even a root.  Other columns are not read.
    """
    turns = staged(ordered_turns(conversations), "placed")
    if openings:
        rebuilt, convs = with_shared_openings(turns)
    else:
        rebuilt = turns.withColumnRenamed("p", "d")
        convs = staged(turns.groupBy("c").agg(F.count(F.lit(1)).alias("turns")), "conversations")
    rows = staged(prefixes(rebuilt), "prefixes")
    nodes = trie(rows, convs)
    valued = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    totals = subtree_totals(valued, rows, ["n_leaves", "saved_tokens"], local)
    last = rows.join(convs, "c").filter("d = turns").select("a", "b", "c")
    zero = F.lit(0).cast("long")
    ends = ends_digest(staged(last.union(convs.filter("turns = 0").select(zero, zero, "c")), "last"))
    empty = F.lit("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")      # of no bytes
    return nodes.join(totals, ["a", "b"]).join(ends, ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_n_leaves").alias("n_leaves"),
        F.col("sum_saved_tokens").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
