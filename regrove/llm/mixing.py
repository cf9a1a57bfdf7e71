"""Mixing sources to target weights by Pareto order sampling.

A source's target share of the mix may exceed what it holds, so documents are repeated.  A document's expected
number of copies is its importance times a factor of its source, at most ``most``; factors are such that the expected words of
a source are its target.  The whole part of that number is certain.  The fraction is an inclusion probability p: documents are
ranked by the odds u / (1 - u) of a hashed uniform number over the inclusion odds p / (1 - p) (Pareto order sampling), and the
first ones are taken until the words still missing are there.  So the size of the sample is fixed while
probabilities are unequal, and the last document gives only the words that were missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import discard, staged
from . import running
from .prefix_trie import word_count

STEPS = 8       # importance is rounded to a power of 2 ** (1 / STEPS)


def uniform(seed: int, *columns: str) -> Column:
    """A number strictly between 0 and 1 that depends on the seed and the columns only."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12)
    return (h.cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` of each source; the targets add up to all sizes.

    Sources are in order of code points, null last, and get the weights in turn.  No target is above ``most`` times the size: the
    excess is shared again by weight among the sources below their limits until none is above.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    flagged = staged(by.withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long")), "sources")
    ranked = running.total_before(running.range_sorted(flagged, ["none", "source"], ["none", "source", "source_size", "one"], "ranked")
                                  .withColumn("all", F.lit(0)), ["all"], "one", "before")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights)).cast("int") + 1)
    table = staged(ranked.select("source", "source_size", cycle.cast("double").alias("weight"), F.lit(False).alias("full")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        limit = F.col("source_size") * most
        rest = table.agg(F.sum(F.when(F.col("full"), limit)), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        left, share = total - (rest[0] or 0), rest[1] or 1.0
        target = F.when(F.col("full"), limit).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(share)))
        over = table.filter(~F.col("full") & (target > limit))
        if over.isEmpty():
            out = staged(table.select("source", "source_size", target.cast("double").alias("target")), "targets")
            discard(table, flagged)
            return out
        nxt = staged(table.withColumn("full", F.col("full") | (target > limit)), "sources")
        discard(table)
        table = nxt


def copy_factors(sizes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``factor`` of each source.

    With s the size and m the importance, the factor f solves sum of s * min(most, f * m) = target.  Only the importance classes of a source
    matter (a few hundred): from the greatest down, f is the first that puts no further class at the limit.
    Null where every document gets ``most`` copies.
    """
    cells = sizes.groupBy("source", "cell").agg(F.sum("size").alias("s")).filter("s > 0")
    held = cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        F.col("t.source").alias("source"), "target", "cell", "s", F.pow(F.lit(2.0), F.col("cell") / STEPS).alias("m"))
    down = Window.partitionBy("source").orderBy(F.desc("cell"))
    up = Window.partitionBy("source").orderBy("cell")
    held = held.withColumn("full", F.coalesce(F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most)
    held = held.withColumn("rest", F.sum(F.col("s") * F.col("m")).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    # If all classes above this one are at the limit:
    held = held.withColumn("f", (F.col("target") - F.col("full")) / F.col("rest")).filter(F.col("f") * F.col("m") < most)
    best = held.groupBy("source").agg(F.max_by("f", "cell").alias("f"))
    return targets.alias("t").join(best.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left").select(
        F.col("t.source").alias("source"), "source_size", "target", F.col("b.f").alias("factor"))


def mix_sources(docs: DataFrame, size: Column | None = None, importance: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
                seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` (both of its source), ``copies`` (certain whole ones), ``chance`` of one more,
    and ``taken``, the words that the mix takes of it: ``copies * size``, and ``size`` or, for the last document of a
    source's sample, the words still missing.

    ``size`` is the number of words unless given (not negative, no nulls); ``importance`` (positive; 1 if null, not given or not positive) sets the relative number of copies
    inside a source.  A null source is a source of its own; null and empty texts have size 0 and are taken with 0 words.
    Equal rows draw alike and lie side by side in the ranking; ties go by key.  An empty table gives no rows.  Only the named columns
    are read, so others cannot clash.  The same rows and seed give the same mix under any partitioning.

    A source may hold most documents: sums are combined before shuffles and the ranking is range-sorted.
    """
    size = word_count(text) if size is None else size
    weight = F.lit(1.0) if importance is None else importance
    cell = F.when(weight > 0, F.round(F.log2(weight) * STEPS)).otherwise(0)
    plain = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{source}`").cast("string").alias("source"), size.cast("long").alias("size"),
                        F.coalesce(cell, F.lit(0)).cast("int").alias("cell"), F.xxhash64(F.col(f"`{text}`")).alias("__hash"))
    sizes = staged(plain, "sizes")
    targets = source_targets(sizes, weights, float(most))
    factors = staged(copy_factors(sizes, targets, float(most)), "factors")
    expected = F.least(F.lit(float(most)), F.coalesce(F.col("f.factor") * F.pow(F.lit(2.0), F.col("d.cell") / STEPS), F.lit(float(most))))
    drawn = sizes.alias("d").join(factors.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source"))).select(
        "d.__key", "d.source", "d.size", "d.__hash", "f.source_size", "f.target", expected.alias("expected"))
    drawn = drawn.withColumn("copies", F.floor("expected").cast("long")).withColumn("chance", F.col("expected") - F.floor("expected"))
    u = uniform(seed, "__key", "__hash")
    rank = (u / (1.0 - u)) * ((1.0 - F.col("chance")) / F.col("chance"))
    drawn = staged(drawn.drop("expected").withColumn("rank", F.when(F.col("chance") > 0, rank)), "draws")
    missing = drawn.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing"))
    ranked = running.range_sorted(drawn.filter("rank is not null"), ["source", "rank", "__key", "__hash"],
                                  [c for c in drawn.columns if c not in ("rank", "__hash")], "ranking")
    ranked = running.total_before(ranked, ["source"], "size", "before")
    room = F.greatest(F.lit(0), F.least(F.col("r.size"), F.round("m.missing").cast("long") - F.col("r.before")))
    names = ["__key", "source", "size", "source_size", "target", "copies", "chance"]
    sampled = ranked.alias("r").join(missing.alias("m"), F.col("r.source").eqNullSafe(F.col("m.source"))).select(
        *[F.col(f"r.{c}") for c in names], (F.col("r.copies") * F.col("r.size") + room).alias("taken"))
    whole = drawn.filter("rank is null").select(*names, (F.col("copies") * F.col("size")).alias("taken"))
    out = sampled.unionByName(whole)
    return out.select(F.col("__key").alias(key), "source", "size", "source_size", "target", "copies", "chance", "taken")
