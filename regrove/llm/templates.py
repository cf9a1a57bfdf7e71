"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units of a text become typed placeholders, so a question that was only given
new values keeps its template.  Windows of template tokens are joined by hash with those of the
benchmark; windows of one alignment must fill the item's slots consistently: the same value of
the item always stands for the same value in the document.  Beside these, windows of the raw lower-cased
tokens are joined, whatever they hold, so that verbatim copies of short items, of items dense in
placeholders, and in other letter case are found as well.  Each text is canonicalised once and read in one pass.

Items of one template whose slots repeat values at the same places are one class, under the least id: documents are
matched with classes, and ``item_classes`` tells the members.  So a template with many items and many
documents gives one row per document, not one per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

# Units that may follow a number.
UNITS = ("km|m|cm|mm|mi|mile|miles|ft|feet|foot|inch|inches|yd|yards|kg|g|mg|lb|lbs|oz|ton|tons|l|ml|litre|litres|liter|liters|"
         "gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years|"
         "percent|dollar|dollars|usd|euro|euros|eur|cent|cents|pound|pounds|kmh|mph|degrees|celsius|fahrenheit|watt|watts|volts")
WIDTH = 8               # template tokens of a window
LITERAL = 5             # of them at least must not be placeholders
BROADCAST_WINDOWS = 1_000_000


def raw_tokens(text: Column, names: bool = True) -> Column:
    """Tokens of a text in one string, apart by single spaces; names carry the mark 0x01."""
    t = F.coalesce(text, F.lit(""))
    if names:       # what stands before is looked at only where a capital was met, and is not consumed, so neighbours are found in one turn
        t = F.regexp_replace(t, r"(\p{Lu}(?<=[\p{L}\p{N},;:] \p{Lu})\p{Ll}+)", "\u0001$1")
    t = F.regexp_replace(t, r"[.,:/](?<=[0-9][.,:/])(?=[0-9])", "_")
    return F.trim(F.lower(F.regexp_replace(t, "[^\\p{L}\\p{N}_\u0001]+", " ")))


def unmarked(raw: Column) -> Column:
    return F.translate(raw, "\u0001", "")


def template(raw: Column) -> Column:
    t = F.regexp_replace(raw, "\u0001[\\p{L}\\p{N}_]+", "#name")
    t = F.regexp_replace(t, r"(^| )[0-9][\p{L}\p{N}_]*", "$1#num")
    return F.regexp_replace(t, rf"(#num )({UNITS})( |$)", "$1#unit$3")


def listed(tokens: Column) -> Column:
    return F.array_remove(F.split(tokens, " "), "")


def token_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def shape_code(kind: str, width: int) -> int:
    """Number of a kind of window (``t``: template, ``r``: raw tokens, ``l``: whole line) and its width; part of its hash."""
    return 16 * "trl".index(kind) + width


def window_at(hashes: Column, pos: Column, kind: str, width: int) -> Column:
    """Hash of the window that starts at ``pos``; null where it would pass the end.  A window is met by this number alone."""
    each = [F.get(hashes, pos + k) for k in range(width)]
    return F.when(pos + width <= F.size(hashes), F.xxhash64(F.lit(shape_code(kind, width)), *each))


def window_of(tokens: Column, code: Column) -> Column:
    """The same hash of an array that is one window."""
    return F.xxhash64(code, token_hashes(tokens))


def classed(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, r, key) of every item with a token; ``key`` is its template and, for each token, the place where it comes first."""
    one = benchmark.select(F.col(item).alias("item"), raw_tokens(F.col(text)).alias("r")).filter("r <> ''")
    raw = listed(F.col("r"))
    first = F.transform(raw, lambda x: F.array_position(raw, x))
    return one.withColumn("key", F.sha2(F.concat_ws("|", template(F.col("r")), F.array_join(first, " ")), 256))


def _representatives(items: DataFrame) -> DataFrame:
    """(key, item, r) of the item with the least id of each class."""
    best = items.groupBy("key").agg(F.min(F.struct(F.col("item").isNull().alias("none"), "item", "r")).alias("m"))
    return best.select("key", "m.item", "m.r")


def item_classes(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` and the ``representative`` of its class; items without tokens have none."""
    items = classed(benchmark, item, text)
    return items.join(_representatives(items).select("key", F.col("item").alias("representative")), "key").select(
        F.col("item").alias(item), "representative")


def item_windows(items: DataFrame) -> DataFrame:
    """(item, width, n_windows, place, hash, item_raw) of every window of a representative with enough literal tokens.

    A shorter item is one window of its own width.
    """
    one = (_representatives(items).withColumn("raw", listed(F.col("r"))).withColumn("tokens", listed(template(F.col("r"))))
           .withColumn("width", F.least(F.size("tokens"), F.lit(WIDTH))))
    places = one.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("width"))))
    cut = places.select("item", "width", "place", F.slice("tokens", F.col("place") + 1, F.col("width")).alias("t"),
                        F.slice("raw", F.col("place") + 1, F.col("width")).alias("item_raw"))
    literal = F.size(F.filter("t", lambda x: ~x.startswith("#")))
    kept = (cut.filter(literal >= F.least(F.lit(LITERAL), F.col("width")))
            .filter(F.col("width") >= LITERAL)
            .withColumn("hash", window_of(F.col("t"), F.lit(shape_code("t", 0)) + F.col("width"))))
    counts = kept.groupBy("item").agg(F.count(F.lit(1)).alias("n_windows"))
    return kept.join(counts, "item").drop("t")


def raw_item_windows(items: DataFrame) -> DataFrame:
    """(item, width, n_raw, place, hash) of every window of raw tokens of any member of a class; a shorter item is one window."""
    best = _representatives(items).select("key", F.col("item").alias("best"))
    one = (items.join(best, "key").select(F.col("best").alias("item"), listed(unmarked(F.col("r"))).alias("raw"))
           .withColumn("width", F.least(F.size("raw"), F.lit(WIDTH))).filter("width > 0")
           .withColumn("n_raw", (F.size("raw") - F.col("width") + 1).cast("long")))
    places = one.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("raw") - F.col("width"))))
    cut = F.slice("raw", F.col("place") + 1, F.col("width"))
    code = F.when(F.col("width") < LITERAL, shape_code("l", 0)).otherwise(shape_code("r", 0)) + F.col("width")
    return places.select("item", "width", "n_raw", "place", window_of(cut, code).alias("hash")).distinct()


def short_lines(text: Column, width: int) -> Column:
    """Hashes of the lines of just ``width`` tokens."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: listed(unmarked(raw_tokens(x))))
    few = F.filter(lines, lambda x: F.size(x) == width)
    return F.transform(few, lambda x: window_of(x, F.lit(shape_code("l", width))))


def document_windows(base: DataFrame, shapes: list[tuple[str, int]], carried: list[str]) -> DataFrame:
    """(``carried``, pos, hash) of the windows of the given shapes in ``__raw``, by position.

    Tokens are hashed once per text; positions are rows, so windows are hashed in generated code and no array of them is held.
    """
    lines = [short_lines(F.col("__lines"), width) for kind, width in shapes if kind == "l"]
    hashed = base.select(*carried, token_hashes(listed(template(F.col("__raw")))).alias("__t"), token_hashes(listed(unmarked(F.col("__raw")))).alias("__r"),
                         *([F.concat(*lines).alias("__l")] if lines else []))
    longest = F.greatest(F.size("__t"), F.size("__r"), *([F.size("__l")] if lines else []))
    placed = hashed.filter(longest > 0).select("*", F.explode(F.sequence(F.lit(0), longest - 1)).alias("pos"))
    found = [window_at(F.col(f"__{kind}"), F.col("pos"), kind, width) for kind, width in shapes if kind != "l"]
    found += [F.get(F.col("__l"), F.col("pos"))] if lines else []
    one = placed.select(*carried, "pos", *[h.alias(f"h{i}") for i, h in enumerate(found)])
    return one.select(*carried, "pos", F.stack(F.lit(len(found)), *[F.col(f"h{i}") for i in range(len(found))]).alias("hash"))


def template_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                     item_text: str = "text", share: float = 0.5) -> DataFrame:
    """Documents that hold a benchmark item, perhaps with other numbers, names or units.

    One row per document (its ``key`` and ``__text_hash``) and item class (``item``: its least member; see ``item_classes``):
    ``n_windows`` of the item, distinct ``matched`` ones in consistent alignments, ``n_slots`` filled and ``n_changed`` slots whose
    value differs from the least member's.  A pair is a match when ``share`` of the windows are matched.  Windows of fewer than five literal
    tokens have no template.  A pair that is no match by templates is one when ``share`` of all windows,
    low in literals or not, are matched by template or by equal raw tokens of a member in any letter case; then
    ``n_windows`` and ``matched`` count all of them.  An item of five to seven tokens is one raw window; one of fewer is too little evidence inside
    a text and matches only a whole line with the same tokens.
    An item without tokens and a null or empty text match nothing; null keys take part.  Repeated rows give one row; rows of equal key and different text give one row each.  Other columns
    are not read.

    The windows of the benchmark are counted first and broadcast only below ``BROADCAST_WINDOWS``;
    beyond it both sides are shuffled by hash and the few documents with a hit are read again.
    """
    items = staged(classed(benchmark, item, item_text), "items")       # every branch reads the few canonical items, not the benchmark
    by_template, by_raw = item_windows(items), raw_item_windows(items)
    none = F.lit(None)
    side = staged(by_template.select("item", F.lit("t").alias("kind"), F.col("width"), "place", "hash", "n_windows", none.cast("long").alias("n_raw"), "item_raw").union(
        by_raw.select("item", F.when(F.col("width") < LITERAL, "l").otherwise("r"), "width", "place", "hash", none.cast("long"), "n_raw",
                      none.cast("array<string>"))), "item-windows")
    shapes = {(r["kind"], r["width"]): r["n"] for r in side.groupBy("kind", "width").agg(F.count(F.lit(1)).alias("n")).collect()}   # 16 rows at most
    small = sum(shapes.values()) <= BROADCAST_WINDOWS
    base = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), raw_tokens(F.col(text)).alias("__raw"),
                       *([F.col(text).alias("__lines")] if any(kind == "l" for kind, _ in shapes) else []))
    spread = document_windows(base, sorted(shapes) or [("t", WIDTH)], ["__key", "__hash", *(["__raw"] if small else [])])
    found = spread.join(F.broadcast(side) if small else side, "hash")
    if not small:
        found = staged(found, "template-hits")
        wanted = found.select("__key", "__hash").distinct()
        again = base.alias("d").join(wanted.alias("w"), F.col("d.__key").eqNullSafe(F.col("w.__key")) & (
            F.col("d.__hash") == F.col("w.__hash")), "left_semi").select("__key", "__hash", "__raw").distinct()
        again = again.select(F.col("__key").alias("k2"), F.col("__hash").alias("h2"), "__raw")
        found = found.join(again, F.col("__key").eqNullSafe(F.col("k2")) & (F.col("__hash") == F.col("h2"))).drop("k2", "h2")
    doc_raw = F.when(F.col("kind") == "t", F.slice(F.split("__raw", " "), F.col("pos") + 1, F.col("width")))
    met = staged(found.select("__key", "__hash", "kind", "item", "n_windows", "n_raw", "place", (F.col("pos") - F.col("place")).alias("shift"),
                              doc_raw.alias("doc_raw"), "item_raw"), "template-windows")
    hits = met.filter("kind = 't'")
    where = ["__key", "__hash", "item", "shift"]
    # Literal tokens are equal on both sides, so every token may count as a slot.
    slots = (hits.select(*where, F.explode(F.arrays_zip("item_raw", "doc_raw")).alias("z"))
             .select(*where, F.col("z.item_raw").alias("a"), F.col("z.doc_raw").alias("b")))
    filled = slots.filter((F.col("a") != F.col("b")) | F.col("a").rlike("^[\u00010-9]")).distinct()
    judged = filled.groupBy(*where).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("a").alias("values"),
                                        F.sum((F.col("a") != F.col("b")).cast("long")).alias("changed"))
    match = lambda a, b: F.col(f"{a}.__key").eqNullSafe(F.col(f"{b}.__key")) & (F.col(f"{a}.__hash") == F.col(f"{b}.__hash")) & (
        F.col(f"{a}.item") == F.col(f"{b}.item")) & (F.col(f"{a}.shift") == F.col(f"{b}.shift"))
    places = hits.select(*where, "n_windows", "place").distinct().alias("h")
    joined = places.join(judged.alias("j"), match("h", "j"), "left").select(
        *[F.col(f"h.{c}") for c in where], "n_windows", "place", F.coalesce("pairs", F.lit(0)).alias("pairs"),
        F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("changed", F.lit(0)).alias("changed"))
    fitting = joined.filter("pairs = values")
    # A document may hold an item at several shifts; its slots are those of the richest one.
    by_template = fitting.select("__key", "__hash", "item", "place", "n_windows", "pairs", "changed", F.lit(None).cast("long").alias("n_raw"))
    by_raw = met.filter("kind <> 't'").select(
        "__key", "__hash", "item", "place", *[F.lit(None).cast("long").alias(c) for c in ("n_windows", "pairs", "changed")], "n_raw")
    by_place = by_template.union(by_raw).groupBy("__key", "__hash", "item", "place").agg(
        F.max("n_windows").alias("n_windows"), F.max("pairs").alias("pairs"), F.min("changed").alias("changed"), F.max("n_raw").alias("n_raw"))
    by_item = by_place.groupBy("__key", "__hash", "item").agg(
        F.max("n_windows").alias("n_windows"), F.count("n_windows").alias("matched"), F.max("n_raw").alias("n_raw"),
        F.count(F.lit(1)).alias("held"), F.max("pairs").alias("n_slots"), F.min("changed").alias("n_changed"))
    templated = F.coalesce(F.col("matched") >= share * F.col("n_windows"), F.lit(False))
    return by_item.filter(templated | (F.col("held") >= share * F.col("n_raw"))).select(
        F.col("__key").alias(key), F.col("__hash").alias("__text_hash"), F.col("item").alias(item),
        F.when(templated, F.col("n_windows")).otherwise(F.col("n_raw")).alias("n_windows"),
        F.when(templated, F.col("matched")).otherwise(F.col("held")).alias("matched"),
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"))


def without_matches(docs: DataFrame, matches: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that match no item; equal rows share their verdict."""
    found = matches.select(F.col(key).alias("__key"), "__text_hash").distinct()
    return docs.join(found, docs[key].eqNullSafe(found["__key"]) & (F.xxhash64(docs[text]) == found["__text_hash"]), "left_anti")
