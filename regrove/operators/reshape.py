"""Column selection by name, wide-to-long and long-to-wide reshaping."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def matching(df: DataFrame, prefixes: Sequence[str] = (), contains: Sequence[str] = (),
             exclude_prefixes: Sequence[str] = (), exclude_contains: Sequence[str] = ()) -> list[str]:
    """Column names chosen by prefix or substring, ignoring case, in table order."""
    low = lambda xs: tuple(x.lower() for x in xs)
    pre, con, xpre, xcon = low(prefixes), low(contains), low(exclude_prefixes), low(exclude_contains)
    picked = []
    for name in df.columns:
        n = name.lower()
        wanted = (pre and n.startswith(pre)) or any(c in n for c in con)
        dropped = (xpre and n.startswith(xpre)) or any(c in n for c in xcon)
        if wanted and not dropped:
            picked.append(name)
    return picked


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included."""
    i, j = df.columns.index(first), df.columns.index(last)
    return df.columns[min(i, j):max(i, j) + 1]


def across(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column],
           template: str = "{col}") -> DataFrame:
    """Apply one expression to many columns, naming results by template."""
    return df.withColumns({template.format(col=c): fn(F.col(f"`{c}`")) for c in cols})


def summarise_across(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                     fns: dict[str, Callable[[Column], Column]],
                     template: str = "{col}_{fn}") -> DataFrame:
    """Many columns times many aggregates in one pass."""
    aggs = [fn(F.col(f"`{c}`")).alias(template.format(col=c, fn=name))
            for c in cols for name, fn in fns.items()]
    return df.groupBy(*keys).agg(*aggs)


def numeric_means(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of every numeric column by key; a missing value makes the mean missing."""
    from ..functions.missing import strict_mean
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    cols = [c for c, t in df.dtypes if c not in keys and (t in numeric or t.startswith("decimal"))]
    return df.groupBy(*keys).agg(*[strict_mean(F.col(f"`{c}`")).alias(c) for c in cols])


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], names_to: str = "name",
         values_to: str = "value", value_type: str | None = None) -> DataFrame:
    """Columns to rows; ``value_type`` unifies mixed column types first."""
    if value_type:
        df = df.select(*[F.col(f"`{c}`") for c in ids],
                       *[F.col(f"`{c}`").cast(value_type).alias(c) for c in cols])
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in cols],
                      names_to, values_to)


def melt_parts(df: DataFrame, ids: Sequence[str], cols: Sequence[str], parts: Sequence[str | None],
               sep: str = "_", values_to: str = "value", value_type: str | None = None) -> DataFrame:
    """Melt columns whose names encode dimensions, one output column per name part.

    A part named ``None`` is dropped; names with fewer pieces leave the rest null.
    """
    long = melt(df, ids, cols, "__name", values_to, value_type)
    pieces = F.split(F.col("__name"), "\\Q" + sep + "\\E")
    return long.select(*[F.col(f"`{c}`") for c in ids],
                       *[F.get(pieces, F.lit(i)).alias(p) for i, p in enumerate(parts) if p],
                       values_to)


def split_column(df: DataFrame, col: str, into: Sequence[str | None], sep: str = "_") -> DataFrame:
    pieces = F.split(F.col(f"`{col}`"), "\\Q" + sep + "\\E")
    return df.withColumns({p: F.get(pieces, F.lit(i)) for i, p in enumerate(into) if p}).drop(col)


def unite_columns(df: DataFrame, into: str, cols: Sequence[str], sep: str = "_") -> DataFrame:
    from ..functions.missing import paste
    return df.withColumn(into, paste(*cols, sep=sep)).drop(*[c for c in cols if c != into])


def cast_wide(df: DataFrame, ids: Sequence[str], key: str, levels: Sequence, values: Sequence[str],
              fill=None, template: str = "{value}_{key}",
              agg: Callable[[Column], Column] = F.first) -> DataFrame:
    """Rows to columns for a declared list of key levels.

    One conditional aggregate per (value, level): a single partial-aggregated
    shuffle on ``ids``, no extra job to discover levels and full control of names.
    With one value column the default name is the level itself.
    """
    if len(values) == 1 and template == "{value}_{key}":
        template = "{key}"
    out = []
    for v in values:
        for lv in levels:
            cell = F.when(F.col(f"`{key}`") == F.lit(lv), F.col(f"`{v}`"))
            pick = F.first(cell, ignorenulls=True) if agg is F.first else agg(cell)
            if fill is not None:
                pick = F.coalesce(pick, F.lit(fill))
            out.append(pick.alias(template.format(value=v, key=lv)))
    return df.groupBy(*ids).agg(*out)


def presence(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Abundance columns to 0/1."""
    return across(df, cols, lambda c: F.when(c.isNull(), F.lit(None).cast("int"))
                  .otherwise((c > 0).cast("int")))


def drop_empty_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows whose columns sum to more than zero."""
    from ..functions.missing import row_sum
    return df.filter(row_sum(*cols) > 0)


def melt_records(df: DataFrame, ids: Sequence[str], cols: Sequence[str], parts: Sequence[str | None],
                 attribute: str, sep: str = "_", types: dict[str, str] | None = None) -> DataFrame:
    """Wide records to rows, keeping one name part as output columns.

    Equal to a melt followed by a cast on ``attribute``, but each input row is
    exploded in place: no shuffle and no row multiplication per attribute.
    """
    types = types or {}
    where = list(parts).index(attribute)
    dims = [p for p in parts if p and p != attribute]
    records: dict[tuple, dict[str, str]] = {}
    for c in cols:
        pieces = c.split(sep) + [None] * len(parts)
        key = tuple(pieces[i] for i, p in enumerate(parts) if p and p != attribute)
        records.setdefault(key, {})[pieces[where]] = c
    attrs = list(dict.fromkeys(a for r in records.values() for a in r))
    structs = []
    for key, have in records.items():
        fields = [F.lit(v).cast("string").alias(d) for d, v in zip(dims, key)]
        for a in attrs:
            cell = F.col(f"`{have[a]}`") if a in have else F.lit(None)
            fields.append(cell.cast(types.get(a, "string")).alias(a))
        structs.append(F.struct(*fields))
    return (df.select(*[F.col(f"`{c}`") for c in ids], F.explode(F.array(*structs)).alias("__rec"))
            .select(*ids, "__rec.*"))
