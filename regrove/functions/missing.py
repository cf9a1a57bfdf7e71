"""Missing-value rules for field data, as Column expressions.

Survey tables follow "missing poisons" arithmetic: a mean over a group with one
unrecorded value is itself unrecorded unless the caller asks to skip missing
values.  Spark's aggregates skip nulls, so the strict forms are spelled out here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def strict(agg: Column, x) -> Column:
    """``agg`` when every row of the group has ``x``; otherwise null."""
    return F.when(F.count(_c(x)) == F.count(F.lit(1)), agg)


def strict_sum(x) -> Column:
    return strict(F.sum(_c(x)), x)


def strict_mean(x) -> Column:
    return strict(F.avg(_c(x)), x)


def skip_sum(x) -> Column:
    """Sum over recorded values; nothing recorded sums to 0."""
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def std_error(x) -> Column:
    """Sample sd over the square root of the row count (missing rows count)."""
    return F.stddev_samp(_c(x)) / F.sqrt(F.count(F.lit(1)))


def ratio(num, den, empty=None) -> Column:
    """``num / den``; 0/0 and x/0 give ``empty`` instead of an error."""
    r = F.try_divide(_c(num), _c(den))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def to_number(x) -> Column:
    """Parse text as double; unparsable text is missing."""
    return _c(x).try_cast("double")


def to_integer(x) -> Column:
    return _c(x).try_cast("double").try_cast("int")


def paste(*cols, sep: str = "") -> Column:
    """Join values as text; a missing value prints as ``NA``."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_c(c).cast("string"), F.lit("NA")))
    return F.concat(*parts)


def round_even(x, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(_c(x), digits)


def if_else(cond: Column, yes, no) -> Column:
    """Conditional where an unknown condition gives null."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(cond.isNull(), F.lit(None)).when(cond, lit(yes)).otherwise(lit(no))


def member(x, values) -> Column:
    """Membership test where null is never a member."""
    return F.coalesce(_c(x).isin(list(values)), F.lit(False))


def not_member(x, values) -> Column:
    return ~member(x, values)


def default(x, value) -> Column:
    return F.coalesce(_c(x), F.lit(value))


def cap(x, ceiling) -> Column:
    """Values above ``ceiling`` become ``ceiling``; null stays null."""
    return F.when(_c(x) > F.lit(ceiling), F.lit(ceiling)).otherwise(_c(x))


def clamp(x, low, high, low_mark=None, high_mark=None) -> Column:
    """Two-sided clamp; values outside become the marks (default: the limits)."""
    lo = low if low_mark is None else low_mark
    hi = high if high_mark is None else high_mark
    return (F.when(_c(x) < F.lit(low), F.lit(lo))
            .when(_c(x) > F.lit(high), F.lit(hi)).otherwise(_c(x)))


def recode(x, old, new) -> Column:
    """Replace any of ``old`` (one value or several) by ``new``."""
    olds = [old] if isinstance(old, str) or not hasattr(old, "__iter__") else list(old)
    return F.when(member(x, olds), F.lit(new)).otherwise(_c(x))


def collapse(x, groups: dict) -> Column:
    """Fold listed values into group names; other values stay."""
    out = None
    for name, members in groups.items():
        out = (F if out is None else out).when(member(x, members), F.lit(name))
    return _c(x) if out is None else out.otherwise(_c(x))


def label(x, levels, labels=None) -> Column:
    """Display label of each declared level; undeclared values become null."""
    labels = list(levels) if labels is None else list(labels)
    out = None
    for lv, lb in zip(levels, labels):
        out = (F if out is None else out).when(_c(x) == F.lit(lv), F.lit(lb))
    return out


def level_order(x, levels) -> Column:
    """1-based position of a value in the declared level list, null if absent."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _c(x))
    return F.nullif(pos, F.lit(0)).cast("int")


def branch(*rules, otherwise=None) -> Column:
    """First matching ``(condition, value)``; nothing matching gives null."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = (F if out is None else out).when(cond, v)
    return out if otherwise is None else out.otherwise(otherwise)


def classify(x, classes) -> Column:
    """Right-closed interval classes ``(low, high, value)``; no class: unchanged.

    A class value of ``None`` turns the interval into missing data.
    """
    v = _c(x)
    out = None
    for low, high, value in classes:
        hit = (v > F.lit(float(low))) & (v <= F.lit(float(high)))
        val = F.lit(None).cast("double") if value is None else F.lit(float(value))
        out = (F if out is None else out).when(hit, val)
    return out.otherwise(v)


def row_sum(*cols) -> Column:
    """Sum across columns of a row; any missing makes it missing."""
    total = _c(cols[0])
    for c in cols[1:]:
        total = total + _c(c)
    return total


def row_mean(*cols) -> Column:
    return row_sum(*cols) / F.lit(float(len(cols)))


def row_min(*cols) -> Column:
    """Minimum across columns; any missing makes it missing."""
    known = _c(cols[0]).isNotNull()
    for c in cols[1:]:
        known = known & _c(c).isNotNull()
    return F.when(known, F.least(*[_c(c) for c in cols]))
