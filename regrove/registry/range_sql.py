"""The studentized range in SQL, for many degrees of freedom.

The range of k normals is integrated by Simpson's rule over a grid of z; the normal distribution
function is summed along the grid and read between its points by a Taylor step.  The spread of the
pooled deviation enters by its first two moments, which leaves an error of the order of 1 / df**2.
"""

from __future__ import annotations

STEP, LAST, FAR = 0.005, 3600, 9

NORMAL_GRID = f"""zg0 AS (SELECT i, -{FAR} + i * {STEP} AS z FROM (SELECT unnest(range(0, {LAST + 1})) AS i)),
zg AS (SELECT i, z, exp(-z * z / 2) / sqrt(2 * pi()) AS f, sum(CASE WHEN i = 0 THEN 0 ELSE {STEP} / 6 / sqrt(2 * pi()) * (exp(-pow(z - {STEP}, 2) / 2)
 + 4 * exp(-pow(z - {STEP} / 2, 2) / 2) + exp(-z * z / 2)) END) OVER (ORDER BY i) AS c FROM zg0)"""


def range_tail(source: str, q: str, name: str, keys: str) -> str:
    """CTEs ending in ``name``: for each row of ``source`` (with ``k`` and ``v``) the tail ``p`` at ``q`` and its slope."""
    simpson = f"(CASE WHEN a.i = 0 OR a.i = {LAST} THEN 1 WHEN a.i % 2 = 1 THEN 4 ELSE 2 END) * {STEP} / 3"
    return f"""{name}_x AS (SELECT s.*, greatest(a.z - s.{q}, -{FAR}) AS y, a.f AS fz, a.c AS cz, {simpson} AS wt FROM {source} s, zg a),
{name}_y AS (SELECT x.*, exp(-y * y / 2) / sqrt(2 * pi()) AS fy,
 greatest(cz - (b.c + (y - b.z) * b.f * (1 - (y - b.z) / 2 * b.z + pow(y - b.z, 2) / 6 * (b.z * b.z - 1))), 0) AS span
 FROM {name}_x x JOIN zg b ON b.i = CAST(round((y + {FAR}) / {STEP}) AS INTEGER)),
{name}_z AS (SELECT {keys}, any_value(v) AS v, any_value({q}) AS q, any_value(k) * sum(wt * fz * pow(span, k - 1)) AS f0,
 any_value(k * (k - 1)) * sum(wt * fz * fy * pow(span, k - 2)) AS f1,
 any_value(k * (k - 1)) * sum(wt * fz * (y * fy * pow(span, k - 2) + (k - 2) * fy * fy * CASE WHEN k = 3 THEN 1 ELSE pow(span, k - 3) END)) AS f2
 FROM {name}_y GROUP BY {keys}),
{name} AS (SELECT {keys}, q, f1, 1 - (f0 - q * f1 / (4 * v) + q * q * f2 / (4 * v)) AS p FROM {name}_z)"""


def range_cut(source: str, level: float, start: float, name: str, keys: str, steps: int = 4) -> str:
    """CTEs ending in ``name``: the point ``q`` whose tail is ``level``, by Newton steps from ``start``."""
    parts = [f"{name}_s0 AS (SELECT {keys}, k, v, {start} AS q FROM {source})"]
    for n in range(steps):
        parts.append(range_tail(f"{name}_s{n}", "q", f"{name}_t{n}", keys))
        on = " AND ".join(f"s.{c.strip()} = t.{c.strip()}" for c in keys.split(","))
        columns = ", ".join(f"s.{c.strip()}" for c in keys.split(","))
        parts.append(f"{name}_s{n + 1} AS (SELECT {columns}, k, v, s.q + (t.p - {level}) / t.f1 AS q FROM {name}_s{n} s JOIN {name}_t{n} t ON {on})")
    parts.append(f"{name} AS (SELECT {keys}, q FROM {name}_s{steps})")
    return ",\n".join(parts)
