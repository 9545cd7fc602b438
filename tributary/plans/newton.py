"""Logistic regression as recursive SQL, by which fitted coefficients are held against another engine."""

from __future__ import annotations

from itertools import permutations

from .measurement import CTE

RECURSIVE = CTE.replace("WITH pool", "WITH RECURSIVE pool", 1)


def _determinant(rows: list[list[str]]) -> str:
    """The determinant of a matrix of column names, written out."""
    n, terms = len(rows), []
    for order in permutations(range(n)):
        odd = sum(order[i] > order[j] for i in range(n) for j in range(i + 1, n)) % 2
        terms.append(("- " if odd else "+ ") + " * ".join(rows[i][order[i]] for i in range(n)))
    return "(0 " + " ".join(terms) + ")"


def newton_sql(rows: str, keys: list[str], columns: list[str], target: str, l2: str = "0e0", rounds: int = 25) -> str:
    """CTEs newton and fitted (keys, b0, b1, ...) of logistic regressions by keys over a table rows, by Newton steps from 0.

    l2 is a column of rows, or a number, that weighs half the squared coefficients against the mean loss. The systems are
    solved by Cramer's rule, so columns are few.
    """
    d = len(columns) + 1
    x = ["1e0", *[f"r.{c}" for c in columns]]
    key = ", ".join(keys)
    b = ", ".join(f"b{i}" for i in range(d))
    z = " + ".join(f"b{i} * {x[i]}" for i in range(d))
    weight = f"max({'r.' + l2 if l2.isidentifier() else l2})"
    free = lambda i: "" if i == 0 else f" + {weight} * b{i}"
    g = [f"avg((1 / (1 + exp(-({z}))) - r.{target}) * {x[i]}){free(i)} AS g{i}" for i in range(d)]
    h = [f"avg(exp(-abs({z})) / (1 + exp(-abs({z}))) ** 2 * {x[i]} * {x[j]}){f' + {weight}' if i == j and i else ''} AS h{i}{j}" for i in range(d) for j in range(i, d)]
    matrix = [[f"h{min(i, j)}{max(i, j)}" for j in range(d)] for i in range(d)]
    swapped = lambda c: [[f"g{i}" if j == c else matrix[i][j] for j in range(d)] for i in range(d)]
    moved = ", ".join(f"b{i} - {_determinant(swapped(i))} / {_determinant(matrix)} AS b{i}" for i in range(d))
    zero = ", ".join(f"0e0 AS b{i}" for i in range(d))
    return f""", newton AS (SELECT 0 AS step, {key}, {zero} FROM (SELECT DISTINCT {key} FROM {rows})
UNION ALL SELECT step + 1, {key}, {moved} FROM (SELECT step, {key}, {b}, {', '.join(g + h)} FROM newton JOIN {rows} r USING ({key}) WHERE step < {rounds} GROUP BY step, {key}, {b})),
fitted AS (SELECT {key}, {b} FROM newton WHERE step = {rounds})"""
