"""Elimination inside one block, on coordinate arrays: no Spark here.

Rows depend on each other in order, so these are loops over a block's rows; blocks
run side by side.  Ids are permuted ids.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Pivots smaller than this don't eliminate; skipped updates are counted.
TINY = 1e-14

Row = tuple[list[int], list[float]]


def rows_of(row: np.ndarray, col: np.ndarray, val: np.ndarray) -> dict[int, Row]:
    """Row id -> its columns in ascending order and their values."""
    if not len(row):
        return {}
    order = np.lexsort((col, row))
    row, col, val = row[order], col[order], val[order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    ends = np.append(starts[1:], len(row)).tolist()
    cols, vals = col.tolist(), val.tolist()
    return {r: (cols[a:b], vals[a:b]) for r, a, b in zip(row[starts].tolist(), starts.tolist(), ends, strict=True)}


def _pivot(row: Row, k: int) -> tuple[float, list[int], list[float]]:
    """The diagonal value of row k (0 if absent), and columns and values right of it."""
    cols, vals = row
    at = bisect_left(cols, k)
    if at < len(cols) and cols[at] == k:
        return vals[at], cols[at + 1 :], vals[at + 1 :]
    return 0.0, cols[at:], vals[at:]


def eliminate(targets: dict[int, Row], ready: dict[int, Row], tiny: float = TINY) -> dict[int, int]:
    """ILU(0) of the target rows in place, in ascending order; updates skipped, by row.

    Pivot rows come from `ready` (finished rows of this block or others) and from
    targets already done.  The pattern of a row never grows.
    """
    pivots = {k: _pivot(r, k) for k, r in ready.items()}
    none: tuple[float, list[int], list[float]] = (0.0, [], [])
    skipped: dict[int, int] = {}
    for i in sorted(targets):
        cols, vals = targets[i]
        place = None
        for x in range(bisect_left(cols, i)):
            pivot, right, values = pivots.get(cols[x], none)
            if abs(pivot) < tiny:
                skipped[i] = skipped.get(i, 0) + 1
                continue
            factor = vals[x] = vals[x] / pivot
            if place is None:
                place = dict(zip(cols, range(len(cols)), strict=True)).get
            for at, u in zip(map(place, right), values, strict=True):
                if at is not None:
                    vals[at] -= factor * u
        pivots[i] = _pivot(targets[i], i)
    return skipped


def forward(lower: dict[int, Row], x: dict[int, float], rows: list[int]) -> dict[int, float]:
    """Solve with the unit lower triangle; x holds right sides of `rows` and finished others."""
    for i in sorted(rows):
        if i in lower:
            total = x[i]
            for c, v in zip(*lower[i], strict=True):
                total -= v * x[c]
            x[i] = total
    return {i: x[i] for i in rows}


def backward(upper: dict[int, Row], x: dict[int, float], rows: list[int], missing_diag: str = "raise") -> dict[int, float]:
    """Solve with the upper triangle, from the last row up."""
    for i in sorted(rows, reverse=True):
        total, diagonal = x[i], None
        for c, v in zip(*upper.get(i, ((), ())), strict=True):
            if c == i:
                diagonal = v
            else:
                total -= v * x[c]
        if diagonal is None and missing_diag == "one":
            diagonal = 1.0
        if not diagonal:
            raise ZeroDivisionError(f"the factors are singular: row {i} has no pivot")
        x[i] = total / diagonal
    return {i: x[i] for i in rows}


def spread(lines: dict[int, Row], at: dict[int, int], upper: bool, missing_diag: str = "raise") -> dict[int, np.ndarray]:
    """How rows depend on values outside: row -> its change for 1 more in each of them (columns `at`).

    Rows that depend on none are left out.
    """
    found: dict[int, np.ndarray] = {}
    for i in sorted(lines, reverse=upper):
        total, diagonal = None, 1.0 if not upper or missing_diag == "one" else 0.0
        for c, v in zip(*lines[i], strict=True):
            if c == i:
                diagonal = v
            elif c in at or c in found:
                if total is None:
                    total = np.zeros(len(at))
                if c in at:
                    total[at[c]] -= v
                else:
                    total -= v * found[c]
        if total is not None:
            if not diagonal:
                raise ZeroDivisionError(f"the factors are singular: row {i} has no pivot")
            found[i] = total / diagonal
    return found
