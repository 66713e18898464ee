"""Optimal one-to-one assignment by shortest augmenting paths (D. F. Crouse, IEEE TAES 52(4), 2016).

Ties are settled as that algorithm is usually implemented, because scores depend on them: columns are scanned from
the last to the first, and among columns at equal distance one without a partner is preferred.
"""

from __future__ import annotations


def assign(similarity: list[list[float]]) -> list[int]:
    """The column of each row of a square matrix, for the largest sum."""
    n = len(similarity)
    row_price, col_price = [0.0] * n, [0.0] * n
    col_of, row_of = [-1] * n, [-1] * n
    for start in range(n):
        dist, came = [float("inf")] * n, [-1] * n
        open_cols = list(range(n - 1, -1, -1))
        rows_seen, cols_seen = [], []
        row, reached = start, 0.0
        while True:
            rows_seen.append(row)
            best, pick = float("inf"), -1
            for k, col in enumerate(open_cols):
                d = reached - similarity[row][col] - row_price[row] - col_price[col]
                if d < dist[col]:
                    dist[col], came[col] = d, row
                if dist[col] < best or (dist[col] == best and row_of[col] < 0):
                    best, pick = dist[col], k
            reached, col = best, open_cols[pick]
            open_cols[pick] = open_cols[-1]
            open_cols.pop()
            cols_seen.append(col)
            if row_of[col] < 0:
                break
            row = row_of[col]
        row_price[start] += reached
        for r in rows_seen[1:]:
            row_price[r] += reached - dist[col_of[r]]
        for c in cols_seen:
            col_price[c] -= reached - dist[c]
        while True:
            r = came[col]
            row_of[col] = r
            col, col_of[r] = col_of[r], col
            if r == start:
                break
    return col_of


def padded(matrix: list[list[float]], rows: int, cols: int) -> list[list[float]]:
    """Zeros fill a matrix up to a square."""
    size = max(rows, cols)
    return [[*r, *[0.0] * (size - cols)] for r in matrix] + [[0.0] * size for _ in range(size - rows)]
