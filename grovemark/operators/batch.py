"""The kernel's rules on whole Arrow batches, where expressions can't say them: pairing by likeness, lists in order.

Typed pairs come as columns and stay columns: of a batch's lists all cells are laid side by side and compared at once, by numpy
where they are numbers and once for each distinct pair where they are texts; assignment is solved for all lists of a size
together. Nothing is spelled as JSON and no tree of nodes is built. ``Unsupported``: identifiers, references, metrics that see more
than two values, and columns whose types break the schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..plans.columns import Unsupported
from ..plans.schema import Node
from .kernel import ABSENT, Comparison

#: Cells that are compared at once, but for one larger pair of lists.
CELLS = 1 << 19
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def assign_all(similarity: np.ndarray) -> np.ndarray:
    """``assign`` for each of many square matrices of one size (b, n, n): the column of each row, ties settled alike.

    All matrices take a step together: those whose path has reached a free column wait for the rest.
    """
    b, n, _ = similarity.shape
    row_price, col_price = np.zeros((b, n)), np.zeros((b, n))
    col_of, row_of = np.full((b, n), -1), np.full((b, n), -1)
    every = np.arange(b)
    for start in range(n):
        dist, came = np.full((b, n), np.inf), np.full((b, n), -1)
        rows_seen, cols_seen = np.zeros((b, n), bool), np.zeros((b, n), bool)
        place = np.tile(np.arange(n - 1, -1, -1), (b, 1))  # where the scan meets a column
        row, reached, sink, live = np.full(b, start), np.zeros(b), np.full(b, -1), every
        for left in range(n - 1, -1, -1):  # columns that stay open after this step
            at = row[live]
            rows_seen[live, at] = True
            open_ = ~cols_seen[live]
            d = reached[live, None] - similarity[live, at] - row_price[live, at][:, None] - col_price[live]
            own = dist[live]
            closer = open_ & (d < own)
            own = np.where(closer, d, own)
            dist[live] = own
            came[live] = np.where(closer, at[:, None], came[live])
            shown = np.where(open_, own, np.inf)
            best = shown.min(1)
            tied = open_ & (shown == best[:, None])
            free = tied & (row_of[live] < 0)
            places = place[live]
            pick = np.where(free.any(1), np.where(free, places, -1).argmax(1), np.where(tied, places, n).argmin(1))
            reached[live] = best
            last = np.where(open_, places, -1).argmax(1)  # the last of the scan moves to the place that falls free
            place[live, last] = place[live, pick]
            cols_seen[live, pick] = True
            done = row_of[live, pick] < 0
            sink[live[done]] = pick[done]
            row[live[~done]] = row_of[live[~done], pick[~done]]
            live = live[~done]
            if not len(live):
                break
        row_price[:, start] += reached
        rows_seen[:, start] = False
        along = np.take_along_axis(dist, np.maximum(col_of, 0), 1)
        row_price += np.where(rows_seen, reached[:, None] - along, 0.0)
        col_price -= np.where(cols_seen, reached[:, None] - np.where(cols_seen, dist, 0.0), 0.0)
        col, live = sink, every
        while len(live):
            r = came[live, col]
            row_of[live, col] = r
            before = col_of[live, r]
            col_of[live, r] = col
            on = r != start
            live, col = live[on], before[on]
    return col_of


def in_order_all(sims: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best pairings without crossings of many padded matrices (b, N, M): (pair, i, j) of all rows in order, -1 for no partner.

    Ties as in the kernel: a pair before a gold item left out before a pred item left out; pairs without likeness fall apart.
    """
    b, rows, cols = sims.shape
    best = np.zeros((b, rows + 1, cols + 1))
    for d in range(2, rows + cols + 1):  # cells on one diagonal don't need one another
        i = np.arange(max(1, d - cols), min(rows, d - 1) + 1)
        j = d - i
        best[:, i, j] = np.maximum(np.maximum(best[:, i - 1, j - 1] + sims[:, i - 1, j - 1], best[:, i - 1, j]), best[:, i, j - 1])
    i, j, every = n.copy(), m.copy(), np.arange(b)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = every[(i > 0) | (j > 0)]
    while len(live):
        a, c = i[live], j[live]
        both = (a > 0) & (c > 0)
        up, left = np.maximum(a - 1, 0), np.maximum(c - 1, 0)
        now, s = best[live, a, c], np.where(both, sims[live, np.minimum(up, rows - 1), np.minimum(left, cols - 1)], 0.0) if rows and cols else np.zeros(len(live))
        pair = both & (now == best[live, up, left] + s)
        out = ~pair & (a > 0) & ((c == 0) | (now == best[live, up, c]))
        apart, joined = pair & (s <= 0), pair & (s > 0)
        gone = ~pair & ~out  # a pred item left out
        steps.append((live[joined | gone | apart], np.where(joined, up, -1)[joined | gone | apart], left[joined | gone | apart]))
        steps.append((live[out | apart], up[out | apart], np.full(int((out | apart).sum()), -1)))
        i[live], j[live] = np.where(pair | out, up, a), np.where(pair | gone, left, c)
        live = live[(i[live] > 0) | (j[live] > 0)]
    if not steps:
        return (np.zeros(0, np.int64),) * 3
    p, g, q = (np.concatenate([s[k] for s in reversed(steps)]) for k in range(3))
    order = np.argsort(p, kind="stable")
    return p[order], g[order], q[order]


class Lists:
    """Lists of a column as places in one array of items."""

    def __init__(self, items: pa.Array, starts: np.ndarray, sizes: np.ndarray):
        self.items, self.starts, self.sizes = items, starts, sizes

    @classmethod
    def of(cls, column: pa.Array) -> Lists:
        """``column`` has no nulls."""
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(column.flatten(), np.cumsum(sizes) - sizes, sizes)

    def head(self, k: int) -> Lists:
        return Lists(self.items, self.starts, np.minimum(self.sizes, k))

    def tail(self, k: int) -> Lists:
        return Lists(self.items, self.starts + np.minimum(self.sizes, k), np.maximum(self.sizes - k, 0))

    def part(self, where: np.ndarray) -> Lists:
        return Lists(self.items, self.starts[where], self.sizes[where])


def _numbers(x: pa.Array) -> np.ndarray:
    return x.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def _kind(t: pa.DataType) -> str:
    if pa.types.is_boolean(t):
        return "boolean"
    if pa.types.is_integer(t):
        return "integer"
    if pa.types.is_floating(t):
        return "number"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_struct(t):
        return "object"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return "array"
    raise Unsupported(f"columns of type {t}")


def _alike(a: str, b: str) -> bool:
    return a == b or {a, b} == {"integer", "number"}


class BatchScorer:
    """One plan, many batches."""

    def __init__(self, plan: Comparison):
        self.plan = plan
        for _, node in plan.schema.places():
            if node.id_scope or node.ref:
                raise Unsupported("identifiers need all records of a pair")

    def check(self, node: Node, gold: pa.DataType, pred: pa.DataType) -> None:
        """Raises ``Unsupported`` where these types need the kernel for single pairs, before any data is read."""
        if not _alike(kind := _kind(gold), _kind(pred)):
            raise Unsupported(f"{kind} against {_kind(pred)}")
        if kind == "object":
            named = [{f.name: f.type for f in x} for x in (gold, pred)]
            self._object(node, pa.array([], gold), pa.array([], pred))
            for g, p, *_ in self.plan.keys_of(node, tuple(named[0]), tuple(named[1])):
                if g is not ABSENT and p is not ABSENT and g in node.properties and _alike(_kind(named[0][g]), _kind(named[1][p])):
                    self.check(node.properties[g], named[0][g], named[1][p])
        elif kind == "array":
            self._list(node, pa.array([], gold), pa.array([], pred))
            for inner in (*(node.prefix or ()), *([node.items] if node.items else [])):
                self.check(inner, gold.value_type, pred.value_type)
        else:
            self._leaf(node, kind, pa.array([], gold), pa.array([], pred))

    def score(self, node: Node, gold: pa.Array, pred: pa.Array) -> np.ndarray:
        """A score for each row of two columns."""
        g, p = (x.is_valid().to_numpy(zero_copy_only=False) for x in (gold, pred))
        out = np.where(g | p, float(node.null_score), 1.0)
        both = np.flatnonzero(g & p)
        kind, other = _kind(gold.type), _kind(pred.type)
        if not _alike(kind, other):
            raise Unsupported(f"{kind} against {other}")
        if len(both) < len(out):
            gold, pred = gold.take(pa.array(both)), pred.take(pa.array(both))
        out[both] = self._object(node, gold, pred) if kind == "object" else self._list(node, gold, pred) if kind == "array" else self._leaf(node, kind, gold, pred)
        return out

    def _leaf(self, node: Node, kind: str, gold: pa.Array, pred: pa.Array) -> np.ndarray:
        if not any(_alike(kind, t) for t in node.types):
            raise Unsupported(f"a {kind} is not of type {'/'.join(node.types)}")
        if kind == "boolean":
            return (gold.to_numpy(zero_copy_only=False) == pred.to_numpy(zero_copy_only=False)).astype(float)
        table = self.plan.strings if kind == "string" else self.plan.integers if "integer" in node.types else self.plan.numbers
        name = node.score or ("jaro" if kind == "string" else "invdiff")
        if name not in table:
            raise ValueError(f"unknown comparator {name!r} for {kind}")
        fn = table[name]
        if getattr(fn, "wants_context", False) or hasattr(fn, "by_likeness"):
            raise Unsupported("a comparator that sees more than two values")
        if kind == "string" or name not in ("exact", "invdiff", "relative"):
            out = self._distinct(fn, name, gold, pred)
        else:
            out = self._numeric(name, gold, pred)
        return np.where(out < node.threshold, 0.0, out)

    def _numeric(self, name: str, gold: pa.Array, pred: pa.Array) -> np.ndarray:
        if name == "exact" and pa.types.is_integer(gold.type) and pa.types.is_integer(pred.type):
            return (gold.to_numpy(zero_copy_only=False) == pred.to_numpy(zero_copy_only=False)).astype(float)
        a, b = _numbers(gold), _numbers(pred)
        with np.errstate(all="ignore"):
            same = a == b
            if name == "exact":
                return same.astype(float)
            out = 1 / (1 + np.abs(a - b)) if name == "invdiff" else np.maximum(0.0, 1 - np.abs(a - b) / np.maximum(np.abs(a), np.abs(b)))
        return np.where(same, 1.0, np.nan_to_num(out, nan=0.0))

    def _distinct(self, fn: Callable, name: str, gold: pa.Array, pred: pa.Array) -> np.ndarray:
        """By each distinct pair of values."""
        (a, own), (b, others) = ((d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()) for d in (gold.dictionary_encode(), pred.dictionary_encode()))
        codes, at = np.unique(a * max(1, len(others)) + b, return_inverse=True)
        found = np.empty(len(codes))
        for k, code in enumerate(codes.tolist()):
            got = fn(own[code // len(others)], others[code % len(others)])
            if isinstance(got, bool) or not isinstance(got, (int, float)) or not 0 <= got <= 1:
                raise ValueError(f"comparator {name!r} gave {got!r}, not a number from 0 to 1")
            found[k] = got
        return found[at]

    def _object(self, node: Node, gold: pa.Array, pred: pa.Array) -> np.ndarray:
        if "object" not in node.types:
            raise Unsupported("an object where none is due")
        names = [[f.name for f in x.type] for x in (gold, pred)]
        rows = self.plan.keys_of(node, tuple(names[0]), tuple(names[1]))
        if not rows:
            return np.ones(len(gold))
        whole, keys, values, weights = node.key_importance + node.value_importance, 0.0, np.zeros(len(gold)), 0.0
        for g, p, likeness, _ in rows:
            keys += likeness
            child = node.properties.get(g) if g is not ABSENT and p is not ABSENT else None
            weights += 1.0 if child is None else child.weight
            if child is None or not child.weight:
                continue
            a, b = pc.struct_field(gold, names[0].index(g)), pc.struct_field(pred, names[1].index(p))
            if _alike(_kind(a.type), _kind(b.type)):
                values += child.weight * self.score(child, a, b)
            else:  # other kinds score 0, nulls as ever
                there = a.is_valid().to_numpy(zero_copy_only=False).astype(int) + b.is_valid().to_numpy(zero_copy_only=False)
                values += child.weight * np.choose(there, [1.0, float(child.null_score), 0.0])
        values = values / weights if weights else values * 0.0
        return np.clip(node.key_importance / whole * keys / len(rows) + node.value_importance / whole * values, 0.0, 1.0)

    def _list(self, node: Node, gold: pa.Array, pred: pa.Array) -> np.ndarray:
        if "array" not in node.types:
            raise Unsupported("a list where none is due")
        if node.items is None and node.prefix is None:
            raise ValueError("an array needs items or prefixItems")
        if node.order not in ("fixed", "align"):
            raise ValueError(f"order must be 'fixed' or 'align', not {node.order!r}")
        g, p = Lists.of(gold), Lists.of(pred)
        if node.prefix is None:
            return self._pairing(node, g, p)
        k = len(node.prefix)
        first = self._prefix(node, g.head(k), p.head(k))
        if node.items is None:
            return first
        if node.prefix_importance is None or node.rest_importance is None:
            raise ValueError("prefixItems beside items need prefixImportance and restImportance")
        whole = node.prefix_importance + node.rest_importance
        return np.clip(node.prefix_importance / whole * first + node.rest_importance / whole * self._pairing(node, g.tail(k), p.tail(k)), 0.0, 1.0)

    def _prefix(self, node: Node, g: Lists, p: Lists) -> np.ndarray:
        above, below = np.zeros(len(g.sizes)), np.zeros(len(g.sizes))
        for k, (child, w) in enumerate(zip(node.prefix, node.prefix_weights, strict=True)):
            below += w * ((g.sizes > k) | (p.sizes > k))
            both = np.flatnonzero((g.sizes > k) & (p.sizes > k))
            if len(both):
                above[both] += w * self.score(child, g.items.take(pa.array(g.starts[both] + k)), p.items.take(pa.array(p.starts[both] + k)))
        return np.divide(above, below, out=np.ones(len(above)), where=below > 0)

    def _pairing(self, node: Node, g: Lists, p: Lists) -> np.ndarray:
        total, counted = np.zeros(len(g.sizes)), np.zeros(len(g.sizes))
        for pair, i, j, s in self.rows(node, g, p):
            gold_null, pred_null = (self._none(x, pair, at) for x, at in ((g, i), (p, j)))
            seen = ~((node.ignore_excess & gold_null) | (node.ignore_missing & pred_null))
            total += np.bincount(pair, s, len(total))
            counted += np.bincount(pair, seen, len(total))
        return np.minimum(1.0, np.divide(total, counted, out=np.ones(len(total)), where=counted > 0))

    @staticmethod
    def _none(lists: Lists, pair: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a row has no item on a side, or a null one."""
        if not len(lists.items):
            return np.ones(len(at), bool)
        valid = lists.items.is_valid().to_numpy(zero_copy_only=False)
        return (at < 0) | ~valid[np.minimum(lists.starts[pair] + np.maximum(at, 0), len(valid) - 1)]

    def rows(self, node: Node, g: Lists, p: Lists) -> Iterator[Rows]:
        """(pair, gold index, pred index, score) of the alignments' rows in their order, -1 for no partner; pairs by chunks."""
        cells = np.maximum(1, g.sizes * p.sizes)
        edges, ends = [0], np.cumsum(cells)
        while edges[-1] < len(cells):
            done = ends[edges[-1] - 1] if edges[-1] else 0
            edges.append(max(edges[-1] + 1, int(np.searchsorted(ends, done + CELLS, side="right"))))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = np.arange(lo, hi)
            yield from self._chunk(node, g.part(own), p.part(own), lo)

    def _chunk(self, node: Node, g: Lists, p: Lists, shift: int) -> Iterator[Rows]:
        cells = g.sizes * p.sizes
        starts = np.cumsum(cells) - cells
        pair = np.repeat(np.arange(len(cells)), cells)
        within = np.arange(len(pair)) - starts[pair]
        i, j = within // np.maximum(1, p.sizes)[pair], within % np.maximum(1, p.sizes)[pair]
        sims = self.score(node.items, g.items.take(pa.array(g.starts[pair] + i)), p.items.take(pa.array(p.starts[pair] + j))) if len(pair) else np.zeros(0)
        reorder = node.order == "align"
        size = np.maximum(g.sizes, p.sizes)
        group = size if reorder else np.left_shift(1, np.ceil(np.log2(np.maximum(1, g.sizes))).astype(int)) * (1 << 32) + np.left_shift(1, np.ceil(np.log2(np.maximum(1, p.sizes))).astype(int))
        of = group[pair]
        for key in np.unique(group[size > 0]).tolist():
            where = np.flatnonzero((group == key) & (size > 0))
            mine = np.flatnonzero(of == key)
            n, m = g.sizes[where], p.sizes[where]
            shape = (int(size[where].max()),) * 2 if reorder else (int(n.max()), int(m.max()))
            square = np.zeros((len(where), *shape))
            square[np.searchsorted(where, pair[mine]), i[mine], j[mine]] = sims[mine]
            if reorder:
                a, b, c = self._assigned(square, n, m, g.part(where), p.part(where))
            else:
                a, b, c = in_order_all(square, n, m)
            s = np.where((b >= 0) & (c >= 0), square[a, np.maximum(b, 0), np.maximum(c, 0)] if square.size else 0.0, 0.0)
            yield where[a] + shift, b, c, s

    def _assigned(self, square: np.ndarray, n: np.ndarray, m: np.ndarray, g: Lists, p: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the best pairing in any order: pairs without likeness fall apart, the excess item first; null items alone are no row."""
        b, size, _ = square.shape
        single = (n == 1) | (size == 1)
        col = np.empty((b, size), np.int64)
        if single.any():  # one gold item takes its likest, the rows that fill up take the others as they come
            first = square[single, 0].argmax(1)
            others = np.arange(size - 1)
            col[single] = np.concatenate([first[:, None], others + (others >= first[:, None])], 1)
        if not single.all():
            col[~single] = assign_all(square[~single])
        row = np.broadcast_to(np.arange(size), (b, size))
        pair = np.broadcast_to(np.arange(b)[:, None], (b, size))
        joined = (row < n[:, None]) & (col < m[:, None]) & (np.take_along_axis(square, col[:, :, None], 2)[:, :, 0] > 0)
        excess = ~joined & (col < m[:, None]) & ~self._none(p, pair.ravel(), np.where(col < m[:, None], col, -1).ravel()).reshape(b, size)
        missing = ~joined & (row < n[:, None]) & ~self._none(g, pair.ravel(), np.where(row < n[:, None], row, -1).ravel()).reshape(b, size)
        there = np.stack([joined | excess, missing], 2)
        i = np.stack([np.where(joined, row, -1), row], 2)
        j = np.stack([col, np.full((b, size), -1)], 2)
        return np.broadcast_to(pair[:, :, None], there.shape)[there], i[there], j[there]


def scores(plan: Comparison) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: (pair_id, _ok, gold, pred) to (pair_id, score); pairs that aren't ok score 0."""
    scorer = BatchScorer(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.flatnonzero(batch.column("_ok").to_numpy(zero_copy_only=False))
            out = np.zeros(batch.num_rows)
            if len(ok):
                gold, pred = batch.column("gold"), batch.column("pred")
                if len(ok) < batch.num_rows:
                    gold, pred = gold.take(pa.array(ok)), pred.take(pa.array(ok))
                out[ok] = scorer.score(plan.schema, gold, pred)
            yield pa.record_batch([batch.column("pair_id"), pa.array(out)], ["pair_id", "score"])

    return run


#: One alignment of two lists: its score, and of each row its step, its place in pred, both indices (null for no item), score and share.
ALIGNED = "struct<score:double,rows:array<struct<step:int,at:int,g:int,p:int,s:double,a:double>>>"
_ROW = pa.struct([(c, pa.int32()) for c in ("step", "at", "g", "p")] + [(c, pa.float64()) for c in ("s", "a")])


def aligned_lists(plan: Comparison) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """The alignments (ALIGNED) of two columns of lists under a list's plan; null where a list is."""
    scorer, node = BatchScorer(plan), plan.schema

    def pairing(g: Lists, p: Lists, shift: int) -> tuple[np.ndarray, list[np.ndarray]]:
        parts = [(pair, i, j, s) for pair, i, j, s in scorer.rows(node, g, p)]
        pair, i, j, s = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in parts)]) for k in range(4))
        order = np.argsort(pair, kind="stable")
        pair, i, j, s = pair[order].astype(np.int64), i[order].astype(np.int64), j[order].astype(np.int64), s[order]
        gold_null, pred_null = scorer._none(g, pair, i), scorer._none(p, pair, j)
        seen = ~((node.ignore_excess & gold_null) | (node.ignore_missing & pred_null))
        counted = np.bincount(pair, seen, len(g.sizes))
        total = np.bincount(pair, s, len(g.sizes))
        share = np.where(seen, 1 / np.maximum(1, counted)[pair], 0.0)
        step = np.arange(len(pair)) - np.searchsorted(pair, pair) + shift
        score = np.minimum(1.0, np.divide(total, counted, out=np.ones(len(total)), where=counted > 0))
        up = lambda x: np.where(x >= 0, x + shift, -1)
        return score, [pair, step, np.where(j >= 0, j, i) + shift, up(i), up(j), s, share]

    def places(g: Lists, p: Lists) -> tuple[np.ndarray, list[np.ndarray]]:
        n, k = len(g.sizes), len(node.prefix)
        s, w = np.zeros((n, k)), np.zeros((n, k))
        at = np.arange(k)
        has_g, has_p = at < g.sizes[:, None], at < p.sizes[:, None]
        for x, (child, weight) in enumerate(zip(node.prefix, node.prefix_weights, strict=True)):
            both = np.flatnonzero(has_g[:, x] & has_p[:, x])
            if len(both):
                s[both, x] = scorer.score(child, g.items.take(pa.array(g.starts[both] + x)), p.items.take(pa.array(p.starts[both] + x)))
            w[:, x] = weight * (has_g[:, x] | has_p[:, x])
            s[~has_g[:, x] & ~has_p[:, x], x] = 1.0  # an empty place
        whole = w.sum(1)
        share = np.divide(w, whole[:, None], out=np.zeros_like(w), where=whole[:, None] > 0)
        wide = lambda x: np.broadcast_to(x, (n, k)).ravel()
        return np.where(whole > 0, (share * s).sum(1), 1.0), [wide(np.arange(n)[:, None]), wide(at), wide(at), np.where(has_g, at, -1).ravel(), np.where(has_p, at, -1).ravel(), s.ravel(), share.ravel()]

    def run(gold: pa.Array, pred: pa.Array) -> pa.Array:
        both = np.flatnonzero(gold.is_valid().to_numpy(zero_copy_only=False) & pred.is_valid().to_numpy(zero_copy_only=False))
        g, p = (Lists.of(x.take(pa.array(both))) for x in (gold, pred))
        if node.prefix is None:
            score, rows = pairing(g, p, 0)
        else:
            k = len(node.prefix)
            score, rows = places(g.head(k), p.head(k))
            if node.items is not None:
                whole = node.prefix_importance + node.rest_importance
                a, b = node.prefix_importance / whole, node.rest_importance / whole
                more, others = pairing(g.tail(k), p.tail(k), k)
                rows[-1], others[-1] = rows[-1] * a, others[-1] * b
                score = np.clip(a * score + b * more, 0.0, 1.0)
                rows = [np.concatenate([x, y]) for x, y in zip(rows, others, strict=True)]
                order = np.argsort(rows[0], kind="stable")
                rows = [x[order] for x in rows]
        pair, *rest = rows
        if len(pair) and np.bincount(pair).max() >= 1 << 20:
            raise ValueError("an alignment of more than 2**20 rows")
        counts = np.zeros(len(gold), np.int64)
        counts[both] = np.bincount(pair, minlength=len(both))
        index = [pa.array(x.astype(np.int32), mask=x < 0) for x in rest[:4]]
        flat = pa.StructArray.from_arrays([*index, *(pa.array(x, pa.float64()) for x in rest[4:])], fields=list(_ROW))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
        there = np.zeros(len(gold), bool)
        there[both] = True
        scores_ = np.zeros(len(gold))
        scores_[both] = score
        return pa.StructArray.from_arrays([pa.array(scores_), lists], ["score", "rows"], mask=pa.array(~there))

    return run
