"""The general comparison of one pair, for what expressions can't say: optimal and ordered pairing of arbitrary children.

``compare`` returns a tree of ``Match``; ``flatten`` turns it into rows of the node table, over which attribution,
repair, feedback and description are DataFrame queries.
"""

from __future__ import annotations

import json
import math
import warnings
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from ..functions.strings import SIMILARITIES
from ..plans.schema import Node, Place, scope_order, scopes
from .assign import assign, padded


class _Absent:
    """No value on this side."""

    def __repr__(self) -> str:
        return "absent"


ABSENT = _Absent()
#: NaN is like nothing, itself included; equal infinities are alike.
NUMERIC: dict[str, Callable[[float, float], float]] = {
    "exact": lambda a, b: float(a == b),
    "invdiff": lambda a, b: 1.0 if a == b else 0.0 if a != a or b != b else 1 / (1 + abs(a - b)),
    "relative": lambda a, b: 1.0 if a == b else 0.0 if a != a or b != b else max(0.0, 1 - abs(a - b) / max(abs(a), abs(b))),
}


def context_metric(fn=None, *, roots: bool = True):
    """Marks a comparator that also wants a ``Context``. Without ``roots`` it is promised not to look at whole documents, so that typed
    pairs send only its values and their parents to Python."""

    def mark(f):
        f.wants_context, f.wants_roots = True, roots
        return f

    return mark if fn is None else mark(fn)


@dataclass(frozen=True)
class Context:
    """What a context comparator sees of its surroundings."""

    gold_parent: Any
    pred_parent: Any
    gold_root: Any
    pred_root: Any
    path: str


@dataclass(slots=True)
class Match:
    """One node of an alignment. kind: of an item what compared it, of a list how it was paired."""

    score: float
    gold: Any
    pred: Any
    node_type: str = "item"
    kind: str = "score"
    confidence: float = 1.0
    target: Any = None
    children: Sequence[Match] = ()
    alphas: Sequence[float] = ()
    key: Match | None = None  # of an object's child: how its key compared
    key_alphas: Sequence[float] = ()
    step: str | None = None
    at: str | None = None  # the step in the prediction, or where the missing item belongs
    scope: str | None = None  # of a reference


@dataclass(frozen=True)
class Options:
    """How pairs are compared, beside the schema."""

    compute_confidence: bool = False
    confidence_method: str = "margin"
    temperature: float = 8.0
    disambiguation: str = "wl"
    wl_fold: str = "tie_break"
    wl_lambda: float = 0.5
    wl_rounds: int | None = None

    def __post_init__(self):
        if self.confidence_method not in ("margin", "entropy"):
            raise ValueError(f"confidence_method must be 'margin' or 'entropy', not {self.confidence_method!r}")
        if not self.temperature > 0:
            raise ValueError("temperature must be positive")
        if self.disambiguation not in ("wl", "none"):
            raise ValueError(f"disambiguation must be 'wl' or 'none', not {self.disambiguation!r}")
        if self.wl_fold not in ("tie_break", "blend"):
            raise ValueError(f"wl_fold must be 'tie_break' or 'blend', not {self.wl_fold!r}")
        if not 0 <= self.wl_lambda <= 1:
            raise ValueError("wl_lambda must lie in [0, 1]")
        if self.wl_rounds is not None and self.wl_rounds < 0:
            raise ValueError("wl_rounds must not be negative")


_KINDS = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}


def kind_of(value: Any) -> str:
    return _KINDS[type(value)]


def margin(matrix: list[list[float]], pairs: list[tuple[int, int]]) -> list[float]:
    """Each pair's similarity less the best other in its row or column, cut to [0, 1]; without others, itself."""
    out = []
    for i, j in pairs:
        others = [s for k, s in enumerate(matrix[i]) if k != j] + [r[j] for k, r in enumerate(matrix) if k != i]
        out.append(min(1.0, max(0.0, matrix[i][j] - max(others, default=0.0))))
    return out


def entropy(matrix: list[list[float]], pairs: list[tuple[int, int]], temperature: float) -> list[float]:
    """One less the normalised entropy of a softmax over each pair's row."""
    out = []
    for i, _ in pairs:
        row = matrix[i]
        if len(row) < 2:
            out.append(1.0)
            continue
        top = max(row)
        w = [math.exp(temperature * (s - top)) for s in row]
        total = sum(w)
        h = -sum(x / total * math.log(x / total) for x in w if x > 0)
        out.append(min(1.0, max(0.0, 1 - h / math.log(len(row)))))
    return out


def _key_likeness(schema: Node, a: str, b: str) -> float:
    s = SIMILARITIES[schema.key_score](a, b)
    return 0.0 if s < schema.key_threshold else s


def sureness(options: Options, sims: list[list[float]], pairs: list[tuple[int, int]]) -> list[float]:
    return margin(sims, pairs) if options.confidence_method == "margin" else entropy(sims, pairs, options.temperature)


def pair_keys(schema: Node, keys: tuple[str, ...], others: tuple[str, ...], options: Options) -> list[tuple[Any, Any, float, float]]:
    """(gold key, pred key, likeness, confidence) of each row of an object's alignment: it depends on the keys alone.

    Pairs without likeness fall apart, the excess key before the missing one.
    """
    if schema.key_score not in ("jaro", "exact"):
        raise ValueError(f"keyScore must be 'jaro' or 'exact', not {schema.key_score!r}")
    if set(keys) == set(others):  # equal keys are the only optimum
        sure = [1.0] * len(keys)
        if options.compute_confidence:
            sure = sureness(options, [[_key_likeness(schema, a, b) for b in keys] for a in keys], [(i, i) for i in range(len(keys))])
        return [(k, k, 1.0, c) for k, c in zip(keys, sure, strict=True)]
    sims = [[_key_likeness(schema, a, b) for b in others] for a in keys]
    found = list(enumerate(assign(padded(sims, len(keys), len(others)))))
    cells = [(i, j) for i, j in found if i < len(keys) and j < len(others) and sims[i][j] > 0]
    sure = dict(zip(cells, sureness(options, sims, cells), strict=True)) if options.compute_confidence and cells else {}
    rows: list[tuple[Any, Any, float, float]] = []
    for i, j in found:
        if i < len(keys) and j < len(others) and sims[i][j] > 0:
            rows.append((keys[i], others[j], sims[i][j], sure.get((i, j), 1.0)))
        else:
            rows += [(ABSENT, others[j], 0.0, 1.0)] if j < len(others) else []
            rows += [(keys[i], ABSENT, 0.0, 1.0)] if i < len(keys) else []
    return rows


@dataclass(slots=True)
class _Layout:
    """What the alignment of two objects owes to their keys alone."""

    rows: list[tuple[Match, Node | None, float, str, str]]  # key, schema of its value (none: that counts as 0), weight, step, the step in the prediction
    alphas: list[float]
    key_alphas: list[float]
    score: float  # of the keys
    sure: list[float]  # of the keys that both have
    weights: float


def _laid_out(schema: Node, found: list[tuple[Any, Any, float, float]]) -> _Layout:
    rows = []
    for g, p, s, sure in found:
        child = None if g is ABSENT or p is ABSENT else schema.properties.get(g)
        step = escaped(str(g if g is not ABSENT else p))
        at = step if g is p else escaped(str(p if p is not ABSENT else g))
        rows.append((Match(s, g, p, kind="key", confidence=sure), child, 1.0 if child is None else child.weight, step, at))
    whole = schema.key_importance + schema.value_importance
    weights = sum(w for _, _, w, _, _ in rows)
    keys_share, value_share = schema.key_importance / whole / len(rows), schema.value_importance / whole
    alphas = [value_share * w / weights if weights else 0.0 for _, _, w, _, _ in rows]
    sure = [k.confidence for k, *_ in rows if k.gold is not ABSENT and k.pred is not ABSENT]
    return _Layout(rows, alphas, [keys_share] * len(rows), sum([k.score * keys_share for k, *_ in rows]), sure, weights)


class Comparison:
    """One schema, many pairs. Custom comparators: {type: {name: fn}}."""

    def __init__(self, schema: Node, options: Options | None = None, custom: dict[str, dict[str, Callable]] | None = None):
        self.schema, self.options = schema, options or Options()
        self.strings, self.numbers, self.integers = dict(SIMILARITIES), dict(NUMERIC), dict(NUMERIC)
        tables = {"string": self.strings, "number": self.numbers, "integer": self.integers}
        for kind, fns in (custom or {}).items():
            if kind not in tables:
                raise ValueError(f"custom comparators are for {', '.join(tables)}, not {kind!r}")
            for name, fn in fns.items():
                if not isinstance(name, str) or not callable(fn):
                    raise TypeError("custom comparators are functions by name")
                if name in (SIMILARITIES if kind == "string" else NUMERIC):
                    raise ValueError(f"{name!r} is a built-in comparator")
                tables[kind][name] = fn
                if kind == "number":
                    self.integers.setdefault(name, fn)
        self.ids, self.refs = scopes(schema)
        self.order, self.degraded = scope_order(schema)
        self._keys: dict[tuple, list] = {}
        self._layouts: dict[tuple, _Layout] = {}

    def keys_of(self, schema: Node, keys: tuple[str, ...], others: tuple[str, ...]) -> list[tuple[Any, Any, float, float]]:
        """``pair_keys``, solved once for each pair of key lists."""
        at = (id(schema), keys, others)
        if (found := self._keys.get(at)) is None:
            if len(self._keys) > 10_000:
                self._keys.clear()
            found = self._keys[at] = pair_keys(schema, keys, others, self.options)
        return found

    def layout_of(self, schema: Node, keys: tuple[str, ...], others: tuple[str, ...]) -> _Layout:
        """What ``pair_keys`` says, ready for the values of any pair with these keys."""
        at = (id(schema), keys, others)
        if (found := self._layouts.get(at)) is None:
            if len(self._layouts) > 10_000:
                self._layouts.clear()
            found = self._layouts[at] = _laid_out(schema, self.keys_of(schema, keys, others))
        return found

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_keys": {}, "_layouts": {}}  # nodes have other ids in other processes

    def compare(self, gold: Any, pred: Any, known: dict | None = None) -> tuple[Match, dict[str, dict]]:
        """(the alignment, for each scope the identifiers' counterparts). known: the likenesses of texts that metrics by embedding compare."""
        run = _Run(self, gold, pred, known)
        run.resolve()
        return run.node(self.schema, gold, pred, "", None, None), run.mappings

    def identities(self, gold: Any, pred: Any, known: dict | None = None) -> list[tuple[str, Any, Any, bool]]:
        """(scope, gold identifier, its counterpart or None, whether another record has the same likenesses throughout)."""
        run = _Run(self, gold, pred, known)
        run.resolve()
        return [(scope, i, j, i in run.twins.get(scope, ())) for scope, found in run.mappings.items() for i, j in found.items()]


class _Run:
    def __init__(self, plan: Comparison, gold: Any, pred: Any, known: dict | None = None):
        self.plan, self.gold, self.pred, self.opt, self.known = plan, gold, pred, plan.options, known
        self.twins: dict[str, set] = {}
        self.mappings: dict[str, dict] = {}
        self.pred_ids: dict[str, set] = {}
        self.masked: set[str] | None = None  # scopes whose references count as right while costs are found

    # Leaves.

    def node(self, schema: Node, gold: Any, pred: Any, path: str, gold_parent: Any, pred_parent: Any) -> Match:
        if schema.id_scope:
            return Match(1.0, gold, pred, kind="id")
        if schema.ref:
            return self._reference(schema, gold, pred)
        if gold is None or pred is None:
            return Match(1.0 if gold is None and pred is None else schema.null_score, gold, pred, kind="null")
        kind = kind_of(gold)
        if kind == "object":
            return self._object(schema, gold, pred, path)
        if kind == "array":
            return self._list(schema, gold, pred, path)
        return Match(self._leaf(schema, kind, gold, pred, path, gold_parent, pred_parent), gold, pred)

    def _leaf(self, schema: Node, kind: str, gold: Any, pred: Any, path: str, gold_parent: Any, pred_parent: Any) -> float:
        if kind not in schema.types and not (kind in ("integer", "number") and {"integer", "number"} & set(schema.types)):
            raise TypeError(f"a {kind} is not of type {'/'.join(schema.types)}")
        if kind == "boolean":
            return float(gold == pred)
        table = self.plan.strings if kind == "string" else self.plan.integers if "integer" in schema.types else self.plan.numbers
        name = schema.score or ("jaro" if kind == "string" else "invdiff")
        if name not in table:
            raise ValueError(f"unknown comparator {name!r} for {kind}")
        fn = table[name]
        if self.known is not None and hasattr(fn, "by_likeness"):
            score = fn.by_likeness(self.known, gold, pred)
        elif getattr(fn, "wants_context", False):
            score = fn(gold, pred, Context(gold_parent, pred_parent, self.gold, self.pred, path))
        else:
            score = fn(gold, pred)
        if isinstance(score, bool) or not isinstance(score, (int, float)) or not 0 <= score <= 1:
            raise ValueError(f"comparator {name!r} gave {score!r}, not a number from 0 to 1")
        return 0.0 if score < schema.threshold else float(score)

    def _reference(self, schema: Node, gold: Any, pred: Any) -> Match:
        scope = schema.ref
        if self.masked is not None and scope in self.masked:
            return Match(1.0, gold, pred, kind="ref", scope=scope)
        target = self.mappings.get(scope, {}).get(gold)
        if gold is None or pred is None:
            score = 1.0 if gold is None and pred is None else schema.null_score
        else:
            score = float(target is not None and target == pred and pred in self.pred_ids.get(scope, set()))
        return Match(score, gold, pred, kind="ref", target=target, scope=scope)

    # Objects.

    def _object(self, schema: Node, gold: dict, pred: dict, path: str) -> Match:
        out = Match(1.0, gold, pred, node_type="dict", kind="object")
        if not gold and not pred:
            return out
        plan = self.plan.layout_of(schema, tuple(gold), tuple(pred))
        out.children = children = []
        for key, child, _, step, at in plan.rows:
            g, p = key.gold, key.pred
            if g is ABSENT or p is ABSENT:
                value = Match(0.0, ABSENT if g is ABSENT else gold.get(g, ABSENT), ABSENT if p is ABSENT else pred.get(p, ABSENT), kind="unmatched")
            elif child is None:
                warnings.warn(f"key {g!r} is not in the schema and counts as 0", UserWarning, stacklevel=2)
                value = Match(0.0, gold[g], pred[p], kind="undeclared")
            else:
                a, b = gold[g], pred[p]
                soft = a is not None and b is not None and type(a) is not type(b) and not child.id_scope and not child.ref and kind_of(a) != kind_of(b)
                value = Match(0.0, a, b, kind="type") if soft else self.node(child, a, b, f"{path}/{escaped(g)}", gold, pred)
                if value.node_type == "item" and key.confidence < value.confidence:
                    value.confidence = key.confidence
            value.key, value.step, value.at = key, step, at
            children.append(value)
        out.alphas, out.key_alphas = plan.alphas, plan.key_alphas
        out.score = min(1.0, max(0.0, plan.score + sum([v.score * a for v, a in zip(children, plan.alphas, strict=True)])))
        if self.opt.compute_confidence and plan.sure:
            whole = schema.key_importance + schema.value_importance
            keys_sure = sum(plan.sure) / len(plan.sure)
            values_sure = sum(v.confidence * row[2] for v, row in zip(children, plan.rows, strict=True)) / plan.weights if plan.weights else 1.0
            out.confidence = (schema.key_importance * keys_sure + schema.value_importance * values_sure) / whole
        return out

    # Lists.

    def _list(self, schema: Node, gold: list, pred: list, path: str) -> Match:
        if schema.items is None and schema.prefix is None:
            raise ValueError("an array needs items or prefixItems")
        if schema.order not in ("fixed", "align"):
            raise ValueError(f"order must be 'fixed' or 'align', not {schema.order!r}")
        if schema.prefix is None:
            return self._pairing(schema, gold, pred, path, gold, pred)
        k = len(schema.prefix)
        first = self._prefix(schema, gold[:k], pred[:k], path, gold, pred)
        if schema.items is None:
            first.gold, first.pred = gold, pred
            return first
        if schema.prefix_importance is None or schema.rest_importance is None:
            raise ValueError("prefixItems beside items need prefixImportance and restImportance")
        rest = self._pairing(schema, gold[k:], pred[k:], path, gold, pred, k)
        whole = schema.prefix_importance + schema.rest_importance
        a, b = schema.prefix_importance / whole, schema.rest_importance / whole
        out = Match(min(1.0, max(0.0, a * first.score + b * rest.score)), gold, pred, "list", "combined", a * first.confidence + b * rest.confidence)
        out.children = [*first.children, *rest.children]
        out.alphas = [a * x for x in first.alphas] + [b * x for x in rest.alphas]
        return out

    def _prefix(self, schema: Node, gold: list, pred: list, path: str, gold_parent: list, pred_parent: list) -> Match:
        out = Match(1.0, gold, pred, "list", "prefix", children=[])
        weights = []
        for k, (child, w) in enumerate(zip(schema.prefix, schema.prefix_weights, strict=True)):
            g, p = gold[k] if k < len(gold) else ABSENT, pred[k] if k < len(pred) else ABSENT
            if g is ABSENT and p is ABSENT:
                m = Match(1.0, ABSENT, ABSENT, kind="absent")
                w = 0.0
            elif g is ABSENT or p is ABSENT:
                m = Match(0.0, g, p, kind="unmatched")
            else:
                m = self.node(child, g, p, f"{path}/{k}", gold_parent, pred_parent)
            m.step = m.at = str(k)
            out.children.append(m)
            weights.append(w)
        total = sum(weights)
        out.alphas = [w / total if total else 0.0 for w in weights]
        out.score = sum(a * m.score for a, m in zip(out.alphas, out.children, strict=True)) if total else 1.0
        if self.opt.compute_confidence and total:
            out.confidence = sum(a * m.confidence for a, m in zip(out.alphas, out.children, strict=True))
        return out

    def _pairing(self, schema: Node, gold: list, pred: list, path: str, gold_parent: list, pred_parent: list, shift: int = 0) -> Match:
        reorder = schema.order == "align"
        out = Match(1.0, gold, pred, "list", "reorder" if reorder else "fixed")
        if not gold and not pred:
            return out
        cells = [[self.node(schema.items, g, p, f"{path}/{i + shift}", gold_parent, pred_parent) for p in pred] for i, g in enumerate(gold)]
        sims = [[m.score for m in row] for row in cells]
        rows, pairs = self._align(gold, pred, sims) if reorder else self._in_order(gold, pred, sims)
        out.children, counted = [], []
        for k, (i, j) in enumerate(rows):
            m = cells[i][j] if i is not None and j is not None else Match(0.0, gold[i] if i is not None else ABSENT, pred[j] if j is not None else ABSENT, kind="unmatched")
            m.step, m.at = str(k + shift), str((j if j is not None else i) + shift)
            out.children.append(m)
            # A null item counts as an empty place here.
            counted.append(not (schema.ignore_excess and m.gold in (ABSENT, None) or schema.ignore_missing and m.pred in (ABSENT, None)))
        d = sum(counted)
        out.alphas = [1 / d if c else 0.0 for c in counted] if d else [0.0] * len(counted)
        out.score = min(1.0, sum(m.score for m in out.children) / d) if d else 1.0
        if self.opt.compute_confidence and pairs:
            if reorder:
                for (i, j), c in zip(pairs, sureness(self.opt, sims, pairs), strict=True):
                    cells[i][j].confidence = c
            out.confidence = sum(cells[i][j].confidence for i, j in pairs) / len(pairs)
        return out

    def _align(self, gold: list, pred: list, sims: list[list[float]]) -> tuple[list, list]:
        """(rows (gold index, pred index) in the order of the assignment, pairs): pairs without likeness fall apart, excess first."""
        n, m = len(gold), len(pred)
        rows, pairs = [], []
        for i, j in enumerate(assign(padded(sims, n, m) if n else [[0.0] * m for _ in range(m)])):
            if i < n and j < m and sims[i][j] > 0:
                rows.append((i, j))
                pairs.append((i, j))
                continue
            if j < m and pred[j] is not None:
                rows.append((None, j))
            if i < n and gold[i] is not None:
                rows.append((i, None))
        return rows, pairs

    def _in_order(self, gold: list, pred: list, sims: list[list[float]]) -> tuple[list, list]:
        """The best pairing that crosses no pairs; on ties a pair before a gold item left out before a pred item left out."""
        n, m = len(gold), len(pred)
        best = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                best[i][j] = max(best[i - 1][j - 1] + sims[i - 1][j - 1], best[i - 1][j], best[i][j - 1])
        rows, pairs, i, j = [], [], n, m
        while i or j:
            if i and j and best[i][j] == best[i - 1][j - 1] + sims[i - 1][j - 1]:
                i, j = i - 1, j - 1
                if sims[i][j] > 0:
                    rows.append((i, j))
                    pairs.append((i, j))
                else:
                    rows += [(None, j), (i, None)]
            elif i and (not j or best[i][j] == best[i - 1][j]):
                i -= 1
                rows.append((i, None))
            else:
                j -= 1
                rows.append((None, j))
        return rows[::-1], pairs[::-1]

    # Identifiers.

    def resolve(self) -> None:
        """Pairs the records of each scope and keeps which identifier stands for which."""
        plan = self.plan
        if not plan.ids:
            return
        records = {s: (list(_records(self.gold, p)), list(_records(self.pred, p))) for s, p in plan.ids.items()}
        for scope, (mine, theirs) in records.items():
            counts = Counter(json.dumps(i) for i, _ in mine if i is not None)
            if double := [k for k, c in counts.items() if c > 1]:
                raise ValueError(f"gold identifier {double[0]} of scope {scope!r} is not unique")
            self.pred_ids[scope] = {i for i, _ in theirs}
        for place in plan.refs:
            known = {i for i, _ in records[place.scope][0]}
            for value, _ in values_at(self.gold, place.steps, ()):
                if value is not None and value not in known:
                    raise ValueError(f"gold reference {value!r} points to nothing in scope {place.scope!r}")
        for scope in plan.order:
            place = plan.ids[scope]
            mine, theirs = records[scope]
            node = _schema_at(plan.schema, place.record)
            self.masked = {p.scope for p in plan.refs} if plan.degraded else {scope}
            cost = []
            for _, g in mine:
                row = []
                for _, p in theirs:
                    try:
                        row.append(self.node(node, g, p, "", None, None).score)
                    except (TypeError, ValueError):
                        row.append(0.0)
                cost.append(row)
            self.masked = None
            if self.opt.disambiguation == "wl" and not plan.degraded and (len(mine) > 1 or len(theirs) > 1):
                cost = self._structured(scope, cost, mine, theirs)
            found: dict = {i: None for i, _ in mine}
            taken: set = set()
            if mine and theirs:
                for i, j in enumerate(assign(padded(cost, len(mine), len(theirs)))):
                    if i < len(mine) and j < len(theirs) and theirs[j][0] not in taken:
                        found[mine[i][0]] = theirs[j][0]
                        taken.add(theirs[j][0])
            alike = Counter(tuple(r) for r in cost)
            self.twins[scope] = {i for (i, _), r in zip(mine, cost, strict=True) if alike[tuple(r)] > 1}
            if self.twins[scope]:
                warnings.warn(f"records of scope {scope!r} can't be told apart", UserWarning, stacklevel=3)
            self.mappings[scope] = found

    def _structured(self, scope: str, cost: list[list[float]], mine: list, theirs: list) -> list[list[float]]:
        """Costs with what the reference graph says: records with equal Weisfeiler-Leman colours belong together."""
        edges = [_edges(self.plan, scope, data, self.mappings, side == 0, {i for i, _ in own}) for side, (data, own) in enumerate(((self.gold, mine), (self.pred, theirs)))]
        node = _schema_at(self.plan.schema, self.plan.ids[scope].record)
        seeds = [[_label(_scalars(node, r)) if self.opt.wl_fold == "blend" else "" for _, r in own] for own in (mine, theirs)]
        colours = refine([[i for i, _ in mine], [i for i, _ in theirs]], edges, seeds, self.opt.wl_rounds)
        same = [[float(colours[0].get(g) == colours[1].get(p)) if g in colours[0] and p in colours[1] else 0.0 for p, _ in theirs] for g, _ in mine]
        if self.opt.wl_fold == "blend":
            lam = self.opt.wl_lambda
            return [[(1 - lam) * c + lam * w for c, w in zip(a, b, strict=True)] for a, b in zip(cost, same, strict=True)]
        values = sorted({c for row in cost for c in row})
        gaps = [b - a for a, b in zip(values[:-1], values[1:], strict=True) if b > a]
        eps = min(gaps, default=1.0) / (len(mine) * len(theirs) + 1)
        return [[c + eps * w for c, w in zip(a, b, strict=True)] for a, b in zip(cost, same, strict=True)]


def refine(vertices: list[list], edges: list[list[tuple]], seeds: list[list[str]], rounds: int | None = None) -> list[dict]:
    """1-WL colours of two graphs together: equal colours, equal surroundings. edges: (from, to, role, label) by graph."""
    colour = {(s, v): seed for s, (vs, ss) in enumerate(zip(vertices, seeds, strict=True)) for v, seed in zip(vs, ss, strict=True)}
    around: dict[tuple, list[tuple]] = {}
    for s, own in enumerate(edges):
        for a, b, role, label in own:
            for end in ((s, a), (s, b)):
                colour.setdefault(end, "")
            around.setdefault((s, a), []).append(("out", role, label, (s, b)))
            around.setdefault((s, b), []).append(("in", role, label, (s, a)))
    number = {c: k for k, c in enumerate(sorted(set(colour.values())))}
    now = {v: number[c] for v, c in colour.items()}
    for _ in range(len(now) if rounds is None else rounds):
        seen = {v: (c, tuple(sorted((d, r, w, now[u]) for d, r, w, u in around.get(v, ())))) for v, c in now.items()}
        number = {c: k for k, c in enumerate(sorted(set(seen.values())))}
        new = {v: number[c] for v, c in seen.items()}
        if len(number) == len(set(now.values())):
            break
        now = new
    return [{v: c for (s, v), c in now.items() if s == side} for side in (0, 1)]


@lru_cache(10_000)
def escaped(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def values_at(data: Any, steps: tuple, at: tuple):
    """(value, place) of all data that steps lead to; what has another shape is passed over."""
    if not steps:
        yield data, at
    elif steps[0] == "*":
        for k, item in enumerate(data if isinstance(data, list) else ()):
            yield from values_at(item, steps[1:], (*at, k))
    elif isinstance(steps[0], int):
        if isinstance(data, list) and steps[0] < len(data):
            yield from values_at(data[steps[0]], steps[1:], (*at, steps[0]))
    elif isinstance(data, dict) and steps[0] in data:
        yield from values_at(data[steps[0]], steps[1:], (*at, steps[0]))


def _records(data: Any, place: Place):
    """(identifier, record) of a scope's records."""
    inner = place.steps[len(place.record) :]
    for record, _ in values_at(data, place.record, ()):
        for value, _ in list(values_at(record, inner, ()))[:1]:
            yield value, record


def _schema_at(node: Node, steps: tuple) -> Node:
    for s in steps:
        node = node.items if s == "*" else node.prefix[s] if isinstance(s, int) else node.properties[s]
    return node


def _scalars(node: Node, record: Any) -> list[tuple[str, str, Any]]:
    """(kind, key, value) of a record's own values that can be compared exactly: strings, integers, booleans and enumerated
    values by their schema, no identifiers or references, and no floating numbers."""
    if not isinstance(record, dict):
        return []
    plain = lambda n: not n.id_scope and not n.ref and ("enum" in n.raw or n.raw.get("type") in ("string", "integer", "boolean"))
    return [(kind_of(record[k]), k, record[k]) for k, n in node.properties.items() if k in record and plain(n) and not isinstance(record[k], (dict, list))]


def _label(parts: list[tuple]) -> str:
    return "|".join(sorted(map(repr, parts)))


def _carrier(plan: Comparison, ref: Place) -> int:
    """How many steps lead to what carries a reference: the outermost object in an array; without one the array's item, else its parent."""
    items = [k for k, s in enumerate(ref.steps) if s == "*" or isinstance(s, int)]
    for k in items:
        if "object" in _schema_at(plan.schema, ref.steps[: k + 1]).types:
            return k + 1
    return items[-1] + 1 if items else len(ref.steps) - 1


def _edges(plan: Comparison, scope: str, data: Any, mappings: dict[str, dict], is_gold: bool, known: set) -> list[tuple]:
    """The reference graph of a scope: references that one carrier holds join their records, where these are known.

    One reference tags its record; two in different roles are an edge; any other number meet in a vertex of their own. Labels:
    the carrier's comparable values, and what it refers to in scopes that are paired already, the gold side's mapped to the other's.
    """
    groups: dict[tuple, list[tuple]] = {}
    for ref in plan.refs:
        if ref.scope == scope:
            depth = _carrier(plan, ref)
            groups.setdefault(ref.steps[:depth], []).append(ref.steps[depth:])
    out: list[tuple] = []
    hubs = 0
    for at, roles in groups.items():
        node = _schema_at(plan.schema, at)
        others = [(r.scope, r.steps[len(at) :]) for r in plan.refs if r.scope != scope and r.scope in mappings and len(r.steps) > len(at) and r.steps[: len(at)] == at]
        for carrier, _ in values_at(data, at, ()):
            ends = [(repr(role), v) for role in sorted(roles, key=repr) for v, _ in values_at(carrier, role, ()) if v in known]
            if not ends:
                continue
            across = [("across", s, repr(steps), mappings[s].get(v) if is_gold else v) for s, steps in others for v, _ in values_at(carrier, steps, ())]
            label = _label([*_scalars(node, carrier), *across])
            if len(ends) == 1:
                out.append((ends[0][1], ends[0][1], f"one {ends[0][0]}", label))
            elif len(ends) == 2 and ends[0][0] != ends[1][0]:
                (r1, a), (r2, b) = sorted(ends, key=lambda e: e[0])
                out.append((a, b, f"edge {r1} {r2}", label))
            else:
                hubs += 1
                out += [(v, ("hub", hubs), f"member {r}", label) for r, v in ends]
    return out
