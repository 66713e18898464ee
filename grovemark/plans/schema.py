"""Annotated JSON schemas, compiled once on the driver: the schema is the query plan.

``compile_schema`` checks what can be checked without data and returns a tree of ``Node``; ``scopes`` and
``scope_order`` describe the records that carry identifiers and the order in which they must be resolved.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from numbers import Real
from typing import Any

PRIMITIVES = ("boolean", "integer", "number", "string")


@dataclass(frozen=True)
class Node:
    """One schema node with its defaults filled in."""

    types: tuple[str, ...]
    raw: dict = field(hash=False, compare=False)
    score: str | None = None
    threshold: float = 0.0
    null_score: float = 0.0
    order: str = "fixed"
    ignore_excess: bool = False
    ignore_missing: bool = False
    properties: dict[str, Node] = field(default_factory=dict, hash=False)
    items: Node | None = None
    prefix: tuple[Node, ...] | None = None
    prefix_weights: tuple[float, ...] = ()
    prefix_importance: float | None = None
    rest_importance: float | None = None
    weight: float = 1.0
    key_score: str = "jaro"
    key_threshold: float = 0.0
    key_importance: float = 0.0
    value_importance: float = 1.0
    id_scope: str | None = None
    ref: str | None = None

    @property
    def nullable(self) -> bool:
        return "null" in self.types

    @property
    def type(self) -> str | None:
        """The only type besides null, if there is one."""
        rest = [t for t in self.types if t != "null"]
        return rest[0] if len(rest) == 1 else None

    def walk(self, path: str = "") -> Iterator[tuple[str, Node]]:
        """Every node below and this one, with its schema path."""
        yield path, self
        for name, child in self.properties.items():
            yield from child.walk(f"{path}/properties/{name}")
        for k, child in enumerate(self.prefix or ()):
            yield from child.walk(f"{path}/prefixItems/{k}")
        if self.items is not None:
            yield from self.items.walk(f"{path}/items")


    def places(self, steps: tuple[str | int, ...] = ()) -> Iterator[tuple[tuple[str | int, ...], Node]]:
        """Every node below and this one, with the steps to its data ('*' is every item)."""
        yield steps, self
        for name, child in self.properties.items():
            yield from child.places((*steps, name))
        for k, child in enumerate(self.prefix or ()):
            yield from child.places((*steps, k))
        if self.items is not None:
            yield from self.items.places((*steps, "*"))


def _number(raw: dict, key: str, default: float) -> float:
    value = raw.get(key, default)
    if isinstance(value, bool) or not isinstance(value, Real):
        raise ValueError(f"{key} must be a number, not {value!r}")
    return float(value)


def compile_schema(raw: dict[str, Any], where: str = "/") -> Node:
    """The tree of a schema; ValueError or TypeError for what can't be right for any data."""
    if not isinstance(raw, dict):
        raise ValueError(f"the schema at {where} is not an object")
    kinds = raw.get("type")
    types = tuple(kinds) if isinstance(kinds, list) else (kinds,) if kinds else ()
    if unknown := [t for t in types if t not in (*PRIMITIVES, "array", "object", "null")]:
        raise ValueError(f"unknown type {unknown[0]!r} at {where}")
    null_score = raw.get("nullScore", 0.0)
    if isinstance(null_score, bool) or not isinstance(null_score, Real) or not 0 <= null_score <= 1:
        raise ValueError(f"nullScore at {where} must be a number from 0 to 1, not {null_score!r}")
    if raw.get("ignoreExcess") and raw.get("ignoreMissing"):
        raise ValueError(f"ignoreExcess and ignoreMissing exclude each other at {where}")
    scope, ref = raw.get("idScope"), raw.get("ref")
    for name, value in (("idScope", scope), ("ref", ref)):
        if value is None:
            continue
        if not isinstance(value, str) or not value:
            raise ValueError(f"{name} at {where} must be a name")
        if not types or any(t not in ("string", "integer", "number") for t in types if t != "null"):
            raise TypeError(f"{name} at {where} needs type string, integer or number")
        if "score" in raw or "threshold" in raw:
            warnings.warn(f"score and threshold are ignored beside {name} at {where}", UserWarning, stacklevel=2)
    if scope and ref:
        raise ValueError(f"a node can't be idScope and ref at once: {where}")
    properties = {k: compile_schema(v, f"{where.rstrip('/')}/properties/{k}") for k, v in raw.get("properties", {}).items()}
    prefix = tuple(compile_schema(v, f"{where.rstrip('/')}/prefixItems/{k}") for k, v in enumerate(raw["prefixItems"])) if "prefixItems" in raw else None
    items = compile_schema(raw["items"], f"{where.rstrip('/')}/items") if "items" in raw else None
    weights = tuple(float(w) for w in raw.get("prefixWeights", [1.0] * len(prefix or ())))
    node = Node(
        types=types, raw=raw, score=raw.get("score"), threshold=_number(raw, "threshold", 0.0), null_score=float(null_score),
        order=raw.get("order", "fixed"), ignore_excess=bool(raw.get("ignoreExcess")), ignore_missing=bool(raw.get("ignoreMissing")),
        properties=properties, items=items, prefix=prefix, prefix_weights=weights,
        prefix_importance=raw.get("prefixImportance"), rest_importance=raw.get("restImportance"), weight=_number(raw, "valueWeight", 1.0),
        key_score=raw.get("keyScore", "jaro"), key_threshold=_number(raw, "keyThreshold", 0.0),
        key_importance=_number(raw, "keyImportance", 0.0), value_importance=_number(raw, "valueImportance", 1.0), id_scope=scope, ref=ref,
    )
    if "object" in types:
        if node.key_importance + node.value_importance == 0:
            raise ValueError(f"keyImportance and valueImportance sum to 0 at {where}")
        if properties and sum(p.weight for p in properties.values()) == 0:
            raise ValueError(f"the valueWeights sum to 0 at {where}")
    if "array" in types and prefix is not None:
        if len(weights) != len(prefix):
            raise ValueError(f"prefixWeights and prefixItems differ in length at {where}")
        if prefix and sum(weights) == 0:
            raise ValueError(f"the prefixWeights sum to 0 at {where}")
        if node.prefix_importance is not None and node.rest_importance is not None and node.prefix_importance + node.rest_importance == 0:
            raise ValueError(f"prefixImportance and restImportance sum to 0 at {where}")
    if where == "/":
        scopes(node)
    return node


@dataclass(frozen=True)
class Place:
    """Where identifiers or references of a scope are: steps from the root ('*' is every item), and the node's type."""

    scope: str
    steps: tuple[str | int, ...]
    types: tuple[str, ...]

    @property
    def record(self) -> tuple[str | int, ...]:
        """Steps to the array item that holds the identifier."""
        last = max(k for k, s in enumerate(self.steps) if s == "*")
        return self.steps[: last + 1]


def _places(node: Node, steps: tuple[str | int, ...] = ()) -> Iterator[tuple[str, Place]]:
    if node.id_scope:
        yield "id", Place(node.id_scope, steps, node.types)
    if node.ref:
        yield "ref", Place(node.ref, steps, node.types)
    for name, child in node.properties.items():
        yield from _places(child, (*steps, name))
    for k, child in enumerate(node.prefix or ()):
        yield from _places(child, (*steps, k))
    if node.items is not None:
        yield from _places(node.items, (*steps, "*"))


def scopes(node: Node) -> tuple[dict[str, Place], list[Place]]:
    """({scope: where its identifiers are}, where references are), checked against each other."""
    found = list(_places(node))
    ids: dict[str, Place] = {}
    for kind, place in found:
        if kind == "id":
            if "*" not in place.steps:
                raise ValueError(f"idScope {place.scope!r} is not inside an array")
            if place.scope in ids:
                raise ValueError(f"idScope {place.scope!r} is declared twice")
            ids[place.scope] = place
    refs = [place for kind, place in found if kind == "ref"]
    for place in refs:
        if place.scope not in ids:
            raise ValueError(f"ref to unknown scope {place.scope!r}")
        if {t for t in place.types if t != "null"} != {t for t in ids[place.scope].types if t != "null"}:
            raise ValueError(f"ref and idScope {place.scope!r} differ in type")
    return ids, refs


def scope_order(node: Node) -> tuple[list[str], bool]:
    """(scopes so that those a record refers to come before it, whether a cycle made that impossible)."""
    ids, refs = scopes(node)
    needs: dict[str, set[str]] = {name: set() for name in ids}
    for name, place in ids.items():
        for ref in refs:
            if ref.steps[: len(place.record)] == place.record and ref.scope != name:
                needs[name].add(ref.scope)
    order: list[str] = []
    while len(order) < len(ids):
        ready = sorted(n for n in ids if n not in order and needs[n] <= set(order))
        if not ready:
            warnings.warn("scopes refer to each other in a cycle; references are left out of their matching", UserWarning, stacklevel=2)
            return [*order, *sorted(set(ids) - set(order))], True
        order.append(ready[0])
    return order, False
