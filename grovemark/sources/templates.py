"""Text templates: TOML tables, checked for unknown keys and placeholders, and filled as Column expressions."""

from __future__ import annotations

import string
import tomllib
from collections.abc import Mapping
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flat(table: Mapping, at: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for key, value in table.items():
        name = f"{at}.{key}" if at else key
        if isinstance(value, Mapping):
            out |= _flat(value, name)
        elif isinstance(value, str):
            out[name] = value
        else:
            raise ValueError(f"template {name!r} is not a text")
    return out


def packaged(name: str) -> dict[str, str]:
    """Templates that come with the package."""
    return _flat(tomllib.loads(resources.files("grovemark").joinpath("templates", name).read_text(encoding="utf-8")))


def load_templates(path: str) -> dict[str, str]:
    """Templates of a file, whose keys may be dotted names or nested tables."""
    with open(path, "rb") as f:
        return _flat(tomllib.load(f))


def placeholders(text: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(text) if name is not None}


#: What a text may say beyond its default's placeholders.
ALWAYS = {"score", "score_pct", "confidence", "confidence_pct", "score_delta", "score_delta_pct", "rank", "path", "indent", "gold", "pred", "value", "key"}


def merged(defaults: Mapping[str, str], given: Mapping[str, str] | None) -> dict[str, str]:
    """Defaults under a user's texts; ValueError for a key that has no default or a placeholder it can't have."""
    for key, text in (given or {}).items():
        if key not in defaults:
            raise ValueError(f"unknown template {key!r}")
        if not isinstance(text, str):
            raise ValueError(f"template {key!r} is not a text")
        if unknown := placeholders(text) - placeholders(defaults[key]) - ALWAYS:
            raise ValueError(f"template {key!r} has unknown placeholders {sorted(unknown)}")
    return {**defaults, **(given or {})}


def feedback_templates(style: str = "full", given: Mapping[str, str] | None = None) -> dict[str, str]:
    base = packaged("feedback.toml")
    if style == "compact":
        base |= packaged("feedback.compact.toml")
    return merged(base, given)


def describe_templates(given: Mapping[str, str] | None = None) -> dict[str, str]:
    return merged(packaged("describe.toml"), given)


def fill(text: str, values: Mapping[str, Column]) -> Column:
    """The text with its placeholders' columns; nulls read None. Marks such as :.3f format numbers."""
    parts: list[Column] = []
    for literal, name, mark, _ in string.Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            column = values[name]
            parts.append(F.format_string(f"%{mark}", column.cast("double")) if mark else F.coalesce(column.cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def choose(cases: list[tuple[Column, Column]]) -> Column:
    """The first case whose condition holds, or an empty text."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit("") if out is None else out.otherwise(F.lit(""))
