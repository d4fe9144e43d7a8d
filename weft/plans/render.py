"""Results as text: a table with packed headers."""

from __future__ import annotations

import decimal
import unicodedata
from typing import Any

from .shape import Shape, ordinal


def _cell(x: Any, top: bool = True) -> str:
    if x is None:
        return ""
    if isinstance(x, list):
        inner = "; ".join(_cell(v, False) for v in x)
        return inner if top else f"[{inner}]"
    if isinstance(x, dict):
        inner = ", ".join(_cell(v, False) for v in x.values())
        return inner if top else f"({inner})"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x)


def _header(name: str, shape: Shape) -> str:
    if shape.fields is None:
        return name
    return f"{name}{{{','.join(_header(n, s) for n, s in shape.fields)}}}"


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _cut(text: str, width: int) -> str:
    text = text.replace("\n", " ")
    if _width(text) <= width:
        return text
    while _width(text) > width - 1:
        text = text[:-1]
    return f"{text}…"


def _aligned(cells: list[str], values: list[Any]) -> list[str]:
    """Integers to the right, decimals on the point, others to the left."""
    real = [v for v in values if v is not None]
    if real and all(isinstance(v, (float, decimal.Decimal)) for v in real):
        tails = [len(c.partition(".")[2]) for c in cells]
        cells = [c + " " * (max(tails) - t) for c, t in zip(cells, tails, strict=True)]
    width = max(map(_width, cells), default=0)
    right = real and all(isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) for v in real)
    return [" " * (width - _width(c)) + c if right else c + " " * (width - _width(c)) for c in cells]


def text_table(result: Any, rows: int = 30, width: int = 100) -> str:
    """At most so many rows; a torn table ends in a row of dots."""
    shape = result.shape
    found = result.ordered.limit(rows + 1).collect()
    torn, found = len(found) > rows, found[:rows]
    if not found:
        return "(empty)"
    from ..sources.db import _python

    fields = shape.fields if shape.fields is not None else ((shape.label or "", shape),)
    heads = [_header(n or ordinal(k), s) if shape.fields is not None else n for k, (n, s) in enumerate(fields)]
    values = [[_python(r[k]) for r in found] for k in range(len(fields))]
    number = [str(k + 1) for k in range(len(found))] if result.plural else [""] * len(found)
    columns = []
    for head, column in zip(heads, values, strict=True):
        body = _aligned([_cut(_cell(v), width) for v in column], column)
        size = max(_width(head), max(map(_width, body)))
        head = _cut(head, size)
        columns.append([head + " " * (size - _width(head)), *[" " * (size - _width(c)) + c if c[:1] == " " else c + " " * (size - _width(c)) for c in body]])
    side = max(map(len, number))
    lead = [" " * side, *[n.rjust(side) for n in number]]
    lines = [f"{a} │ {'  '.join(c[k] for c in columns)} │" for k, a in enumerate(lead)]
    rule = f"{'─' * (side + 1)}┼{'─' * (len(lines[0]) - side - 3)}┼"
    out = [lines[0], rule, *lines[1:]] if any(heads) else [rule, *lines[1:]]
    if torn:
        out.append(f"{'⋮'.rjust(side)}")
    width = max(width, side + 8)
    return "\n".join(_cut(line, width).rstrip() for line in out)
