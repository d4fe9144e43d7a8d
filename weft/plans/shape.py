"""Shapes: the static description of values, with cardinalities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


class Card(int):
    """Bit 0: may be absent; bit 1: may be many. `|` is the bound of a composition."""

    NAMES = ("1:1", "0:1", "1:N", "0:N")

    def __repr__(self) -> str:
        return self.NAMES[self]

    def __or__(self, other: int) -> Card:
        return Card(int(self) | int(other))

    def fits(self, other: int) -> bool:
        return int(self) | int(other) == int(other)


ONE, OPT, SOME, MANY = map(Card, range(4))
CARDS = {"x1to1": ONE, "x0to1": OPT, "x1toN": SOME, "x0toN": MANY, "1:1": ONE, "0:1": OPT, "1:N": SOME, "0:N": MANY}


@dataclass(frozen=True)
class Shape:
    """A value's card and type: a Spark type, or fields of a record; an opaque type is None."""

    card: Card
    type: T.DataType | None = None
    fields: tuple[tuple[str, Shape], ...] | None = None
    label: str | None = field(default=None, compare=False)

    def fits(self, other: Shape) -> bool:
        """Whether every value of this shape is one of the other: cards by their bits, labels where the other has some."""
        if not self.card.fits(other.card) or (other.label and other.label != self.label):
            return False
        if other.fields is None:
            return self.fields is None and (other.type is None or self.type == other.type)
        if self.fields is None or len(self.fields) != len(other.fields):
            return False
        return all((a == b or b.startswith("#")) and x.fits(y) for (a, x), (b, y) in zip(self.fields, other.fields, strict=True))

    def tree(self, name: str = "#", indent: str = "", last: bool | None = None) -> str:
        kind = "" if self.fields is not None else f" × {name_of(self.type)}"
        lead = "" if last is None else indent + ("└╴" if last else "├╴")
        rows = [f"{lead}{name or '#'}  {self.card!r}{kind}"]
        inner = "" if last is None else indent + ("  " if last else "│ ")
        for k, (label, shape) in enumerate(self.fields or ()):
            rows.append(shape.tree(label, inner, k == len(self.fields) - 1))
        return "\n".join(rows)


def name_of(kind: T.DataType | None) -> str:
    return "any" if kind is None else kind.simpleString()


def ordinal(k: int) -> str:
    """#A, #B, ... of the k-th field."""
    out = ""
    while True:
        out, k = chr(65 + k % 26) + out, k // 26
        if not k:
            return f"#{out}"
