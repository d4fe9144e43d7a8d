"""Queries as values: a tree of named operators, built with Python expressions.

    It.department >> Filter(Count(It.employee) > 3) >> Record(It.name, size=Count(It.employee))

`>>` composes; comparison binds weaker than `>>`, so conditions stand in parentheses. `&`, `|` and `~` are the logical
operators; `and`, `or` and chained comparisons raise, because a query has no truth value.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class QueryError(Exception):
    """A query that does not fit the data it is asked of."""


class Query:
    """An operator and its arguments; arguments are queries or plain values."""

    __slots__ = ("args", "op")

    def __init__(self, op: str, *args: Any):
        object.__setattr__(self, "op", op)
        object.__setattr__(self, "args", args)

    def __setattr__(self, name, value):
        raise AttributeError("queries do not change")

    def __getattr__(self, name: str) -> Query:
        if name.startswith("__"):
            raise AttributeError(name)
        return self >> Get(name)

    def __getitem__(self, name: str) -> Query:
        return self >> Get(name)

    def __rshift__(self, other: Any) -> Query:
        other = as_query(other)
        out = self
        for part in other.args if other.op == "compose" else (other,):
            if part.op == "apply":  # what stands before is its argument
                out = as_query(part.args[0](out, *part.args[1:]))
            else:
                out = Query("compose", *(out.args if out.op == "compose" else (out,)), part)
        return out

    def __rrshift__(self, other: Any) -> Query:
        return as_query(other) >> self

    def __bool__(self):
        raise TypeError("a query has no truth value: write & | ~ and parentheses")

    def __hash__(self):
        return id(self)

    def __repr__(self) -> str:
        return shown(self)

    def __invert__(self) -> Query:
        return Lift("!", self)

    def __neg__(self) -> Query:
        return Lift("-", self)


def _binary(sign: str, turned: bool = False) -> Callable[[Query, Any], Query]:
    if turned:
        return lambda self, other: Lift(sign, other, self)
    return lambda self, other: Lift(sign, self, other)


for _name, _sign in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "div", "mod": "%", "pow": "^", "and": "&", "or": "|"}.items():
    setattr(Query, f"__{_name}__", _binary(_sign))
    setattr(Query, f"__r{_name}__", _binary(_sign, True))
for _name, _sign in {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Query, f"__{_name}__", _binary(_sign))


def as_query(x: Any) -> Query:
    """x as a query: queries and (label, query) pairs as they are, an aggregate's bare name as its form without an
    argument, other values as constants."""
    if isinstance(x, Query):
        return x
    if isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], str) and isinstance(x[1], Query):
        return Label(x[0], x[1])
    if getattr(x, "bare", None):
        return x()
    if hasattr(x, "as_knot"):  # a result: data that a query starts from
        return Query("knot", x)
    return Query("const", x)


def _fields(args: tuple, named: dict) -> list[Query]:
    return [*map(as_query, args), *(Query("remove", k) if v is None else Label(k, v) for k, v in named.items())]


It = Query("it")


def Get(name: str | int) -> Query:
    """The field or parameter of that name."""
    return Query("get", name)


def Label(name: str, x: Any = None) -> Query:
    """x, or what comes before, under another label."""
    return Query("label", name) if x is None else Query("compose", as_query(x), Query("label", name)) if as_query(x).op != "compose" else as_query(x) >> Query("label", name)


#: Functions of the table that need no argument.
ZERO = {"rand"}


def Lift(fn: Any, *args: Any, card: str | None = None) -> Query:
    """A function (a name of the function table, or a Python callable) of queries; without one, a constant. A list is
    a plural constant, whose cardinality may be declared; None has no element. The name of a function that needs no
    argument is that function."""
    if isinstance(fn, str) and (args or fn in ZERO) or callable(fn) and not isinstance(fn, Query):
        return Query("lift", fn, *map(as_query, args))
    return Query("const", fn, card) if card else as_query(fn)


def Record(*args: Any, **named: Any) -> Query:
    return Query("record", *_fields(args, named))


def Collect(*args: Any, **named: Any) -> Query:
    """Adds fields, replaces those of the same label, removes those given as None; without arguments, adds the whole
    flow to the source record."""
    return Query("collect", *_fields(args, named)) if args or named else Query("collect_source")


Collect.bare = True


def Mix(*args: Any, **named: Any) -> Query:
    return Query("mix", *_fields(args, named))


def Join(x: Any = None, **named: Any) -> Query:
    return Query("join", *_fields(() if x is None else (x,), named))


def Each(x: Any) -> Query:
    return Query("each", as_query(x))


def Filter(x: Any) -> Query:
    return Query("filter", as_query(x))


def Keep(*args: Any, **named: Any) -> Query:
    return Query("keep", *_fields(args, named))


def Given(*args: Any, **named: Any) -> Query:
    """Given(("a", X), ..., Q): Q, in which a is the value of X."""
    *values, body = args
    return Query("given", as_query(body), *_fields(tuple(values), named))


Let = Given


def Tag(name: str, *args: Any) -> Query:
    """Tag(name, X): X, printed as name. Tag(name, (a, b), X): X, printed as name(a, b)."""
    *shown_args, x = args
    if shown_args:
        name = f"{name}({', '.join(shown(as_query(a)) for a in shown_args[0])})"
    return Query("tag", as_query(x), name)


def Then(build: Callable[..., Any], *args: Any) -> Query:
    """X >> Then(build, a) is build(X, a): a step of the user's own, made of other queries."""
    return Query("apply", build, *args)


def Sort(*keys: Any) -> Query:
    return Query("sort", *map(as_query, keys))


def Group(*keys: Any, **named: Any) -> Query:
    return Query("group", *_fields(keys, named))


def Desc(key: Any) -> Query:
    """A key of Sort in falling order."""
    return Query("desc", as_query(key))


def _aggregate(op: str) -> Callable[..., Query]:
    def build(x: Any = None) -> Query:
        return Query("then", op) if x is None else Query("agg", op, as_query(x))

    build.bare, build.__name__ = True, op.capitalize()
    build.__doc__ = f"{op} of a query's elements, or of the whole flow before it."
    return build


Count, Exists, Sum, Max, Min, Mean, First, Last, Unique = map(_aggregate, ("count", "exists", "sum", "max", "min", "mean", "first", "last", "unique"))
Is0to1, Is1to1, Is0toN, Is1toN = map(_aggregate, ("is0to1", "is1to1", "is0toN", "is1toN"))


def Nth(*args: Any) -> Query:
    """Nth(X, n) or X >> Nth(n): the n-th element, from the end for negative n."""
    return Query("then", "nth", as_query(args[0])) if len(args) == 1 else Query("agg", "nth", as_query(args[0]), as_query(args[1]))


def Take(n: Any) -> Query:
    return Query("take", as_query(n))


def Drop(n: Any) -> Query:
    return Query("drop", as_query(n))


def Is(kind: str) -> Query:
    """What comes before, of which every element must have this type (a name of Spark's types, or record)."""
    return Query("is", kind)


_SIGNS = {"+", "-", "*", "/", "div", "%", "^", "&", "|", "==", "!=", "<", "<=", ">", ">="}
_NAMES = {"is0to1": "Is0to1", "is1to1": "Is1to1", "is0toN": "Is0toN", "is1toN": "Is1toN"}


def shown(q: Any) -> str:
    """The expression that builds a query."""
    if not isinstance(q, Query):
        return repr(q)
    op, args = q.op, q.args
    if op == "it":
        return "It"
    if op == "get":
        return f"Get({args[0]!r})"
    if op == "const":
        return f"Lift({args[0]!r})" if len(args) == 1 or not args[1] else f"Lift({args[0]!r}, card={args[1]!r})"
    if op == "lift":
        name = args[0] if isinstance(args[0], str) else getattr(args[0], "__name__", "function")
        if name in _SIGNS and len(args) == 3:
            return f"({_inner(args[1])} {name} {_inner(args[2])})"
        return f"Lift({name!r}{''.join(f', {shown(a)}' for a in args[1:])})"
    if op == "compose":
        out = ""
        for k, a in enumerate(args):
            if a.op == "get" and isinstance(a.args[0], str) and a.args[0].isidentifier() and (k == 0 or args[k - 1].op in ("it", "get")):
                out += f".{a.args[0]}" if k else f"It.{a.args[0]}"
            else:
                out += f" >> {shown(a)}" if k else shown(a)
        return out
    if op == "label":
        return f"Label({args[0]!r})"
    if op == "remove":
        return f"{args[0]}=None"
    if op == "tag":
        return args[1]
    if op == "knot":
        return "<result>"
    if op == "apply":
        return f"Then({getattr(args[0], '__name__', 'function')}{''.join(f', {shown(a)}' for a in args[1:])})"
    if op in ("then", "agg"):
        return f"{_NAMES.get(args[0], args[0].capitalize())}{'' if op == 'then' and len(args) == 1 else f'({", ".join(map(shown, args[1:]))})'}"
    if op == "given":
        return f"Given({', '.join(map(shown, [*args[1:], args[0]]))})"
    return f"{op.replace('_source', '').capitalize()}({', '.join(map(shown, args))})"


def _inner(q: Any) -> str:
    return repr(q.args[0]) if isinstance(q, Query) and q.op == "const" and len(q.args) == 1 else f"({shown(q)})" if isinstance(q, Query) and q.op == "compose" and " >> " in shown(q) else shown(q)
