"""The function table: what a name means over Spark columns, and the type of its result.

A function of one plural argument may have an aggregate of the same name; array functions take plural arguments as
arrays. Python callables are lifted too: over columns if they give a column, else as UDFs with a declared type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, TEXT, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


@dataclass(frozen=True)
class Function:
    build: Callable[..., Column]
    #: The result's type: itself, or a function of the arguments' types.
    result: T.DataType | Callable[..., T.DataType | None]
    #: The result may be absent although no argument is.
    partial: bool = False
    #: Takes plural arguments as arrays.
    arrays: bool = False


def _wider(*kinds: T.DataType | None) -> T.DataType | None:
    if None in kinds:
        return None
    if any(isinstance(k, T.StringType) for k in kinds):
        return TEXT
    for k in kinds:
        if isinstance(k, T.FractionalType):
            return k if isinstance(k, T.DecimalType) else DOUBLE
    return LONG if all(isinstance(k, T.IntegralType) for k in kinds) else kinds[0]


def _whole(c: Column, kind: T.DataType | None) -> Column:
    return c.cast("bigint") if isinstance(kind, T.IntegralType) and not isinstance(kind, T.LongType) else c


def _titlecase(c: Column) -> Column:
    """Each run of letters with one capital in front: words end at any other character."""
    cut = F.regexp_replace(F.lower(c), r"(\p{L}+)", "\u0001$1\u0001")
    parts = F.transform(F.split(cut, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.array_join(parts, "")


def _range(a: Column, b: Column) -> Column:
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


FUNCTIONS: dict[str, Function] = {
    "/": Function(lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), DOUBLE, partial=True),
    "%": Function(lambda a, b: a % b, _wider),
    "==": Function(lambda a, b: a == b, BOOL),
    "!=": Function(lambda a, b: a != b, BOOL),
    "<": Function(lambda a, b: a < b, BOOL),
    "<=": Function(lambda a, b: a <= b, BOOL),
    ">": Function(lambda a, b: a > b, BOOL),
    ">=": Function(lambda a, b: a >= b, BOOL),
    "&": Function(lambda a, b: a & b, BOOL),
    "|": Function(lambda a, b: a | b, BOOL),
    "!": Function(lambda a: ~a, BOOL),
    "sqrt": Function(lambda a: F.sqrt(a), DOUBLE),
    "abs": Function(lambda a: F.abs(a), lambda k: k),
    "string": Function(lambda a: a.cast("string"), TEXT),
    "uppercase": Function(F.upper, TEXT),
    "lowercase": Function(F.lower, TEXT),
    "titlecase": Function(_titlecase, TEXT),
    "strip": Function(F.trim, TEXT),
    "startswith": Function(lambda a, b: F.startswith(a, b), BOOL),
    "endswith": Function(lambda a, b: F.endswith(a, b), BOOL),
    "contains": Function(lambda a, b: F.contains(a, b), BOOL),
    "replace": Function(lambda a, b, c: F.replace(a, b, c), TEXT),
    "split": Function(lambda a, b: F.split(a, F.concat(F.lit(r"\Q"), b, F.lit(r"\E"))), T.ArrayType(TEXT)),
    "length": Function(lambda a: F.length(a).cast("bigint"), LONG),
    "isodd": Function(lambda a: a % 2 != 0, BOOL),
    "iseven": Function(lambda a: a % 2 == 0, BOOL),
    "trunc": Function(lambda a: a.cast("bigint"), LONG),
    "int": Function(lambda a: a.cast("bigint"), LONG),
    "float": Function(lambda a: a.cast("double"), DOUBLE),
    "char": Function(lambda a: F.chr(a), TEXT),
    "range": Function(_range, T.ArrayType(LONG)),
    "rand": Function(lambda seed=None: F.rand(), DOUBLE),
    "year": Function(lambda a: F.year(a).cast("bigint"), LONG),
    "month": Function(lambda a: F.month(a).cast("bigint"), LONG),
    "date": Function(lambda a: a.cast("date"), T.DateType()),
    "ismissing": Function(lambda a: a.isNull(), BOOL),
    "coalesce": Function(lambda *a: F.coalesce(*a), _wider),
    "in": Function(lambda a, xs: F.array_contains(xs, a), BOOL, arrays=True),
    "parse_map": Function(lambda a: F.from_json(a, "map<string,bigint>"), T.MapType(TEXT, LONG), partial=True),
}


#: Names that are built with the arguments' types: name -> build(columns, types) -> (column, type).
TYPED: dict[str, Callable] = {}


def _plus(cols, kinds):
    return _whole(cols[0], kinds[0]) + _whole(cols[1], kinds[1]), _wider(*kinds)


def _times(cols, kinds):
    if all(isinstance(k, T.StringType) for k in kinds):
        return F.concat(*cols), TEXT
    return _whole(cols[0], kinds[0]) * _whole(cols[1], kinds[1]), _wider(*kinds)


def _minus(cols, kinds):
    first = _whole(cols[0], kinds[0])
    return (-first if len(cols) == 1 else first - _whole(cols[1], kinds[1])), _wider(*kinds)


def _div(cols, kinds):
    a, b = (c.cast("bigint") for c in cols)
    return F.call_function("div", a, b), LONG


def _pow(cols, kinds):
    whole = all(isinstance(k, T.IntegralType) for k in kinds)
    return (F.pow(*cols).cast("bigint"), LONG) if whole else (F.pow(*cols), DOUBLE)


def _round(cols, kinds):
    if len(cols) == 2:
        return F.bround(cols[0], cols[1]), kinds[0]
    return (F.rint(cols[0]), DOUBLE) if not isinstance(kinds[0], T.IntegralType) else (cols[0], kinds[0])


TYPED |= {"+": _plus, "*": _times, "-": _minus, "div": _div, "÷": _div, "^": _pow, "round": _round}

#: Names that mean an aggregate when their one argument is plural.
AGGREGATES = {"mean": "mean", "sum": "sum", "length": "count", "count": "count", "maximum": "max", "minimum": "min", "first": "first", "last": "last"}


@dataclass(frozen=True)
class Udf:
    """A Python function registered under a name: over rows, or (aggregate) over a pandas Series of a flow."""

    call: Callable
    kind: T.DataType
    aggregate: bool = False


REGISTERED: dict[str, Udf] = {}


def register(name: str, call: Callable, kind: str, aggregate: bool = False) -> None:
    """Makes a Python function known to queries by its name. kind: Spark's name of the result's type. Row functions
    get pandas Series and give one (Arrow batches); aggregates get a Series and give one value."""
    REGISTERED[name] = Udf(F.pandas_udf(call, kind), T._parse_datatype_string(kind), aggregate)
