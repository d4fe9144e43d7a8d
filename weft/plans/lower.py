"""From queries to DataFrames.

A query is evaluated step by step against a state, one of

    One   a value of the current row: a column, a record of values, or the data set
    Many  a collection inside the row: an array column and what each element means
    Flow  a collection that is a DataFrame: its rows are the elements

Inside a row everything is an expression (higher-order functions over arrays), so nested data never shuffles. A flow
that a row reaches (another table, the members of its group) is linked to the row's frame by columns; its aggregates
are computed by those columns and joined back, so that rows without any element keep their zero. What a flow needs of
the row it starts from is first turned into such links: an equality with a column of the flow is one itself, any
other use goes over the distinct values that are used.

A group stays a description until its frame is read: aggregates of its members are added to one groupBy, and going
back to the members makes them window columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import AGGREGATES, BOOL, DOUBLE, FUNCTIONS, LONG, REGISTERED, TYPED
from ..operators.query import Query, QueryError, as_query
from .once import drifts, once, one_row
from .shape import CARDS, MANY, ONE, OPT, SOME, Card, Shape, ordinal

_count = itertools.count()


def fresh(stem: str = "c") -> str:
    return f"{stem}_{next(_count)}"


# ---------------------------------------------------------------- values


@dataclass(frozen=True)
class One:
    """A value of the row. opt: may be null, which means absent. fields: of a record; col is then its presence."""

    col: Column | None = None
    type: T.DataType | None = None
    opt: bool = False
    fields: tuple[tuple[str | None, Any], ...] | None = None
    label: str | None = None
    #: Reaches the data set's tables by name.
    root: Any = None
    #: Depends on nothing but itself.
    const: bool = False
    #: The number that a constant was given as.
    literal: int | None = None

    @property
    def present(self) -> Column:
        return F.lit(True) if not self.opt else self.col.isNotNull()


@dataclass(frozen=True)
class Many:
    """An array of the row; of(x) is (element, context) for an element x of the array."""

    col: Column
    of: Callable[[Column], tuple[Any, dict]]
    some: bool = False
    label: str | None = None


@dataclass(frozen=True)
class Table:
    """A collection of the row that is a DataFrame; open(frame, ctx) is its flow, linked to the frame."""

    open: Callable[[Frame | None, dict], Flow]
    label: str | None = None


@dataclass
class Pending:
    """Aggregates of one flow that are not yet computed: its rows, its links, and names of columns that other lookups
    of the same rows gave."""

    df: DataFrame
    links: list[tuple[Column, str, bool]]
    python: bool
    some: list[tuple[str, Column]]
    names: dict[str, str]

    def joins(self, df: DataFrame, links: list[tuple[Column, str, bool]], python: bool) -> bool:
        """Whether aggregates of that flow can be computed along with these."""
        if self.python != python or len(links) != len(self.links):
            return False
        if df is self.df:
            return all(a[0] is b[0] and a[1:] == b[1:] for a, b in zip(links, self.links, strict=True))
        if links or len(df.columns) != len(self.df.columns) or not df.sameSemantics(self.df):
            return False
        self.names.update(zip(df.columns, self.df.columns, strict=True))
        return True

    def computed(self) -> DataFrame:
        df = self.df.select("*", *[F.col(own).alias(other) for other, own in self.names.items() if other != own])
        return df.groupBy(*[F.col(n) for _, n, _ in self.links]).agg(*[a.alias(n) for n, a in self.some])


class Frame:
    """Rows that columns can be added to. Aggregates of flows that are linked to them wait until the rows are read, so
    that all of one flow are one pass over it. single: the one row that a whole query starts from."""

    def __init__(self, df: DataFrame, single: bool = False):
        self._df, self._pending, self.single = df, [], single
        self._numbered: dict[tuple, tuple[DataFrame, str, str, DataFrame]] = {}
        self._narrowed: list[tuple[DataFrame, DataFrame, Frame]] = []

    @property
    def df(self) -> DataFrame:
        while self._pending:
            p = self._pending.pop(0)
            self._join(p.computed(), p.links)
        return self._df

    def settled(self, columns: list[Column]) -> DataFrame:
        """The rows, for a plan that reads them twice and has these columns meet: where reading may change their values,
        the rows are written once."""
        df = self.df
        if drifts(df.select(*columns)):
            self._df = once(df)
        return self._df

    def join(self, other: DataFrame, on: list[tuple[Column, str, bool]]) -> None:
        """Adds the columns of a table that has at most one row for each value of its links."""
        self._df = self.df
        self._join(other, on)

    def _join(self, other: DataFrame, on: list[tuple[Column, str, bool]]) -> None:
        own = [(outer, fresh("on"), nulls) for outer, _, nulls in on]
        for (_, name, _), (_, inner, _) in zip(own, on, strict=True):
            other = other.withColumnRenamed(inner, name)
        self._df = joined(self._df, other, own, "left").drop(*[n for _, n, _ in own])

    def aggregate(self, df: DataFrame, on: list[tuple[Column, str, bool]], aggregate: Column, python: bool = False) -> str:
        """Adds an aggregate of the rows of df by the links, when the frame is read; the name of its column."""
        found = next((p for p in self._pending if p.joins(df, on, python)), None)
        if found is None:
            self._pending.append(found := Pending(df, on, python, [], {}))
        found.some.append((name := fresh("agg"), aggregate))
        return name

    def numbered(self, flow: Flow) -> tuple[DataFrame, str, str]:
        """The rows of a flow over this frame with their places among those of the same links, and how many there are;
        one window for all that ask for places of one order."""
        df, names = self.df, tuple(n for _, n, _ in flow.links)
        key = (id(df), names, tuple(c if isinstance(c, str) else c._jc.toString() for c in flow.order))
        if key not in self._numbered:
            by = Window.partitionBy(*[F.col(n) for n in names])
            made = df.withColumn(a := fresh(), F.row_number().over(by.orderBy(*ordering(flow)))).withColumn(b := fresh(), F.count("*").over(by))
            self._numbered[key] = made, a, b, df
        return self._numbered[key][:3]

    def where(self, condition: Column) -> Frame:
        """The rows for which a condition holds; asked again, the same frame."""
        own = self.df
        df = own.where(condition)
        for base, made, frame in self._narrowed:
            if base is own and made.sameSemantics(df):
                return frame
        self._narrowed.append((own, df, frame := Frame(df)))
        return frame


class Grouped(Frame):
    """The groups of a flow: aggregates are added until the frame is read."""

    def __init__(self, base: Flow, keys: list[str], some: list, conditions: tuple = ()):
        super().__init__(None)
        self.base, self.names, self.some, self.conditions = base, keys, some, conditions

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            aggregates = [a.alias(n) for n, a in self.some] or [F.count("*").alias(fresh())]
            groups = self.base.df.groupBy(*self.names) if self.names else self.base.df
            df = groups.agg(*aggregates) if self.names else groups.agg(F.count("*").alias(n := fresh()), *aggregates).where(F.col(n) > 0)
            for c in self.conditions:
                df = df.where(c)
            self._df = df
        return super().df

    @property
    def still_open(self) -> bool:
        return self._df is None and not self._pending

    def where(self, condition: Column) -> Frame:
        return Grouped(self.base, self.names, self.some, (*self.conditions, condition)) if self.still_open else Frame(self.df.where(condition))

    def add(self, aggregate: Column) -> str:
        self.some.append((name := fresh("agg"), aggregate))
        return name


def joined(left: DataFrame, right: DataFrame, on: list[tuple[Column, str, bool]], how: str) -> DataFrame:
    if not on:
        return left.crossJoin(right) if how in ("inner", "left") else left.join(right, how=how)
    condition = F.lit(True)
    for k, (outer, inner, nulls) in enumerate(on):
        same = outer.eqNullSafe(F.col(inner)) if nulls else outer == F.col(inner)
        condition = same if not k else condition & same
    return left.join(right, condition, how)


@dataclass(frozen=True)
class Beyond:
    """own sign outer: a column of the flow against a value of the outer row; over_values() makes links of it, which
    costs all pairs of rows and distinct values."""

    own: str
    sign: str
    outer: Column
    over_values: Callable[[Flow], Flow]


@dataclass(frozen=True)
class Flow:
    """Rows of a frame as elements. order: columns; links: (column of the outer frame, own column, whether nulls meet);
    foreign: names of the context that are still the outer frame's."""

    frame: Frame
    val: Any
    ctx: dict
    order: tuple = ()
    links: tuple = ()
    outer: Frame | None = None
    foreign: frozenset = frozenset()
    #: Of the members of a group: its frame's aggregates.
    group: list | None = None
    #: Conditions that are not yet applied: of a group's members, and that a value is there. An aggregate takes them up,
    #: so that aggregates of one flow's different values are one pass.
    conditions: tuple = ()
    some: bool = False
    sorted: bool = False
    #: An inequality with a value of the outer row that is not yet a link.
    beyond: Beyond | None = None

    @property
    def df(self) -> DataFrame:
        return self.frame.df

    def plain(self) -> Flow:
        """With its conditions applied."""
        if self.beyond is not None:
            return self.beyond.over_values(replace(self, beyond=None)).plain()
        if self.group is None and not self.conditions:
            return self
        frame = self.frame
        for c in self.conditions:
            frame = frame.where(c)
        return replace(self, frame=frame, group=None, conditions=())


# ---------------------------------------------------------------- packing


def pack(v: Any, frame: Frame | None = None) -> Column:
    """A value as one column, records as structs of f0, f1, ..."""
    if isinstance(v, Many):
        probe, _ = v.of(F.lit(None))
        if isinstance(probe, One) and probe.fields is None and _same(probe):
            return v.col
        return F.transform(v.col, lambda x: pack(v.of(x)[0]))
    if isinstance(v, Table):
        if frame is None:
            raise QueryError("a table cannot be reached from inside an array")
        return pack(nested(v.open(frame, {})), frame)
    if v.root is not None:
        raise QueryError("the data set itself is not a value")
    if v.fields is None:
        return v.col
    body = F.struct(*[pack(f, frame).alias(f"f{k}") for k, (_, f) in enumerate(v.fields)]) if v.fields else F.struct(F.lit(True).alias("f0"))
    return F.when(v.col.isNotNull(), body) if v.opt else body


def _same(v: One) -> bool:
    """Whether an element is the array's own (told by a probe of null)."""
    return v.col is not None and v.col._jc.toString() == F.lit(None)._jc.toString()


def view(v: Any, col: Column) -> Any:
    """The value that pack(v) put into col."""
    if isinstance(v, Table):
        raise QueryError("a table cannot be carried inside an array")
    if isinstance(v, Many):
        probe = v.of(F.lit(None))[0]
        return Many(col, lambda x: (view(probe, x), {}), v.some, v.label)
    if v.fields is None or v.root is not None:
        return v if v.root is not None else replace(v, col=col, const=False, literal=None)
    return replace(v, col=col, fields=tuple((n, view(f, col.getField(f"f{k}"))) for k, (n, f) in enumerate(v.fields)))


def typed(col: Column, kind: T.DataType, opt: bool, label: str | None = None) -> Any:
    """What a column of a type means: arrays are collections, structs are records."""
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        array = F.filter(col, lambda x: x.isNotNull()) if kind.containsNull else col
        if opt:
            array = F.coalesce(array, F.array().cast(kind))
        return Many(array, lambda x: (typed(x, inner, False), {}), label=label)
    if isinstance(kind, T.StructType):
        fields = tuple((f.name, typed(col.getField(f.name), f.dataType, f.nullable or opt, f.name)) for f in kind.fields)
        return One(col, kind, opt, fields, label)
    return One(col, kind, opt, label=label)


def optional(v: Any, when: Column) -> Any:
    """v where the condition holds, else nothing."""
    if isinstance(v, Many):
        return replace(v, col=F.when(when, v.col).otherwise(F.filter(v.col, lambda x: F.lit(False))), some=False)
    if isinstance(v, Table):
        raise QueryError("a table of an absent value")
    if v.fields is not None:
        presence = F.when(when & v.present, F.lit(True))
        return replace(v, col=presence, opt=True, fields=tuple((n, f if isinstance(f, Table) else optional(f, when)) for n, f in v.fields))
    return replace(v, col=F.when(when, v.col), opt=True)


def relabel(v: Any, label: str | None) -> Any:
    return replace(v, label=label)


def shape(v: Any) -> Shape:
    """The shape of a value or a flow."""
    if isinstance(v, Flow):
        inner = shape(v.val)
        return replace(inner, card=inner.card | (SOME if v.some else MANY))
    if isinstance(v, Many):
        inner = shape(v.of(F.lit(None))[0])
        return replace(inner, card=inner.card | (SOME if v.some else MANY), label=v.label)
    if isinstance(v, Table):
        return Shape(MANY, None, v.open(None, {}).val.fields and shape(v.open(None, {}).val).fields, v.label)
    if v.root is not None:
        return Shape(ONE, None, tuple((n, Shape(MANY, None, (), n)) for n in v.root.names()))
    card = OPT if v.opt else ONE
    if v.fields is not None:
        return Shape(card, None, tuple((n or ordinal(k), shape(f)) for k, (n, f) in enumerate(v.fields)), v.label)
    return Shape(card, v.type, None, v.label)


# ---------------------------------------------------------------- evaluation


@dataclass(frozen=True)
class State:
    """What the steps so far made of the source; ctx is that of a single value (collections carry their own)."""

    val: Any
    ctx: dict = field(default_factory=dict)


def evaluate(q: Query, source: Any, ctx: dict, frame: Frame | None) -> Any:
    """q at one row: a barrier, so aggregates in q are relative to `source`."""
    state = State(source, ctx)
    for part in q.args if q.op == "compose" else (q,):
        state = apply(part, state, source, ctx, frame)
    if isinstance(state.val, Many):
        inner = state.val.of
        return replace(state.val, of=lambda x: (inner(x)[0], {}))
    return state.val


FLOW_STEPS = {"then", "take", "drop", "sort", "group", "collect_source", "is"}


def apply(q: Query, state: State, source: Any, ctx: dict, frame: Frame | None) -> State:
    v = state.val
    if q.op == "compose":
        for part in q.args:
            state = apply(part, state, source, ctx, frame)
        return state
    if q.op == "tag":
        return apply(q.args[0], state, source, ctx, frame)
    if q.op == "agg" and q.args[0].startswith("is"):  # X >> Is1to1
        return apply(Query("then", q.args[0]), apply(q.args[1], state, source, ctx, frame), source, ctx, frame)
    if q.op == "label":
        return State(relabel(v, q.args[0]) if not isinstance(v, Flow) else replace(v, val=relabel(v.val, q.args[0])), state.ctx)
    if isinstance(v, Flow):
        if q.op != "filter":  # a filter makes links of what it needs
            v = local(v, names_of(q))
        return State(flow_step(q, v, source, ctx, frame), {}) if q.op in FLOW_STEPS else State(each_row(q, v, source), {})
    if q.op in FLOW_STEPS:
        return inline_step(q, state, source, ctx, frame)
    if isinstance(v, Many):
        return State(each_element(q, v, source), {})
    out, more = step(q, v, state.ctx, source, frame)
    if isinstance(out, Many):
        out = within(out, more)
    if v.opt and q.op != "it" and not isinstance(out, Flow):
        out = optional(out, v.present)
    return State(out, more)


def within(many: Many, ctx: dict) -> Many:
    """The collection, whose elements see that context."""
    if not ctx:
        return many

    def of(x: Column) -> tuple[Any, dict]:
        v, own = many.of(x)
        return v, {**ctx, **own}

    return replace(many, of=of)


def each_element(q: Query, v: Many, source: Any) -> Many:
    """A step of every element of an array."""
    probe, probe_ctx = step(q, *v.of(F.lit(None)), source, None)
    if isinstance(probe, (Table, Flow)):
        raise QueryError("a table cannot be reached from inside an array")

    def of(x: Column) -> tuple[Any, dict]:
        return step(q, *v.of(x), source, None)

    if isinstance(probe, Many):
        inner, inner_ctx = within(probe, probe_ctx).of(F.lit(None))

        def elements(x: Column) -> Column:
            y = within(*of(x))
            return F.transform(y.col, lambda z: packed(y.of(z)))

        return Many(F.flatten(F.transform(v.col, elements)), lambda x: unpacked((inner, inner_ctx), x), v.some and probe.some, probe.label)
    label = probe.label
    if probe.opt:
        kept = F.filter(v.col, lambda x: of(x)[0].present)

        def sure(x: Column) -> tuple[Any, dict]:
            y, c = of(x)
            return replace(y, opt=False), c

        return Many(kept, sure, False, label)
    return Many(v.col, of, v.some, label)


def packed(pair: tuple[Any, dict]) -> Column:
    """An element with its context, as one column."""
    v, ctx = pair
    own = {n: c for n, c in ctx.items() if not getattr(c, "const", False)}
    return F.struct(pack(v).alias("v"), *[pack(c).alias(f"k{k}") for k, c in enumerate(own.values())])


def unpacked(model: tuple[Any, dict], col: Column) -> tuple[Any, dict]:
    v, ctx = model
    own = [n for n, c in ctx.items() if not getattr(c, "const", False)]
    return view(v, col.getField("v")), {n: view(c, col.getField(f"k{own.index(n)}")) if n in own else c for n, c in ctx.items()}


def step(q: Query, v: Any, ctx: dict, source: Any, frame: Frame | None) -> tuple[Any, dict]:
    """A step of one element: (result, context after it)."""
    op, args = q.op, q.args
    if op == "it":
        return v, ctx
    if op == "get":
        return lookup(args[0], v, ctx, frame), ctx
    if op == "const":
        return constant(*args), ctx
    if op == "knot":
        if frame is None:
            raise QueryError("a result cannot be reached from inside an array")
        found = args[0].as_knot(frame)
        return found.open(frame, ctx) if isinstance(found, Table) else found, ctx
    if op == "apply":
        raise QueryError("Then() stands after another query")
    if op == "lift":
        return lifted(args[0], args[1:], v, ctx, frame), ctx
    if op == "each":
        return settle(evaluate(args[0], v, ctx, frame), frame), ctx
    if op in ("compose", "tag", "label"):
        return evaluate(q, v, ctx, frame), ctx
    if op == "agg":
        return aggregate_of(args[0], evaluate(args[1], v, ctx, frame), args[2:], v, ctx, frame), ctx
    if op == "record":
        return record([evaluate(a, v, ctx, frame) for a in args], v.label if isinstance(v, One) else None), ctx
    if op == "collect":
        return collect(args, v, ctx, frame), ctx
    if op == "join":
        if len(args) != 1:
            raise QueryError("Join takes one argument")
        more = evaluate(args[0], source, ctx, frame)
        fields = [f for f in as_record(v).fields if f[0] != label_of(more)]
        return replace(as_record(v), fields=(*fields, (label_of(more), settle(more, frame)))), ctx
    if op == "mix":
        return mix([evaluate(a, v, ctx, frame) for a in args], v, ctx, frame), ctx
    if op == "filter":
        return optional(v, condition(evaluate(args[0], v, ctx, frame), frame)), ctx
    if op == "keep":
        return v, kept(args, v, ctx, frame)
    if op == "given":
        return settle(evaluate(args[0], v, kept(args[1:], v, ctx, frame), frame), frame), ctx
    raise QueryError(f"invalid query expression: {q!r}")


def label_of(v: Any) -> str | None:
    return v.val.label if isinstance(v, Flow) else v.label


def settle(v: Any, frame: Frame | None) -> Any:
    """A flow as a collection of the row that can be opened again."""
    if not isinstance(v, Flow):
        return v
    return Table(lambda outer, ctx: replace(v, outer=outer or v.outer), v.val.label)


def lookup(name: str | int, v: Any, ctx: dict, frame: Frame | None) -> Any:
    """A parameter of that name, else the last field; a name fits #name too, and then has no label."""
    if name in ctx:
        found = relabel(ctx[name], name)
        return found.open(frame, ctx) if isinstance(found, Table) else found
    if isinstance(v, One) and v.root is not None:
        if name in v.root.names():
            return v.root.flow(name, frame, ctx)
    elif isinstance(v, One) and isinstance(v.type, T.MapType) and isinstance(name, str):
        return typed(v.col.getItem(name), v.type.valueType, True, name)
    elif isinstance(v, One) and v.fields is not None:
        fields = [(n or ordinal(k), f) for k, (n, f) in enumerate(v.fields)]
        if isinstance(name, int) and 1 <= name <= len(fields):
            found = fields[name - 1][1]
        else:
            found = next((f for n, f in reversed(fields) if n == name), None)
            if found is None:
                found = next((relabel(f, None) for n, f in fields if n == f"#{name}"), None)
        if found is not None:
            return found.open(frame, ctx) if isinstance(found, Table) else found
    raise QueryError(f'cannot find "{name}" at\n{shape(v).tree()}')


def constant(value: Any, card: str | None = None) -> Any:
    if value is None:
        return One(F.lit(None), T.NullType(), True, const=True)
    if isinstance(value, (list, range)):
        items = [x for x in value if x is not None]
        kind = T._infer_type(items[0]) if items else LONG
        col = F.array(*[constant(x).col for x in items]) if items else F.array().cast("array<bigint>")
        if card and not (Card(MANY if not items else SOME if len(items) > 1 else ONE)).fits(CARDS[card]):
            raise QueryError(f"{value!r} is not {CARDS[card]!r}")
        out = Many(col, lambda x: (typed(x, kind, False), {}), bool(items) and CARDS.get(card or "x0toN") == SOME)
        return out if not card or CARDS[card] in (SOME, MANY) else aggregate_of("first", out, (), None, {}, None)
    if isinstance(value, dict):
        fields = tuple((k, constant(x)) for k, x in value.items())
        return One(F.lit(True), None, False, fields, const=True)
    if isinstance(value, tuple):
        return One(F.lit(True), None, False, tuple((None, constant(x)) for x in value), const=True)
    if isinstance(value, bool):
        return One(F.lit(value), BOOL, const=True)
    if isinstance(value, int):
        return One(F.lit(value).cast("bigint"), LONG, const=True, literal=value)
    if isinstance(value, Column):
        raise QueryError("a column is not a constant")
    return One(F.lit(value), T._infer_type(value), const=True)


def lifted(fn: Any, args: tuple, v: Any, ctx: dict, frame: Frame | None) -> Any:
    """A function of the arguments' values at an element."""
    vals = [evaluate(a, v, ctx, frame) for a in args]
    plural = [isinstance(x, (Many, Flow, Table)) for x in vals]
    udf = REGISTERED.get(fn) if isinstance(fn, str) else None
    if sum(plural) == len(vals) == 1 and isinstance(fn, str):
        if fn in AGGREGATES or (udf and udf.aggregate):
            return aggregate_of(AGGREGATES.get(fn, fn), vals[0], (), v, ctx, frame)
    known = FUNCTIONS.get(fn) if isinstance(fn, str) else None
    if any(plural):
        if not (known and known.arrays):
            raise QueryError(f"cannot apply {fn} to a collection")
        vals = [One(pack(settle(x, frame), frame), None) if p else x for x, p in zip(vals, plural, strict=True)]
    if any(x.fields is not None and x.type is None and x.root is None for x in vals) and not (udf or callable(fn)):
        raise QueryError(f"cannot apply {fn} to a record")
    cols, kinds = [x.col for x in vals], [x.type for x in vals]
    opt = any(x.opt for x in vals) and fn not in ("ismissing", "coalesce")
    const = bool(vals) and all(x.const for x in vals)
    if isinstance(fn, str) and fn in TYPED:
        col, kind = TYPED[fn](cols, kinds)
    elif known:
        col = known.build(*cols)
        kind = known.result(*kinds) if callable(known.result) and not isinstance(known.result, T.DataType) else known.result
        opt = opt or known.partial
        if fn == "coalesce":
            opt = all(x.opt for x in vals)
    elif udf:
        if frame is None:
            raise QueryError(f"{fn} is a Python function, which cannot run inside an array")
        col, kind, opt = udf.call(*cols), udf.kind, True
    elif callable(fn):
        col, kind = fn(*cols), None
        if not isinstance(col, Column):
            raise QueryError("a lifted callable gives a column; register() makes others known by a name")
        if frame is not None:
            kind, opt = frame.df.select(col.alias("x")).schema["x"].dataType, True
    else:
        raise QueryError(f"unknown function {fn}")
    if isinstance(kind, T.ArrayType):
        return typed(col, kind, opt)
    return One(col, kind, opt, const=const and fn != "rand")


def record(vals: list, label: str | None) -> One:
    """A record of values; of equal labels the last keeps it."""
    names = [label_of(x) for x in vals]
    fields = []
    for k, x in enumerate(vals):
        name = names[k] if names[k] and names[k] not in names[k + 1 :] else None
        fields.append((name, settle(x, None) if isinstance(x, Flow) else x))
    return One(F.lit(True), None, False, tuple((n, relabel(f, n)) for n, f in fields), label)


def as_record(v: Any) -> One:
    if not isinstance(v, One) or v.fields is None:
        raise QueryError("expected a record")
    return v


def collect(args: tuple, v: Any, ctx: dict, frame: Frame | None) -> One:
    out = as_record(v)
    for a in args:
        if a.op == "remove":
            out = replace(out, fields=tuple(f for f in out.fields if f[0] != a.args[0]))
            continue
        x = evaluate(a, out, ctx, frame)
        name, x = label_of(x), settle(x, frame)
        if isinstance(x, One) and x.opt and isinstance(x.type, T.NullType) and name:
            out = replace(out, fields=tuple(f for f in out.fields if f[0] != name))
        elif name and any(n == name for n, _ in out.fields):
            out = replace(out, fields=tuple((n, x) if n == name else (n, f) for n, f in out.fields))
        else:
            out = replace(out, fields=(*out.fields, (name, x)))
    return out


def kept(args: tuple, v: Any, ctx: dict, frame: Frame | None) -> dict:
    for a in args:
        x = evaluate(a, v, ctx, frame)
        if not (name := label_of(x)):
            raise QueryError("parameter name is not specified")
        ctx = {**ctx, name: settle(x, frame)}
    return ctx


def mix(vals: list, v: Any, ctx: dict, frame: Frame | None) -> Any:
    """All combinations of the values' elements, the first varying slowest."""
    if any(isinstance(x, (Flow, Table)) for x in vals):
        return _mixed_flow([settle(x, frame) for x in vals], v, ctx, frame)
    label = v.label if isinstance(v, One) else None
    arrays = [x if isinstance(x, Many) else _single(x) for x in vals]
    models = [a.of(F.lit(None))[0] for a in arrays]

    def combine(k: int, chosen: list[Column]) -> Column:
        if k == len(arrays):
            return F.array(F.struct(*[pack(a.of(x)[0]).alias(f"f{j}") for j, (a, x) in enumerate(zip(arrays, chosen, strict=True))]))
        return F.flatten(F.transform(arrays[k].col, lambda x: combine(k + 1, [*chosen, x])))

    model = record([relabel(m, label_of(x)) for m, x in zip(models, vals, strict=True)], label)
    return Many(combine(0, []), lambda x: (view(model, x), {}), label=label)


def _single(v: One) -> Many:
    """A single value as an array of one, or none."""
    sure = replace(v, opt=False)
    body = F.array(pack(sure))
    return Many(F.when(v.present, body).otherwise(F.filter(body, lambda x: F.lit(False))) if v.opt else body, lambda x: (view(sure, x), {}), label=v.label)


def condition(v: Any, frame: Frame | None, where: bool = False) -> Column:
    """Whether a predicate holds: any of its values is true. where: null may stand for false, as in a row filter, where
    a plain comparison can reach the scan."""
    if isinstance(v, (Flow, Table)):
        flow = v.open(frame, {}) if isinstance(v, Table) else v
        if not isinstance(flow.val.type, (T.BooleanType, type(None))):
            raise QueryError("expected a predicate")
        flow = narrowed(flow, flow.val.col)
        return aggregate_of("exists", flow, (), None, {}, frame).col
    if isinstance(v, Many):
        probe = v.of(F.lit(None))[0]
        if isinstance(probe, One) and isinstance(probe.type, T.BooleanType):
            return F.coalesce(F.exists(v.col, lambda x: v.of(x)[0].col), F.lit(False))
    elif isinstance(v.type, (T.BooleanType, T.NullType)) or (v.type is None and v.fields is None and v.root is None):
        col = v.col if isinstance(v.type, T.BooleanType) else v.col.cast("boolean")
        return F.coalesce(col, F.lit(False)) if v.opt and not where else col
    raise QueryError("expected a predicate")


# ---------------------------------------------------------------- aggregates


def _total(kind: T.DataType | None) -> Column:
    return F.lit(0.0) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.lit(0).cast("bigint")


def aggregate_of(op: str, v: Any, more: tuple, source: Any, ctx: dict, frame: Frame | None) -> Any:
    """An aggregate of a value's elements; more: the place for nth."""
    place = None
    if op == "nth":
        place = evaluate(as_query(more[0]), source, ctx, frame)
        if not isinstance(place, One) or place.opt or not isinstance(place.type, (T.IntegralType, type(None))):
            raise QueryError("expected a singular mandatory integer")
    if isinstance(v, Table):
        v = v.open(frame, ctx)
    if isinstance(v, Flow):
        return _flow_aggregate(op, v, place, frame)
    many = v if isinstance(v, Many) else _single(v)
    some = many.some if isinstance(v, Many) else not v.opt
    model = many.of(F.lit(None))[0]
    if op == "unique":
        values = F.array_sort(F.array_distinct(F.transform(many.col, lambda x: pack(many.of(x)[0]))))
        out = Many(values, lambda x: (view(model, x), {}), many.some, v.label)
        return out if isinstance(v, Many) else v
    return _array_aggregate(op, many, model, some, place)


def _array_aggregate(op: str, many: Many, model: Any, some: bool, place: One | None) -> One:
    size = F.size(many.col).cast("bigint")
    label = many.label
    if op == "count":
        return One(size, LONG)
    if op == "exists":
        return One(size > 0, BOOL)
    if op in ("first", "last", "nth"):
        at = {"first": F.lit(1), "last": F.lit(-1)}.get(op)
        at = place.col if at is None else at
        index = F.when(at < 0, F.size(many.col) + at).otherwise(at - 1)
        found = F.get(F.transform(many.col, lambda x: pack(many.of(x)[0])), index.cast("int"))
        sure = some and op != "nth"
        out = view(model, found)
        if isinstance(out, Many):
            raise QueryError("a collection of collections has no single element")
        out = replace(out, opt=not sure, label=label)
        return out if out.fields is None or sure else replace(out, fields=tuple((n, replace(f, opt=True) if isinstance(f, One) else f) for n, f in out.fields))
    values = F.transform(many.col, lambda x: many.of(x)[0].col)
    if op == "sum":
        zero = _total(model.type)
        return One(F.aggregate(values, zero, lambda s, x: s + x), DOUBLE if isinstance(model.type, T.FractionalType) else LONG)
    if op == "mean":
        total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
        return One(F.try_divide(total, F.size(many.col).cast("double")), DOUBLE, not some)
    if op in ("max", "min"):
        return One(F.array_max(values) if op == "max" else F.array_min(values), model.type, not some)
    raise QueryError(f"{op} is an aggregate of tables, not of arrays")


def _order(flow: Flow) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in flow.order]) if flow.order else F.struct(F.lit(0))


def _flow_aggregate(op: str, flow: Flow, place: One | None, frame: Frame | None) -> Any:
    """An aggregate by the links, joined to the outer frame; of a group's members, one more of the group's own."""
    if flow.outer is None and frame is None:
        raise QueryError("a table cannot be reached from inside an array")
    outer = frame or flow.outer
    flow = local(flow, frozenset())
    if op == "unique":
        return unique(flow)
    if op in ("nth",) and not place.const:
        return _nth_flow(flow, place, outer)
    if flow.beyond is not None:
        found = _running(op, flow, outer)
        if found is not None:
            return found
        flow = flow.plain()
    val, some = flow.val, flow.some
    kind = val.type if isinstance(val, One) else None
    cond = None
    for c in flow.conditions:
        cond = c if cond is None else cond & c
    value = pack(val, flow.frame)

    def only(col: Column) -> Column:
        return col if cond is None else F.when(cond, col)

    udf = REGISTERED.get(op)
    if op == "count":
        agg, zero, out = F.count(only(F.lit(1))), F.lit(0).cast("bigint"), One(None, LONG)
    elif op == "exists":
        agg, zero, out = F.count(only(F.lit(1))) > 0, F.lit(False), One(None, BOOL)
    elif op == "sum":
        zero = _total(kind)
        agg, out = F.coalesce(F.sum(only(value)), zero), One(None, DOUBLE if isinstance(kind, T.FractionalType) else LONG)
    elif op in ("max", "min", "mean"):
        agg = {"max": F.max, "min": F.min, "mean": F.avg}[op](only(value))
        zero, out = None, One(None, DOUBLE if op == "mean" else kind, not some)
    elif op == "nth":
        return _nth_flow(flow, place, outer)
    elif op in ("first", "last"):
        agg = (F.min_by if op == "first" else F.max_by)(F.struct(value.alias("v")), only(_order(flow))).getField("v")
        zero, out = None, replace(val, opt=not some)
    elif udf and udf.aggregate:
        agg, zero, out = udf.call(only(value)), None, One(None, udf.kind, True)
        if flow.group is not None or flow.conditions:
            flow = flow.plain()
            agg = udf.call(pack(flow.val, flow.frame))
    else:
        raise QueryError(f"unknown aggregate {op}")
    if flow.group is not None and isinstance(outer, Grouped) and outer.some is flow.group and outer.still_open:
        name = outer.add(agg)
    else:
        flow = flow if flow.group is None or cond is not None else flow.plain()
        name = outer.aggregate(flow.df, list(flow.links), agg, python=bool(udf and udf.aggregate))
    return _aggregated(name, zero, out, some, flow, val.label if op in ("first", "last") else None)


#: Ranges of the values that an inequality is about, each a task of its own.
RANGES = 100
_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
_RUNNING = {"count": ("n",), "exists": ("n",), "sum": ("s",), "mean": ("n", "s"), "max": ("a",), "min": ("b",)}


def _running(op: str, flow: Flow, outer: Frame) -> One | None:
    """An aggregate of the rows on one side of each outer value: values and rows are sorted together within ranges of
    the values, an aggregate runs along, and that of the ranges passed before is added. No pairs are made. None if the
    aggregate or the type is another one."""
    val, beyond = flow.val, flow.beyond
    if outer.single or op not in _RUNNING or flow.links or flow.group is not None or not isinstance(val, One) or (op not in ("count", "exists") and not isinstance(val.type, T.NumericType)):
        return None
    key, side, bucket = fresh("key"), fresh("side"), fresh("range")
    values = outer.settled([beyond.outer]).select(beyond.outer.alias(key))
    kind = flow.df.schema[beyond.own].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType)) or values.schema[key].dataType != kind or flow.df.isStreaming or outer.df.isStreaming:
        return None
    value = val.col if op not in ("count", "exists") else F.lit(1)
    if op in ("sum", "mean"):
        value = value.cast("double" if op == "mean" or isinstance(val.type, T.FractionalType) else "bigint")
    measures = {"n": (F.lit(1).cast("bigint"), F.sum), "s": (value, F.sum), "a": (value, F.max), "b": (value, F.min)}
    names = {m: fresh(m) for m in _RUNNING[op]}
    rows = flow.df
    for c in flow.conditions:
        rows = rows.where(c)
    rows = rows.where(F.col(beyond.own).isNotNull()).select(F.col(beyond.own).alias(key), *[measures[m][0].alias(n) for m, n in names.items()])
    if drifts(rows.select(key)):
        rows = once(rows)
    # approximate, so they depend on the order of parts; the rows and the totals need the same ones
    cuts = one_row(rows.agg(F.percentile_approx(key, [k / RANGES for k in range(1, RANGES)]).alias(q := fresh("cuts"))))
    falls = beyond.sign in (">", ">=")

    def placed(df: DataFrame) -> DataFrame:
        below = F.size(F.filter(F.coalesce(F.col(q), F.array().cast(T.ArrayType(kind))), lambda c: c < F.col(key)))
        return df.crossJoin(F.broadcast(cuts)).withColumn(bucket, -below if falls else below).drop(q)

    asked = values.where(F.col(key).isNotNull()).distinct()
    both = placed(rows.withColumn(side, F.lit(0)).unionByName(asked.withColumn(side, F.lit(1)), allowMissingColumns=True))
    # of equal values the rows come first where they count, else the asked one
    tie = F.col(side) if beyond.sign in ("<=", ">=") else -F.col(side)
    along = Window.partitionBy(bucket).orderBy(F.col(key).desc() if falls else F.col(key), tie).rowsBetween(Window.unboundedPreceding, 0)
    run = both.select(key, side, bucket, *[measures[m][1](n).over(along).alias(n) for m, n in names.items()]).where(F.col(side) == 1)
    totals = placed(rows).groupBy(bucket).agg(*[measures[m][1](n).alias(n) for m, n in names.items()])
    totals = totals.agg(F.collect_list(F.struct(bucket, *names.values())).alias(t := fresh("ranges")))  # RANGES at most
    run = run.crossJoin(F.broadcast(totals))


    def all_of(m: str, n: str) -> Column:
        """The ranges passed before, and the part of the own one."""
        before = F.transform(F.filter(t, lambda x: x[bucket] < F.col(bucket)), lambda x: x[n])
        if m in ("a", "b"):
            return F.greatest(F.array_max(before), n) if m == "a" else F.least(F.array_min(before), n)
        return F.aggregate(before, F.coalesce(F.col(n), F.lit(0).cast(run.schema[n].dataType)), lambda s, y: s + F.coalesce(y, F.lit(0)))

    whole = {m: all_of(m, n) for m, n in names.items()}
    out = {"count": lambda w: w["n"], "exists": lambda w: w["n"] > 0, "sum": lambda w: w["s"], "mean": lambda w: F.try_divide(w["s"], w["n"]), "max": lambda w: w["a"], "min": lambda w: w["b"]}[op](whole)
    made = run.select(key, out.alias(name := fresh("agg")))
    outer.join(made, [(beyond.outer, key, False)])
    zero = {"count": F.lit(0).cast("bigint"), "exists": F.lit(False), "sum": _total(val.type)}.get(op)
    kinds = {"count": LONG, "exists": BOOL, "sum": DOUBLE if isinstance(val.type, T.FractionalType) else LONG, "mean": DOUBLE}
    col = F.col(name) if zero is None else F.coalesce(F.col(name), zero)
    return One(col, kinds.get(op, val.type), zero is None)


def _aggregated(name: str, zero: Column | None, out: One, some: bool, flow: Flow, label: str | None) -> One:
    """The value of an aggregate's column."""
    col = F.col(name)
    if zero is not None:
        col = F.coalesce(col, zero) if flow.links else col
    out = replace(out, col=col)
    if out.fields is not None:
        out = replace(view(replace(out, opt=False), col), col=col, opt=not some)
        if not some:
            out = replace(out, fields=tuple((n, replace(f, opt=True) if isinstance(f, One) else f) for n, f in out.fields))
    return replace(out, label=label, const=False)


def _nth_flow(flow: Flow, place: One, outer: Frame) -> Any:
    """The n-th element, from the end for negative n."""
    flow = flow.plain()
    if not place.const:
        flow = bring(flow, {"_n": place}, outer)
        n = flow.ctx["_n"].col
    else:
        n = place.col
    value = F.struct(pack(flow.val, flow.frame).alias("v"))
    if (k := place.literal) is not None and not flow.links:  # the last of the first n
        one = flow.df.orderBy(*ordering(flow, k < 0)).offset(max(0, abs(k) - 1)).limit(int(k != 0))
        name = outer.aggregate(one, [], F.first(value).getField("v"))
    else:
        df, at, total = flow.frame.numbered(flow)
        chosen = F.when(F.col(at) == F.when(n < 0, F.col(total) + n + 1).otherwise(n), value)
        name = outer.aggregate(df, list(flow.links), F.first(chosen, ignorenulls=True).getField("v"))
    return _aggregated(name, None, replace(flow.val, opt=True), False, flow, flow.val.label)


def ordering(flow: Flow, falling: bool = False) -> list[Column]:
    columns = [F.col(c) if isinstance(c, str) else c for c in flow.order] or [F.lit(0)]
    return [c.desc_nulls_last() if falling else c.asc_nulls_first() for c in columns]


def nested(flow: Flow) -> Many:
    """A flow as an array of the outer frame's row, in order."""
    outer = flow.outer
    flow = local(flow, frozenset()).plain()
    name = fresh("nest")
    value = F.struct(pack(flow.val, flow.frame).alias("v"))
    items = F.sort_array(F.collect_list(F.struct(_order(flow).alias("o"), value.alias("e"))))
    groups = flow.df.groupBy(*[F.col(n) for _, n, _ in flow.links])
    made = groups.agg(F.transform(items, lambda x: x["e"]["v"]).alias(name))
    outer.join(made, list(flow.links))
    col = F.coalesce(F.col(name), F.array().cast(made.schema[name].dataType))
    model = flow.val
    return Many(col, lambda x: (view(_closed(model), x), {}), flow.some, flow.val.label)


def _closed(v: Any) -> Any:
    """A value as it is once packed: its tables are arrays there."""
    if isinstance(v, Table):
        inner = v.open(None, {}).val
        return Many(F.lit(None), lambda x: (view(_closed(inner), x), {}), label=v.label)
    if isinstance(v, One) and v.fields is not None:
        return replace(v, fields=tuple((n, _closed(f)) for n, f in v.fields))
    return v


# ---------------------------------------------------------------- flows


def names_of(q: Any) -> frozenset:
    """Names that a query may read."""
    if not isinstance(q, Query):
        return frozenset()
    own = {q.args[0]} if q.op == "get" else set()
    return frozenset(own.union(*(names_of(a) for a in q.args)))


def local(flow: Flow, names: frozenset) -> Flow:
    """The flow with those names of its context that are the outer frame's brought to its own rows."""
    if not (need := flow.foreign & names):
        return flow
    return bring(flow, {n: flow.ctx[n] for n in need}, flow.outer)


def bring(flow: Flow, vals: dict[str, Any], outer: Frame) -> Flow:
    """Values of the outer frame as columns of the flow, over the distinct ones; those of a single row need no link."""
    flow = flow.plain()
    if outer is None:
        raise QueryError("a table cannot be reached from inside an array")
    columns, links, own = [], [], {}
    for outer_col, _, nulls in flow.links:
        columns.append(outer_col.alias(n := fresh("link")))
        links.append((outer_col, n, nulls))
    for name, v in vals.items():
        packed_col = pack(v, outer)
        columns.append(packed_col.alias(n := fresh("given")))
        links.append((packed_col, n, True))
        own[name] = view(_closed(v), F.col(n))
    domain = F.broadcast(outer.df.select(*columns)) if outer.single else outer.settled(columns).select(*columns).distinct()
    on = [(F.col(new), old, nulls) for (_, new, nulls), (_, old, _) in zip(links, flow.links, strict=False)]
    df = joined(domain, flow.df, on, "inner")
    links = () if outer.single else links
    return replace(flow, frame=Frame(df), links=tuple(links), ctx={**flow.ctx, **own}, foreign=flow.foreign - set(vals), order=flow.order, some=False)


def narrowed(flow: Flow, cond: Column) -> Flow:
    if flow.group is not None:
        return replace(flow, conditions=(*flow.conditions, cond), some=False)
    return replace(flow, frame=flow.frame.where(cond), some=False)


def _ands(q: Query) -> list[Query]:
    return [*_ands(q.args[1]), *_ands(q.args[2])] if q.op == "lift" and q.args[0] == "&" else [q]


def filtered(q: Query, flow: Flow, source: Any) -> Flow:
    """Rows for which the predicate holds. An equality of a column of the flow and the outer row's value is a link; one
    inequality is kept for an aggregate to take up."""
    for part in sorted(_ands(q), key=lambda p: not (p.op == "lift" and p.args[0] == "==")):
        used = names_of(part) & flow.foreign
        if used and part.op == "lift" and part.args[0] == "==":
            sides = part.args[1:]
            outer = [names_of(s) and names_of(s) <= flow.foreign for s in sides]
            if sum(map(bool, outer)) == 1:
                theirs, ours = sides if outer[0] else sides[::-1]
                if not names_of(ours) & flow.foreign:
                    other = evaluate(theirs, One(F.lit(True), None, fields=()), flow.ctx, flow.outer)
                    mine = evaluate(ours, flow.val, flow.ctx, flow.frame)
                    if isinstance(other, One) and isinstance(mine, One) and other.fields is None and mine.fields is None:
                        plain = flow.plain()
                        frame = Frame(plain.df.withColumn(n := fresh("link"), mine.col))
                        flow = replace(plain, frame=frame, links=(*plain.links, (other.col, n, False)), some=False)
                        continue
        if used and (found := _inequality(part, flow)) is not None:
            flow = found
            continue
        flow = local(flow, names_of(part))
        if (met := _met(part, flow)) is not None:
            flow = met
            continue
        before = flow.frame
        cond = condition(evaluate(part, flow.val, flow.ctx, flow.frame), flow.frame, where=True)
        flow = narrowed(replace(flow, frame=before), cond)
    return flow


def _inequality(part: Query, flow: Flow) -> Flow | None:
    """The flow with an inequality of its own column and the outer row's value, if the predicate is one."""
    if flow.links or flow.beyond is not None or flow.group is not None or part.op != "lift" or part.args[0] not in _FLIPPED:
        return None
    sides = part.args[1:]
    outer = [bool(names_of(s)) and names_of(s) <= flow.foreign for s in sides]
    if sum(outer) != 1:
        return None
    theirs, ours = sides if outer[0] else sides[::-1]
    if names_of(ours) & flow.foreign:
        return None
    other = evaluate(theirs, One(F.lit(True), None, fields=()), flow.ctx, flow.outer)
    mine = evaluate(ours, flow.val, flow.ctx, flow.frame)
    if not all(isinstance(x, One) and x.fields is None and x.root is None for x in (other, mine)):
        return None
    sign = _FLIPPED[part.args[0]] if outer[0] else part.args[0]
    frame = Frame(flow.df.withColumn(n := fresh("own"), mine.col))

    def over_values(f: Flow) -> Flow:
        f = bring(f, {"_beyond": other}, f.outer)
        value = f.ctx["_beyond"].col
        return narrowed(f, {"<": F.col(n) < value, "<=": F.col(n) <= value, ">": F.col(n) > value, ">=": F.col(n) >= value}[sign])

    return replace(flow, frame=frame, beyond=Beyond(n, sign, other.col, over_values), some=False)


def _existence(q: Query) -> tuple[Query, bool] | None:
    """(X, whether it is wanted) of a predicate that says whether X has elements."""
    if q.op == "lift" and q.args[0] == "!":
        found = _existence(q.args[1])
        return found and (found[0], not found[1])
    if q.op == "lift" and q.args[0] in ("==", ">", "!=") and len(q.args) == 3 and q.args[2].op == "const" and q.args[2].args[0] in (0,):
        x = _aggregated_query(q.args[1], "count")
        return None if x is None else (x, q.args[0] != "==")
    x = _aggregated_query(q, "exists")
    return None if x is None else (x, True)


def _aggregated_query(q: Query, name: str) -> Query | None:
    """X of name(X) and of X >> name."""
    if q.op == "agg" and len(q.args) == 2 and q.args[0] == name:
        return q.args[1]
    if q.op == "compose" and q.args[-1].op == "then" and q.args[-1].args[0] == name and len(q.args[-1].args) == 1:
        return Query("compose", *q.args[:-1]) if len(q.args) > 2 else q.args[0]
    return None


def _met(q: Query, flow: Flow) -> Flow | None:
    """The flow's rows for which a linked flow has an element, or none: a semi or anti join by the links. None where the
    predicate is another one, or the elements are no linked flow."""
    if flow.group is not None or isinstance(flow.frame, Grouped):
        return None
    found = _existence(q)
    if not found and q.op not in ("compose", "get"):
        return None
    before = flow.frame
    value = evaluate(found[0] if found else q, flow.val, flow.ctx, before)
    if isinstance(value, Table):
        value = value.open(before, flow.ctx)
    if not isinstance(value, Flow) or value.group is not None or not value.links:
        return None
    value = local(value, frozenset()).plain()
    if not found:  # a predicate of several values: one of them is true
        if not (isinstance(value.val, One) and isinstance(value.val.type, T.BooleanType)):
            return None
        value = narrowed(value, value.val.col)
    names = [(outer, n, fresh("on"), nulls) for outer, n, nulls in value.links]
    right = value.df.select(*[F.col(n).alias(m) for _, n, m, _ in names])
    df = joined(before.df, right, [(outer, m, nulls) for outer, _, m, nulls in names], "left_semi" if not found or found[1] else "left_anti")
    return replace(flow, frame=Frame(df), some=False)


def each_row(q: Query, flow: Flow, source: Any) -> Flow:
    """A step of every row of a flow."""
    if q.op == "filter":
        return filtered(q.args[0], flow, source)
    val, ctx = step(q, flow.val, flow.ctx, source, flow.frame)
    if isinstance(val, Table):
        val = val.open(flow.frame, ctx)
    if isinstance(val, Flow):
        return unnested(flow, val, ctx)
    if isinstance(val, Many):
        return exploded(flow, val, ctx)
    if val.opt:
        flow = replace(flow, conditions=(*flow.conditions, val.present), some=False)
        val = _sure(val)
    return replace(flow, val=val, ctx=ctx)


def _sure(v: One) -> One:
    return replace(v, opt=False)


def exploded(flow: Flow, many: Many, ctx: dict) -> Flow:
    flow = flow.plain()
    at, item = fresh("pos"), fresh("item")
    df = flow.df.select("*", F.posexplode(many.col).alias(at, item))
    val, own = many.of(F.col(item))
    flow = replace(flow, frame=Frame(df), val=relabel(val, many.label), ctx={**ctx, **own}, order=(*flow.order, at), some=flow.some and many.some)
    if isinstance(val, One) and val.opt:
        return narrowed(replace(flow, val=_sure(flow.val)), val.present)
    return flow


def unnested(flow: Flow, inner: Flow, ctx: dict) -> Flow:
    """Each row's elements of another flow, one after the other."""
    outer = flow.frame
    if inner.group is not None and isinstance(outer, Grouped) and outer.some is inner.group and outer.still_open and not flow.conditions:
        # back from a group to its members: the group's aggregates become window columns
        base = inner.frame.df
        window = Window.partitionBy(*[F.col(n) for n in outer.names])
        for name, agg in outer.some:
            base = base.withColumn(name, agg.over(window))
        for c in (*outer.conditions, *inner.conditions):
            base = base.where(c)
        return replace(flow, frame=Frame(base), val=inner.val, ctx={**ctx, **{k: v for k, v in inner.ctx.items() if k not in inner.foreign and k not in ctx}}, order=(*flow.order, *inner.order), some=flow.some and inner.some)
    inner, flow = inner.plain(), flow.plain()
    links = list(inner.links)
    df = joined(flow.df, inner.df, links, "inner")
    own = {k: v for k, v in inner.ctx.items() if k not in inner.foreign}
    return replace(flow, frame=Frame(df), val=inner.val, ctx={**ctx, **own}, order=(*flow.order, *inner.order), some=False)


def _mixed_flow(vals: list, v: Any, ctx: dict, frame: Frame | None) -> Flow:
    """Combinations with tables: the first table's rows, then every other value for each of them."""
    start = None
    chosen = []
    for x in vals:
        if isinstance(x, Table):
            inner = x.open(frame, ctx).plain()
            if start is None:
                start = inner
            else:
                on = [(F.col(a), b, n) for (c, a, n) in start.links for (d, b, _) in inner.links if c is d]
                rest = tuple(k for k in inner.links if not any(k[1] == b for _, b, _ in on))
                start = replace(start, frame=Frame(joined(start.df, inner.df, on, "inner")), order=(*start.order, *inner.order), links=(*start.links, *rest))
            chosen.append(relabel(inner.val, x.label))
        else:
            chosen.append(x)
    flow = replace(start, val=One(F.lit(True), None, fields=()), ctx=ctx, foreign=frozenset(n for n, c in ctx.items() if not getattr(c, "const", False)))
    for k, x in enumerate(chosen):
        if isinstance(x, Many) or (isinstance(x, One) and x.opt):
            many = x if isinstance(x, Many) else _single(x)
            brought = bring(flow, {"_mix": many}, flow.outer or frame)
            flow = exploded(brought, brought.ctx["_mix"], {})
            chosen[k] = flow.val
    return replace(flow, val=record(chosen, v.label if isinstance(v, One) else None), some=False)


def unique(flow: Flow) -> Flow:
    flow = flow.plain()
    value = fresh("value")
    df = flow.df.select(*[F.col(n) for _, n, _ in flow.links], pack(flow.val, flow.frame).alias(value)) if not _tables(flow.val) else None
    if df is None:
        raise QueryError("elements that hold tables have no equality")
    val = view(flow.val, F.col(value))
    return replace(flow, frame=Frame(df.distinct()), val=val, ctx={k: v for k, v in flow.ctx.items() if k in flow.foreign or getattr(v, "const", False)}, order=(value,), sorted=True)


def _tables(v: Any) -> bool:
    return isinstance(v, Table) or (isinstance(v, One) and v.fields is not None and any(_tables(f) for _, f in v.fields))


def key_columns(keys: tuple, flow: Flow) -> tuple[list[tuple[str, Any]], Flow]:
    """The keys as columns of the flow: (name, value over that column)."""
    out, columns = [], []
    for k in keys:
        v = evaluate(k, flow.val, flow.ctx, flow.frame)
        v = nested(v) if isinstance(v, Flow) else v
        columns.append((name := fresh("key"), pack(v, flow.frame)))
        out.append((name, view(_closed(v), F.col(name)) if not isinstance(v, One) or v.fields is not None else replace(v, col=F.col(name), const=False)))
    df = flow.df
    for name, col in columns:
        df = df.withColumn(name, col)
    return out, replace(flow, frame=Frame(df))


def flow_step(q: Query, flow: Flow, source: Any, ctx: dict, frame: Frame | None) -> Any:
    """A step of a whole flow."""
    op, args = q.op, q.args
    if op == "then":
        name = args[0]
        if name.startswith("is"):
            return _checked_flow(name, flow, frame)
        return aggregate_of(name, flow, args[1:], source, ctx, frame)
    if op == "is":
        return replace(flow, val=is_type(args[0], flow.val))
    if op == "sort":
        flow = flow.plain()
        down = [k.op == "desc" for k in args]
        keys, flow = key_columns(tuple(k.args[0] if d else k for k, d in zip(args, down, strict=True)), flow)
        order = []
        for (name, _), falls in zip(keys, down, strict=True):
            order.append(_falling(flow, name) if falls else name)
        return replace(flow, order=(*order, *flow.order), sorted=True)
    if op == "group":
        return grouped(args, flow)
    if op in ("take", "drop"):
        return _sliced(op, args[0], flow, source, ctx, frame)
    if op == "collect_source":
        out = as_record_or_root(source)
        name = flow.val.label
        return out.with_field(name, flow) if hasattr(out, "with_field") else replace(out, fields=(*[f for f in out.fields if f[0] != name], (name, settle(flow, frame))))
    raise QueryError(f"invalid query expression: {q!r}")


def as_record_or_root(v: Any) -> Any:
    if isinstance(v, One) and v.root is not None:
        return _RootRecord(v)
    return as_record(v)


class _RootRecord:
    def __init__(self, v: One):
        self.v = v

    def with_field(self, name: str | None, flow: Flow) -> One:
        return replace(self.v, root=self.v.root.with_flow(name, flow))


def _falling(flow: Flow, name: str) -> Column:
    """A column whose rising order is the falling one of a number, time, truth value or text."""
    kind = flow.df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return -F.col(name)
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return -F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.BooleanType):
        return -F.col(name).cast("int")
    if isinstance(kind, T.StringType):  # by code points; of two texts that begin alike the longer one comes first
        return F.concat(F.transform(F.split(F.col(name), ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))
    raise QueryError("a falling order is for numbers, times, truth values and texts")


def grouped(keys: tuple, flow: Flow) -> Flow:
    flow = flow.plain()
    named, base = key_columns(keys, flow)
    own = [n for _, n, _ in flow.links]
    names = [*own, *(n for n, _ in named)]
    base.frame.settled([F.col(n) for n in names])  # members meet their group by them
    some: list = []
    frame = Grouped(base, names, some)
    label = flow.val.label
    links = tuple((F.col(n), n, True) for n in names)

    def members(outer: Frame | None, ctx: dict) -> Flow:
        inner_ctx = {**ctx, **base.ctx}
        foreign = frozenset(k for k, c in ctx.items() if not getattr(c, "const", False))
        inner = base
        if not (isinstance(outer, Grouped) and outer.some is some and outer.still_open):
            # the groups are read already: the members' key columns get names of their own
            df, on = base.df, []
            for n in names:
                df = df.withColumnRenamed(n, m := f"{n}_m")
                on.append((F.col(n), m, True))
            return replace(inner, frame=Frame(df), links=tuple(on), outer=outer, ctx={**base.ctx, **ctx}, foreign=foreign, group=None, some=True)
        return replace(inner, links=links, outer=outer, ctx={**inner_ctx, **ctx}, foreign=foreign, group=some, conditions=(), some=True)

    fields = [(v.label, v) for _, v in named]
    names_taken = [n for n, _ in fields]
    fields = [(n if n and n not in names_taken[k + 1 :] and n != label else None, v) for k, (n, v) in enumerate(fields)]
    val = One(F.lit(True), None, fields=(*fields, (label, Table(members, label))))
    ctx = {k: v for k, v in flow.ctx.items() if k in flow.foreign or getattr(v, "const", False)}
    return Flow(frame, val, ctx, tuple(n for n, _ in named), flow.links, flow.outer, flow.foreign, sorted=True, some=flow.some)


def _place(q: Query, source: Any, ctx: dict, frame: Frame | None) -> One:
    n = evaluate(q, source, ctx, frame)
    if not isinstance(n, One) or not isinstance(n.type, (T.IntegralType, T.NullType, type(None))):
        raise QueryError("expected a singular integer")
    return n


def _head(flow: Flow, k: int, falling: bool) -> DataFrame:
    """The first k rows, or the last."""
    return flow.df.orderBy(*ordering(flow, falling)).limit(k)


def _beyond(flow: Flow, k: int, falling: bool) -> DataFrame:
    """All but the first k rows, or the last. Only those k are ordered; the others are told by their place in the order
    after the k-th one, so that they stay where they are. Rows of the same place as the k-th are counted off."""
    if not flow.order:
        return flow.df.offset(k)
    if not k:
        return flow.df
    order = _order(flow)
    df = flow.frame.settled([order])
    edge = _head(flow, k, falling).groupBy(order.alias(e := fresh("edge"))).agg(F.count("*").alias(t := fresh("taken")))
    edge = edge.orderBy(F.col(e).asc() if falling else F.col(e).desc()).limit(1)
    # one row; none where there is no row at all
    after = df.crossJoin(F.broadcast(edge)).where(order < F.col(e) if falling else order > F.col(e)).drop(e, t)
    place = F.row_number().over(Window.partitionBy(e).orderBy(F.lit(0)))
    same = df.crossJoin(F.broadcast(edge)).where(order == F.col(e)).withColumn(p := fresh(), place).where(F.col(p) > F.col(t)).drop(e, t, p)
    return after.unionByName(same)


def _sliced(op: str, q: Query, flow: Flow, source: Any, ctx: dict, frame: Frame | None) -> Flow:
    """The first n of the flow, or the rest; from the end for negative n; all, or none, for no n."""
    flow = flow.plain()
    n = _place(q, source, ctx, frame)
    if not flow.links:
        k = q.args[0] if q.op == "const" else (frame or Frame(flow.df.sparkSession.range(1))).df.select(n.col.alias("n")).head()["n"]
        if k is None:
            return flow if op == "take" else narrowed(flow, F.lit(False))
        return replace(flow, frame=Frame(_head(flow, abs(k), k < 0) if (op == "take") == (k >= 0) else _beyond(flow, abs(k), k < 0)), some=False)
    if not n.const:
        flow = bring(flow, {"_n": n}, frame or flow.outer)
        place = flow.ctx["_n"].col
    else:
        place = n.col
    by = [F.col(x) for _, x, _ in flow.links]
    df = flow.df.withColumn(a := fresh(), F.row_number().over(Window.partitionBy(*by).orderBy(*ordering(flow))))
    steady = q.op == "const" and q.args[0] is not None and q.args[0] >= 0
    if steady:  # a plain bound, which Spark keeps per task before the shuffle
        inside = F.col(a) <= q.args[0]
    else:
        df = df.withColumn(b := fresh(), F.count("*").over(Window.partitionBy(*by)))
        inside = F.col(a) <= F.coalesce(F.when(place < 0, F.col(b) + place).otherwise(place), F.col(b))
    return replace(flow, frame=Frame(df.where(inside if op == "take" else ~inside)), some=False)


CHECKS = {"is0to1": OPT, "is1to1": ONE, "is0toN": MANY, "is1toN": SOME}


def _bad(size: Column, card: Card, label: str | None, source: str | None) -> list[tuple[Column, str]]:
    out = []
    if not card & SOME:
        out.append((size > 1, f'"{label or "#"}": expected a singular value, relative to "{source or "#"}"'))
    if not card & OPT:
        out.append((size < 1, f'"{label or "#"}": expected a mandatory value, relative to "{source or "#"}"'))
    return out


def _sure_of(col: Column, bad: list[tuple[Column, str]]) -> Column:
    for when, message in bad:
        col = F.when(when, F.raise_error(F.lit(message))).otherwise(col)
    return col


def _checked_flow(name: str, flow: Flow, frame: Frame | None) -> Any:
    card = CHECKS[name]
    if card == MANY:
        return replace(flow, some=False)
    outer = frame or flow.outer
    size = _flow_aggregate("count", flow, None, outer).col
    bad = _bad(size, card, flow.val.label, None)
    if card == SOME:
        if not flow.links:  # every row carries the check
            checked = outer.df.select(_sure_of(size, bad).alias(n := fresh("check")))
            plain = flow.plain()
            return replace(plain, frame=Frame(plain.df.crossJoin(checked).where(F.col(n).isNotNull())), some=True)
        # each of the outer rows carries the check of its own elements
        outer._df = outer.df.where(_sure_of(size, bad) > 0)
        return replace(flow, some=True)
    first = _flow_aggregate("first", flow, None, outer)
    return replace(view(replace(first, opt=False), _sure_of(first.col, bad)), opt=card == OPT)


def is_type(kind: str, v: Any) -> Any:
    if isinstance(v, Many):
        is_type(kind, v.of(F.lit(None))[0])
        return v
    if kind == "record":
        as_record(v)
        return v
    want = T._parse_datatype_string(kind)
    if isinstance(v, Table) or (v.fields is not None) or (v.type is not None and v.type != want and not (isinstance(want, T.LongType) and isinstance(v.type, T.IntegralType))):
        got = "a record" if isinstance(v, Table) or v.fields is not None else v.type.simpleString()
        raise QueryError(f'"{v.label or "#"}": expected a value of type {want.simpleString()}; got {got}')
    return v


def inline_step(q: Query, state: State, source: Any, ctx: dict, frame: Frame | None) -> State:
    """A step of a whole collection inside the row, or of a single value."""
    v, op, args = state.val, q.op, q.args
    if op == "then":
        name = args[0]
        if name in CHECKS:
            return State(_checked_array(name, v, source), state.ctx)
        return State(aggregate_of(name, v, args[1:], source, ctx, frame), ctx)
    if op == "is":
        return State(is_type(args[0], v), state.ctx)
    if op == "collect_source":
        rec = as_record(source)
        return State(replace(rec, fields=(*[f for f in rec.fields if f[0] != v.label], (v.label, v))), ctx)
    many = v if isinstance(v, Many) else _single(v)
    if op in ("take", "drop"):
        n = _place(args[0], source, ctx, frame)
        size = F.size(many.col)
        k = F.when(n.col < 0, F.greatest(size + n.col, F.lit(0))).otherwise(F.least(n.col, size))
        k = F.coalesce(k, size).cast("int")
        col = F.slice(many.col, F.lit(1), k) if op == "take" else F.slice(many.col, k + 1, size - k)
        return State(replace(many, col=col, some=False), state.ctx)
    if op == "sort":
        if any(k.op == "desc" for k in args):
            raise QueryError("a falling order is for tables")
        model = many.of(F.lit(None))

        def keyed(x: Column, at: Column) -> Column:
            y, c = many.of(x)
            return F.struct(*[pack(evaluate(k, y, c, None)).alias(f"k{j}") for j, k in enumerate(args)], at.alias("at"), packed((y, c)).alias("e"))

        col = F.array_sort(F.transform(many.col, keyed), _compare(len(args)))
        return State(Many(col, lambda x: unpacked(model, x.getField("e")), many.some, many.label), state.ctx)
    if op == "group":
        return State(_grouped_array(args, many, isinstance(v, Many)), ctx)
    raise QueryError(f"invalid query expression: {q!r}")


def _compare(n: int) -> Callable[[Column, Column], Column]:
    """By the first n fields, absent ones first, then by place."""

    def compare(a: Column, b: Column) -> Column:
        out = a["at"] - b["at"]
        for k in reversed(range(n)):
            x, y = a[f"k{k}"], b[f"k{k}"]
            less = (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))
            more = (y.isNull() & x.isNotNull()) | F.coalesce(x > y, F.lit(False))
            out = F.when(less, -1).when(more, 1).otherwise(out)
        return out

    return compare


def _grouped_array(keys: tuple, many: Many, plural: bool) -> Many:
    """Groups of an array's elements, ordered by the keys."""
    model, ctx = many.of(F.lit(None))
    found = [evaluate(k, model, ctx, None) for k in keys]

    def key(x: Column) -> Column:
        y, c = many.of(x)
        return F.struct(*[pack(evaluate(k, y, c, None)).alias(f"k{j}") for j, k in enumerate(keys)], F.lit(0).alias("k"))

    distinct = F.array_sort(F.array_distinct(F.transform(many.col, key)))
    label = many.label

    def of(g: Column) -> tuple[Any, dict]:
        fields = [(v.label, view(v, g.getField(f"k{j}"))) for j, v in enumerate(found)]
        names = [n for n, _ in fields]
        fields = [(n if n and n not in names[k + 1 :] and n != label else None, v) for k, (n, v) in enumerate(fields)]
        own = F.filter(many.col, lambda x: key(x).eqNullSafe(g))
        members = Many(own, lambda x: (many.of(x)[0], {}), True, label)
        return One(F.lit(True), None, fields=(*fields, (label, members if plural else _array_aggregate("first", members, model, True, None)))), {}

    return Many(distinct, of, many.some)


def _checked_array(name: str, v: Any, source: Any) -> Any:
    card = CHECKS[name]
    label, origin = v.label, getattr(source, "label", None)
    if card == MANY:
        return replace(v, some=False) if isinstance(v, Many) else replace(_single(v), some=False)
    if isinstance(v, One):
        if card & OPT or not v.opt:
            return v if not card & SOME else replace(_single(v), some=not v.opt)
        bad = _bad(F.when(v.present, 1).otherwise(0), card, label, origin)
        return replace(v, col=_sure_of(v.col, bad), opt=False)
    bad = _bad(F.size(v.col), card, label, origin)
    col = _sure_of(v.col, bad)
    if card == SOME:
        return replace(v, col=col, some=True)
    return _array_aggregate("first", replace(v, col=col), v.of(F.lit(None))[0], card == ONE, None)
