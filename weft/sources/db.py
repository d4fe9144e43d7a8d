"""Data sets: named tables that queries start from, and what queries give."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.notation import parse
from ..operators.query import Query, QueryError, as_query
from ..plans import lower
from ..plans.lower import Flow, Frame, Many, One, Table, fresh, typed
from ..plans.render import text_table
from ..plans.shape import Shape, ordinal

READERS = ("parquet", "csv", "json", "orc", "jdbc")


class Root:
    """The tables of a data set by name, each with the columns that order it."""

    def __init__(self, tables: dict[str, Any], orders: dict[str, list[str]]):
        self.tables, self.orders = tables, orders

    def names(self) -> list[str]:
        return list(self.tables)

    def with_flow(self, name: str | None, flow: Flow) -> Root:
        return Root({**self.tables, name: flow}, self.orders)

    def flow(self, name: str, frame: Frame | None, ctx: dict) -> Any:
        """A table's rows as a flow of records. Columns get names of their own, so that a table can meet itself."""
        foreign = frozenset(n for n, v in ctx.items() if not getattr(v, "const", False))
        held = self.tables[name]
        if isinstance(held, Result):
            held = held.flow if isinstance(held.flow, Flow) else held.df
        if isinstance(held, Flow):
            held = held.plain()
            return Flow(held.frame, lower.relabel(held.val, name), {**held.ctx, **ctx}, held.order, (), frame, foreign, some=held.some, sorted=held.sorted)
        own = {f.name: fresh(f.name) for f in held.schema.fields}
        df = held.select(*[F.col(f"`{n}`").alias(m) for n, m in own.items()])
        fields = tuple((f.name, typed(F.col(own[f.name]), f.dataType, f.nullable, f.name)) for f in held.schema.fields)
        if order := self.orders.get(name):
            order = tuple(own[c] for c in order)
        else:  # the order of reading; a column that is dropped wherever order does not matter
            order = (at := fresh("at"),)
            df = df.withColumn(at, F.monotonically_increasing_id())
        return Flow(Frame(df), One(F.lit(True), None, False, fields, name), dict(ctx), order, (), frame, foreign)


class Db:
    """A data set. Tables are DataFrames, results of queries, pandas frames, or lists of rows.

        db = Db(spark, orders=df, order_by={"orders": ["o_orderkey"]})
        db[It.orders >> Count].get()
        db.q("count(orders)").get()

    order_by names the columns that say in which order a table's rows stand; without it, it is the order of reading."""

    def __init__(self, spark: SparkSession, order_by: dict[str, list[str]] | None = None, **tables: Any):
        self.spark = spark
        self.root = Root({n: self._table(t) for n, t in tables.items()}, order_by or {})

    def _table(self, t: Any) -> Any:
        return t if isinstance(t, (DataFrame, Result)) else self.spark.createDataFrame(t)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names: list[str], kind: str = "parquet", order_by: dict | None = None, **options: Any) -> Db:
        """Tables from files folder/name.kind."""
        if kind not in READERS:
            raise QueryError(f"no reader for {kind}")
        return cls(spark, order_by, **{n: source(spark, kind, f"{folder}/{n}.{kind}", **options) for n in names})

    def __getitem__(self, key: Any) -> Result:
        return self.query(key)

    def q(self, text: str, **params: Any) -> Result:
        """A query in the string notation; $name stands for a keyword argument that is a query or a value."""
        inner = {n: v for n, v in params.items() if f"${n}" in text}
        return self.query(parse(text, inner), **{n: v for n, v in params.items() if n not in inner})

    def query(self, q: Any, **params: Any) -> Result:
        frame = Frame(self.spark.range(1).select(), single=True)
        ctx: dict[str, Any] = {}
        for name, value in sorted(params.items()):
            if isinstance(value, Result):
                value = value.value(frame, name)
            else:
                value = lower.constant(value)
            ctx[name] = lower.relabel(value, name)
        q = as_query(q)
        root = One(F.lit(True), None, False, (), None, self.root)
        found = lower.evaluate(q, root, ctx, frame)
        if isinstance(found, Table):
            found = found.open(frame, ctx)
        if isinstance(found, Flow):
            found = lower.local(found, lower.names_of(q)).plain()
        return Result(self, q, frame, found)


def source(spark: SparkSession, kind: str, path: str | None = None, **options: Any) -> DataFrame:
    """A DataFrame of files or, for jdbc, of a database's table. CSV files have a header and are typed by a schema
    option where one is given."""
    reader = spark.read.format(kind)
    if kind == "csv":
        options = {"header": True, "inferSchema": "schema" not in options} | options
    if schema := options.pop("schema", None):
        reader = reader.schema(schema)
    return reader.options(**options).load(path) if path else reader.options(**options).load()


class Result:
    """What a query gives: a DataFrame and a shape."""

    def __init__(self, db: Db, query: Query, frame: Frame, flow: Any):
        self.db, self.query_, self.frame, self.flow = db, query, frame, flow

    @property
    def plural(self) -> bool:
        return isinstance(self.flow, (Flow, Many))

    def _elements(self) -> tuple[Any, Frame, tuple]:
        """(element, its frame, order)."""
        found = self.flow
        if isinstance(found, Many):
            found = lower.exploded(Flow(self.frame, One(F.lit(True), None), {}), found, {})
        if isinstance(found, Flow):
            found = found.plain()
            return found.val, found.frame, found.order
        return found, self.frame, ()

    def _columns(self) -> tuple[list[Column], Frame, tuple]:
        val, frame, order = self._elements()
        if isinstance(val, One) and val.root is not None:
            raise QueryError("the data set itself is not a table")
        if isinstance(val, One) and val.fields is not None:
            fields = [(n or ordinal(k), f) for k, (n, f) in enumerate(val.fields)]
        else:
            fields = [(val.label or "value", val)]
        columns = [plain(f, frame).alias(n) for n, f in fields]
        if isinstance(val, One) and val.opt and val.fields is not None:
            frame = frame.where(val.col.isNotNull())
        return columns, frame, order

    @property
    def df(self) -> DataFrame:
        """The elements as rows, in no particular order; fields of a record are columns, collections are arrays."""
        columns, frame, _ = self._columns()
        df = frame.df.select(*columns)
        if isinstance(self.flow, One) and self.flow.opt and self.flow.fields is None:
            df = df.where(F.col(f"`{df.columns[0]}`").isNotNull())
        return df

    @property
    def ordered(self) -> DataFrame:
        """The same rows in the order of the query."""
        columns, frame, order = self._columns()
        if not order:
            return self.df
        names = [fresh("o") for _ in order]
        df = frame.df.select(*columns, *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(order, names, strict=True)])
        return df.orderBy(*[F.col(n).asc_nulls_first() for n in names]).drop(*names)

    @property
    def shape(self) -> Shape:
        return lower.shape(self.flow)

    def __rshift__(self, other: Any) -> Query:
        """A query that starts from this result."""
        return as_query(self) >> other

    def as_knot(self, frame: Frame) -> Any:
        return self.value(frame, None)

    def value(self, frame: Frame, name: str | None) -> Any:
        """This result as a parameter of another query: a single row is joined to the other's frame."""
        if isinstance(self.flow, Flow):
            flow = self.flow
            return Table(lambda outer, ctx: Flow(flow.plain().frame, flow.val, flow.ctx, flow.order, (), outer, frozenset()), name)
        packed = self.frame.df.select(lower.pack(self.flow, self.frame).alias(n := fresh("param")))
        frame.join(packed, [])
        return lower.view(lower._closed(self.flow), F.col(n))

    def get(self) -> Any:
        """Python values: one, or None, for a single result; else a list. Records are dictionaries."""
        val = self._elements()[0]
        whole = isinstance(val, One) and val.fields is not None
        rows = [_python(r) if whole else _python(r[0]) for r in self.ordered.collect()]
        return rows if self.plural else (rows[0] if rows else None)

    def toPandas(self):  # noqa: N802
        return self.ordered.toPandas()

    def show(self, what: str = "table", rows: int = 30, width: int = 100) -> str:
        """Prints, and gives, a text table of at most so many rows, or the shape as a tree."""
        text = self.shape.tree() if what == "shape" else text_table(self, rows, width)
        print(text)
        return text

    def explain(self, mode: str = "formatted") -> None:
        print(self.query_)
        self.df.explain(mode)


def plain(v: Any, frame: Frame | None) -> Column:
    """A value as a column under its labels."""
    if isinstance(v, Table):
        many = lower.nested(v.open(frame, {}))
        return plain(many, frame)
    if isinstance(v, Many):
        probe = v.of(F.lit(None))[0]
        if isinstance(probe, One) and probe.fields is None and lower._same(probe):
            return v.col
        return F.transform(v.col, lambda x: plain(v.of(x)[0], None))
    if v.fields is None:
        return v.col
    body = F.struct(*[plain(f, frame).alias(n or ordinal(k)) for k, (n, f) in enumerate(v.fields)]) if v.fields else F.struct()
    return F.when(v.col.isNotNull(), body) if v.opt else body


def _python(x: Any) -> Any:
    if isinstance(x, T.Row):
        return {n: _python(v) for n, v in zip(x.__fields__, x, strict=True)}
    if isinstance(x, list):
        return [_python(v) for v in x]
    return x


def rows(result: Result) -> Iterator[Any]:
    """The elements one after the other, without all of them in memory."""
    return map(_python, result.ordered.toLocalIterator())
