"""Queries over streams: a table of a data set may be a streaming DataFrame.

Steps of single elements (fields, filters, records, nested collections) run on any stream. Groups with count, sum, max,
min and mean run in the modes that Structured Streaming has for them; a watermark lets finished groups go. Steps that
need an order of the whole stream (sort, take, first of all) have no meaning there, and Spark says so.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.query import QueryError
from ..sources.db import Db, Result


def open_stream(spark: SparkSession, name: str, df: DataFrame, key: list[str], watermark: tuple[str, str] | None = None) -> Db:
    """A data set with one streaming table. key: columns that stand for the order of its rows; watermark: a time
    column and how late its rows may be."""
    if not df.isStreaming:
        raise QueryError(f"{name} is not a stream")
    if watermark:
        df = df.withWatermark(*watermark)
    return Db(spark, {name: key}, **{name: df})


def start(result: Result, kind: str, checkpoint: str, mode: str = "append", **options: Any) -> StreamingQuery:
    """Runs a query's result into a sink of that kind. The checkpoint folder must be one that all executors share."""
    writer = result.df.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint)
    name = options.pop("name", None)
    for key, value in options.items():
        writer = writer.option(key, value)
    return (writer.queryName(name) if name else writer).start()
