"""Rows that a plan reads twice. Spark computes them anew each time, and a sum of fractional numbers depends on the order
in which the parts of a shuffle arrive: its last bits differ from one time to the next, and the two no longer meet."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: What always gives the same value, whatever the order of rows.
_STEADY = {"Count", "Max", "Min", "MaxBy", "MinBy", "First", "Last", "CollectList", "CollectSet"}
_CHANGING = {"Rand", "Randn", "ApproximatePercentile", "PythonUDAF"}
_SUBQUERIES = {"ScalarSubquery", "ListQuery", "Exists"}


def drifts(df: DataFrame) -> bool:
    """Whether rows or values of df may differ when it is computed again; columns that are not read do not count."""
    return not df.isStreaming and any(map(_changing, _expressions(df._jdf.queryExecution().optimizedPlan())))


def once(df: DataFrame) -> DataFrame:
    """df computed now and written to the checkpoint folder, from which all read the same rows."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def one_row(df: DataFrame) -> DataFrame:
    """df, a single small row, computed now."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.collectAsList(), df._jdf.schema()), spark)


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder if that is unset and all of Spark is this one process."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='weft-')}"


def _each(items: Any) -> Iterator[Any]:
    return (items.apply(k) for k in range(items.size()))


def _expressions(plan: Any) -> Iterator[Any]:
    """All expressions of a plan."""
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        nodes.extend(_each(node.children()))
        inner = list(_each(node.expressions()))
        while inner:
            yield (x := inner.pop())
            inner.extend(_each(x.children()))
            if x.getClass().getSimpleName() in _SUBQUERIES:
                nodes.append(x.plan())


def _changing(x: Any) -> bool:
    name = x.getClass().getSimpleName()
    if name != "AggregateExpression":
        return name in _CHANGING
    function = x.aggregateFunction()
    kind = function.getClass().getSimpleName()
    return kind not in _STEADY and (kind in _CHANGING or any(t in function.dataType().simpleString() for t in ("double", "float")))
