"""A nested-query algebra on Spark DataFrames."""

from .functions.scalars import register
from .operators.notation import parse
from .operators.query import (
    Collect, Count, Desc, Drop, Each, Exists, Filter, First, Get, Given, Group, Is, Is0to1, Is0toN, Is1to1, Is1toN, It, Join, Keep,
    Label, Last, Let, Lift, Max, Mean, Min, Mix, Nth, Query, QueryError, Record, Sort, Sum, Tag, Take, Then, Unique,
)
from .sources.db import Db, Result, source

__all__ = [
    "Collect", "Count", "Db", "Desc", "Drop", "Each", "Exists", "Filter", "First", "Get", "Given", "Group", "Is", "Is0to1", "Is0toN",
    "Is1to1", "Is1toN", "It", "Join", "Keep", "Label", "Last", "Let", "Lift", "Max", "Mean", "Min", "Mix", "Nth", "Query", "QueryError",
    "Record", "Result", "Sort", "Sum", "Tag", "Take", "Then", "Unique", "parse", "register", "source",
]
