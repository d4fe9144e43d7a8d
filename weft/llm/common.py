"""What the operators of this folder share: the shared folder, tables written there, and slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text that one slice of a batch holds, so that a worker's memory does not depend on the rows of an Arrow batch.
SLICE_BYTES = 2 << 20
#: Text that a model is fitted to at most, for each of its labels; of the first document the whole in any case.
FIT_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder is made
    and set if all of Spark is this one process; on a cluster that is an error."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='weft-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the lineage, and survives lost executors. Void
    columns (every value null, no type) become text."""
    spark = df.sparkSession
    if any(kind == "void" for _, kind in df.dtypes):
        df = df.select(*[(named(c).cast("string") if kind == "void" else named(c)).alias(c) for c, kind in df.dtypes])
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table that written() made, when nothing will read it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps that are over: they go with the driver's garbage, and a plan of many steps
    would hold all of them to its end."""
    gc.collect()
    spark._jvm.System.gc()


def named(column: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose memory goes back to the system when it is done: workers wait idle beside the stages that need none."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: StructType | None = None) -> DataFrame:
    """df.mapInArrow(run), whatever its columns are called: batches have them in order as c0, c1 and so on, and run gives
    batches of these columns and of those of `more`."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    more = more or StructType([])
    return plain.mapInArrow(tidy(run), StructType([*plain.schema.fields, *more.fields])).toDF(*df.columns, *more.names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_nulls(df: DataFrame, column: str) -> DataFrame:
    """df, where a void column (every value null, no type) is text."""
    return df.withColumn(column, named(column).cast("string")) if dict(df.dtypes)[column] == "void" else df


def release() -> None:
    """Gives memory that a worker's last task has freed back to the system: workers serve one stage after the other."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of about SLICE_BYTES of the text in that column, whole rows each."""
    release()
    for batch in batches:
        start, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            held += n
            if held >= SLICE_BYTES:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < len(sizes):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts of a column; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def least(keys: DataFrame, most: dict[Any, int] | int, most_bytes: int) -> dict[Any, int]:
    """For each value of column g of keys (g, h, n) the hash up to which its rows are taken: those of the least distinct
    hashes h, at most so many of them and, after the first, so many bytes (the largest n of each hash).

    A count of each g says where the bound is to be expected; only hashes under that come to the driver, and if they
    are too few (rows share hashes), more do."""
    counts = {r.g: r.n for r in keys.groupBy("g").agg(F.count("*").alias("n")).collect()}
    wanted = {g: most if isinstance(most, int) else most.get(g, 0) for g in counts}
    wanted = {g: w for g, w in wanted.items() if w > 0}
    share = {g: min(1.0, (1.3 * w + 40) / counts[g]) for g, w in wanted.items()}
    bounds: dict[Any, int] = {}
    while left := [g for g in wanted if g not in bounds]:
        tops = {g: min((1 << 63) - 1, int(share[g] * 2.0**64) - (1 << 63)) for g in left}
        under = F.lit(False)
        for g, top in tops.items():
            under |= F.col("g").eqNullSafe(F.lit(g)) & (F.col("h") <= top)
        found: dict[Any, list[tuple[int, int]]] = {g: [] for g in left}
        for r in keys.where(under).groupBy("g", "h").agg(F.max("n").alias("n")).collect():
            found[r.g].append((r.h, r.n or 0))
        for g, own in found.items():
            if len(own) < wanted[g] and share[g] < 1:
                share[g] = min(1.0, 4 * share[g])
                continue
            held = 0
            for k, (h, n) in enumerate(sorted(own)[: wanted[g]]):
                held += n
                if k and held > most_bytes:
                    break
                bounds[g] = h
    return bounds


def fitted(rows: DataFrame, train: Callable[[list[tuple]], Any]) -> Any:
    """train(rows in order) of a table of a bounded size, in one task of an executor: texts do not come to the driver,
    and if the executor is lost, another one does it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        got = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda row: [(x is not None, x) for x in row])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(got))], pa.binary())], ["fitted"])

    found = rows.repartition(1).mapInArrow(tidy(run), "fitted binary").head()
    return pickle.loads(found.fitted) if found else train([])


def held_out(id_column: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(named(id_column).cast("string")) % parts == part, F.lit(False))
