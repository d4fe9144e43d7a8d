"""Nearest neighbours by inner product, with collision counting over single projections.

Vectors are brought to one length by one more component, so that the largest inner product is the least distance. Each
projection of a block of rows is a sorted array; the directions are those of several random orthonormal bases, so that
their collisions add up evenly. A query opens a window around its own place in the arrays in which it lies furthest
out, where a window of a width holds the fewest other rows; a row that is in the window in enough arrays has collided
often enough to be verified with its exact inner product. Counting goes over the rows within the windows alone.

The radius that windows and counts are made for comes from probes: a few queries whose distances to all rows are put
in a histogram. All windows are widened to larger radii (virtual rehashing) until enough rows within the radius are
found: first up to a radius that holds the nearest rows of nearly all probes, in a second round for the queries that
lack rows so far a wider one, and in a last one each block's windows until its own nearest rows are found.

Rows are dealt to blocks of a bounded size and queries to parts of a bounded size; every block meets every part, and
gives only rows within the radius back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import least, named, table, tidy, written

#: Rows of a block at most, about; blocks there are at least, if each has LEAST_ROWS. Queries of a part, and partitions.
BLOCK_ROWS, LEAST_BLOCKS, LEAST_ROWS = 1 << 14, 16, 1 << 12
PART_QUERIES, PARTITIONS = 1 << 16, 1 << 16
#: Arrays of a block, about (whole bases), and those that a query looks at.
PROJECTIONS, LOOKED_AT, SEED = 512, 64, 3
#: Half a window, in radii; a row at the radius itself has this many standard deviations more collisions than needed.
HALF, MISS = 1.0, 0.7
#: Queries whose distances to all rows give the radii, bins of their histogram, and the shares of them that find
#: their nearest rows within each radius; radii closer than APART are one.
PROBES, BINS, SHARES, APART = 64, 512, (0.1, 0.95), 0.85
#: Factor of the radius of the second round, and of each step of the last one; from FAR on all rows are verified.
SECOND, WIDEN, FAR = 1.08, 1.15, 1.7
#: Queries looked up together.
TOGETHER = 256
_GRID = np.linspace(-9, 9, 8193)
_NORMAL = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _GRID])


def directions(size: int) -> np.ndarray:
    """Rows of random orthonormal bases of so many dimensions, of length sqrt(size)."""
    rng = np.random.default_rng(SEED)
    bases = [np.linalg.qr(rng.normal(size=(size, size)))[0].T for _ in range(max(1, round(PROJECTIONS / size)))]
    return np.concatenate(bases)[: max(PROJECTIONS, LOOKED_AT)] * math.sqrt(size)


class Block:
    """The sorted projections of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, k: int, lines: np.ndarray):
        self.ids, self.vectors, self.longest, self.k, self.lines = ids, vectors.astype(np.float64), longest, k, lines
        unit = self.vectors / longest
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", unit, unit)))
        # all arrays in one: each lies in a range of its own
        self.gap = 4 * math.sqrt(lines.shape[1]) + 8
        self.order = np.empty(len(lines) * len(ids), np.intp)
        self.places = np.empty(len(lines) * len(ids))
        for j, line in enumerate(lines):
            own = unit @ line[:-1] + rest * line[-1]
            at = slice(j * len(ids), (j + 1) * len(ids))
            self.order[at] = order = np.argsort(own, kind="stable")
            self.places[at] = own[order] + self.gap * j
        self.looked_up = self.touched = self.verified = 0

    def search(self, owns: np.ndarray, queries: np.ndarray, radii: list[float] | None, start: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query (id, ids, inner products) of its nearest rows found within the last radius; without radii, of
        the nearest rows of the block, from the radius `start` on. Not the row of the query's own id."""
        for at in range(0, len(owns), TOGETHER):
            some = queries[at : at + TOGETHER].astype(np.float64)
            norms = np.sqrt((some * some).sum(axis=1))
            places = (some / norms[:, None]) @ self.lines[:, :-1].T
            looked = min(LOOKED_AT, len(self.lines))
            chosen = np.argpartition(-np.abs(places), looked - 1, axis=1)[:, :looked]
            places = np.take_along_axis(places, chosen, axis=1)
            first = self._windows(places, chosen, radii[0] if radii else start)
            for q, own in enumerate(owns[at : at + TOGETHER].tolist()):
                yield own, *self._search(own, some[q], norms[q], places[q : q + 1], chosen[q : q + 1], [x[q] for x in first], radii, start)

    def _windows(self, places: np.ndarray, chosen: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last rank of each window, and the collisions that are enough."""
        if radius >= FAR:
            none = np.zeros_like(chosen)
            return none, none, np.zeros(len(places), np.int64)
        half, edge = HALF * radius, self.gap / 2 - 1
        base = self.gap * chosen
        low = self.places.searchsorted(base + np.clip(places - half, -edge, edge), "left")
        high = self.places.searchsorted(base + np.clip(places + half, -edge, edge), "right")
        # a row at the radius lies about cos * place, with the sine as its deviation
        sine, away = radius * math.sqrt(1 - radius * radius / 4), radius * radius / 2 * np.abs(places)
        hit = np.interp((half - away) / sine, _GRID, _NORMAL) - np.interp((-half - away) / sine, _GRID, _NORMAL)
        enough = hit.sum(axis=1) - MISS * np.sqrt((hit * (1 - hit)).sum(axis=1))
        return low, high, np.maximum(0, np.floor(enough)).astype(np.int64)

    def _search(self, own: int, query: np.ndarray, norm: float, places: np.ndarray, chosen: np.ndarray, first: list, radii: list[float] | None, start: float) -> tuple[np.ndarray, np.ndarray]:
        n, steps = len(self.ids), list(radii or [start])
        low, high, enough = first
        counts = done = found = scores = None
        at = int(self.ids.searchsorted(own))
        me = at if at < n and self.ids[at] == own else -1
        self.looked_up += 1
        while True:
            if counts is None:
                parts = [self.order[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]
            else:  # the windows of before are counted already
                low, high, enough = (x[0] for x in self._windows(places, chosen, steps[0]))
                parts = [self.order[i:j] for i, j in zip([*low.tolist(), *old[1].tolist()], [*old[0].tolist(), *high.tolist()], strict=True)] if steps[0] < FAR else []
            more = np.bincount(np.concatenate(parts), minlength=n) if parts else np.zeros(n, np.int64)
            counts = more if counts is None else counts + more
            self.touched += sum(map(len, parts))
            old = low, high
            collided = counts >= enough
            if me >= 0:
                collided[me] = False
            fresh = (collided if done is None else collided & ~done).nonzero()[0]
            done = collided if done is None else collided | done
            self.verified += len(fresh)
            # summed row by row, so that equal vectors have equal scores
            new = (self.vectors[fresh] * query).sum(axis=1)
            found, scores = (fresh, new) if found is None else (np.concatenate([found, fresh]), np.concatenate([scores, new]))
            best = np.lexsort((self.ids[found], -scores))[: self.k]
            found, scores = found[best], scores[best]
            radius = steps.pop(0)
            least = self.longest * norm * (1 - radius * radius / 2) if radius < FAR else -math.inf
            if (len(found) == self.k and scores[-1] >= least) or radius >= FAR or (radii and not steps):
                break
            if not steps:
                steps = [radius * WIDEN]
        if radii:
            found, scores = found[scores >= least], scores[scores >= least]
        return self.ids[found], scores


@dataclass
class Plan:
    """Of the vectors of one size: the largest length, blocks, parts of the queries, number of its first cell, and the
    radii up to the one that holds the nearest rows of nearly all probes."""

    longest: float
    blocks: int
    parts: int
    cell: int
    radii: list[float]


def _probed(rows: DataFrame, plans: dict[int, Plan], k: int) -> None:
    """Sets the radii of each size, from the distances of a few queries to all rows."""
    bounds = least(rows.where("query").select(F.col("size").alias("g"), "h", F.lit(0).alias("n")), PROBES, 1)
    taken = F.lit(False)
    for size, h in bounds.items():
        taken |= (F.col("size") == size) & (F.col("h") <= h)
    probes: dict[int, list] = {}
    for r in rows.where("query").where(taken).dropDuplicates(["size", "h"]).select("size", "vector").collect():
        probes.setdefault(r["size"], []).append(r.vector)
    units = {size: (x := np.array(own, np.float64)) / np.linalg.norm(x, axis=1, keepdims=True) / plans[size].longest for size, own in probes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {size: np.zeros((len(u), BINS), np.int64) for size, u in units.items()}
        for batch in batches:
            for size, _, vectors in _vectors(batch, 0, 1):
                if size in units:
                    for a in range(0, len(vectors), 4096):
                        bins = np.clip(((1 - vectors[a : a + 4096] @ units[size].T) * (BINS / 2)).astype(np.int64), 0, BINS - 1)
                        for p in range(bins.shape[1]):
                            sums[size][p] += np.bincount(bins[:, p], minlength=BINS)
        for size, own in sums.items():
            probe, place = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(probe), size, np.int32)), pa.array(probe), pa.array(place), pa.array(own[probe, place])], ["size", "probe", "bin", "n"])

    bins = rows.select("size", "vector").mapInArrow(tidy(run), "size int, probe long, bin long, n long").groupBy("size", "probe", "bin").agg(F.sum("n").alias("n"))
    sums = {size: np.zeros((len(u), BINS), np.int64) for size, u in units.items()}
    for r in bins.collect():
        sums[r["size"]][r.probe, r.bin] = r.n
    for size, own in sums.items():
        enough = np.cumsum(own, axis=1) > k  # with the probe itself
        last = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, BINS)
        radii = np.sqrt(np.maximum(1e-6, 4 * last / BINS))
        for share in SHARES[::-1]:
            if not (radius := float(np.quantile(radii, share))) > APART * (plans[size].radii or [math.inf])[0]:
                plans[size].radii.insert(0, radius)


def _vectors(batch: pa.RecordBatch, size: int, vector: int, *by: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """(size, rows, matrix) of the runs of rows of one size, and of one value of the columns `by`."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (size, *by)]
    new = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            own = int(columns[0][a])
            yield own, slice(a, b), batch.column(vector).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(-1, own)


def _cells(batches: Iterator[pa.RecordBatch], plans: dict[int, Plan], k: int, round_: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, kind, size, id, vector) by cell, the rows of its block (kind 0) before the queries of its part."""
    cell, held, index, last, lines = None, [], None, None, {}
    for batch in batches:
        cells, kinds, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        for size, rows, vectors in _vectors(batch, 2, 4, 0, 1):
            if cells[rows.start] != cell:
                cell, held, index, last = cells[rows.start], [], None, None
            own = ids[rows]
            if kinds[rows.start] == 0:
                held.append((own, vectors))
                continue
            if not held:
                continue
            plan = plans[size]
            if index is None:
                if size not in lines:
                    lines[size] = directions(size + 1)
                mine, first = np.unique(np.concatenate([x for x, _ in held]), return_index=True)
                index = Block(mine, np.concatenate([v for _, v in held])[first], plan.longest, k, lines[size])
                held = [()]
            new = np.r_[own[0] != last, own[1:] != own[:-1]]  # rows of one id are one query
            last = own[-1]
            radii = [plan.radii, [plan.radii[-1] * SECOND], None][round_]
            found = [(np.full(len(i), q), i, x) for q, i, x in index.search(own[new], vectors[new], radii, plan.radii[-1])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition `query` chooses, the k nearest other rows found
    (all, if there are fewer), nearest first, ties to the smaller id; score is the inner product in double precision.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors
    of different sizes have no inner product: each query meets those of its own size. Rows of one id and size are one
    vector: which one, the least hash says. No rows, or a single one, give no rows."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dict(vectors.dtypes)[vector_column] == "void":
        return empty
    rows = vectors.select(named(id_column).cast("long").alias("id"), named(vector_column).alias("vector"), F.coalesce(query, F.lit(False)).alias("query"))
    rows = rows.where("id is not null and vector is not null and size(vector) > 0")
    rows = rows.where("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = written(rows.select("id", "vector", "query", F.size("vector").alias("size"), norm.alias("norm"), F.xxhash64("id").alias("h")), "vectors")
    plans: dict[int, Plan] = {}
    cells = 0
    for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.max("norm").alias("longest"), F.count(F.when(F.col("query"), 1)).alias("queries")).orderBy("size").collect():
        blocks = max(math.ceil(r.n / block_rows), min(LEAST_BLOCKS, math.ceil(r.n / LEAST_ROWS)))
        plans[r["size"]] = Plan(r.longest, blocks, max(1, math.ceil(r.queries / PART_QUERIES)), cells, [])
        cells += blocks * plans[r["size"]].parts
    if not plans:
        return empty
    _probed(rows, plans, k)
    for plan in plans.values():
        plan.radii = plan.radii or [FAR]

    # numbers of each size as columns; a size is one of few
    def of(name: str):
        return F.element_at(F.create_map(*[F.lit(x) for size, p in plans.items() for x in (size, int(getattr(p, name)))]), F.col("size"))

    block, part = F.pmod("h", of("blocks").cast("long")), F.pmod(F.xxhash64("h"), of("parts").cast("long"))
    data = rows.select("id", "vector", "size", F.lit(0).alias("kind"), block.alias("block"), F.explode(F.sequence(F.lit(0), of("parts") - 1)).alias("part"))
    asked, found = rows.where("query").select("id", "vector", "size", part.alias("part")), []
    partitions = min(cells, PARTITIONS)
    for round_ in range(3):
        queries = asked.select("id", "vector", "size", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), of("blocks") - 1)).alias("block"), "part")
        both = data.unionByName(queries).withColumn("cell", (of("cell") + F.col("block") * of("parts") + F.col("part")).cast("long"))
        dealt = both.withColumn("tie", F.xxhash64("vector")).repartitionById(partitions, F.pmod("cell", F.lit(partitions)).cast("int"))
        dealt = dealt.sortWithinPartitions("cell", "kind", "id", "tie").select("cell", "kind", "size", "id", "vector")
        step = dealt.mapInArrow(tidy(lambda batches, n=round_: _cells(batches, plans, k, n)), "query_id long, vec_id long, score double")
        if round_ == 2:
            found.append(step)
            break
        step = written(step, "near")
        full = step.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        found.append(step.join(full, "query_id", "left_semi"))
        left = written(asked.join(full, asked["id"] == full["query_id"], "left_anti"), "asked")
        if left.isEmpty():
            break
        asked = left
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of each row of embeddings whose vec_id is divisible by 20: query_id, rank, vec_id, score (see
    nearest()). Null ids and unfit vectors take no part; equal scores go by vec_id; repeated rows are one; no rows give
    no rows. Other columns play no part."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
