"""Near duplicates by SimHash: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Candidates come from the pigeonhole rule: with radius + 2 blocks of bits, two fingerprints within the radius agree in
two whole blocks at least. All fingerprints that agree in a pair of blocks form a bucket; a bucket is compared whole,
by bit planes: plane j holds bit j of 64 fingerprints in one machine word, and a carry-save counter of four planes
holds their 64 distances. Words in which no lane can still be within the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, named, slices, table, texts_of, tidy, with_nulls, written
from .components import components
from .jaccard import groups

#: Lanes that are compared together; a bucket of more is compared whole all the same.
LANES = 1 << 16
#: Planes between two looks at which words can be abandoned.
PLANES = 8
#: Buckets of more fingerprints than this are dealt out as pairs of tiles, over many tasks.
TILE = 1 << 18
#: Differing bits of fingerprints that the pipeline's stage takes as candidates; any choice gives the same groups.
CANDIDATES = 8
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text; zero if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return _majority(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(joined[i:j], seed) for i, j in zip(starts, ends, strict=True)], dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp bigint) of every row. Null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            fps = [fingerprint(t, shingle, seed) for t in texts_of(part, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    docs = with_nulls(docs, text_column)
    return docs.select(named(id_column).cast("long").alias("id"), named(text_column).alias("text")).mapInArrow(tidy(run), "id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words + 1): plane j has bit j of each fingerprint, 64 to a word; one word more, of zeros."""
    words = -(-len(fps) // 64) + 1
    bits = np.zeros((64, words * 64), dtype=np.uint8)
    bits[:, : len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _lanes(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(flags) // 64) * 64, dtype=np.uint8)
    out[: len(flags)] = flags
    return np.packbits(out, bitorder="little").view(np.uint64)


def _within(planes: np.ndarray, shift: int, same: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i of which fingerprint i and i + shift differ in at most radius bits; same: lanes that count, packed."""
    skip, turn = divmod(shift, 64)
    at = np.flatnonzero(same)
    ok = same[at]
    counter = [np.zeros(len(at), dtype=np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(at), dtype=np.uint64)
    for first in range(0, 64, PLANES):
        for j in range(first, first + PLANES):
            plane = planes[j]
            other = plane[at + skip] >> np.uint64(turn)
            if turn:
                other |= plane[np.minimum(at + skip + 1, len(plane) - 1)] << np.uint64(64 - turn)
            carry = plane[at] ^ other
            for k, digit in enumerate(counter):
                counter[k], carry = digit ^ carry, digit & carry
            over |= carry
        out = over | _more(counter, radius)
        if not (alive := (ok & ~out) != 0).all():
            at, ok, over = at[alive], ok[alive], over[alive]
            counter = [c[alive] for c in counter]
        if not len(at):
            break
    hits = ok & ~(over | _more(counter, radius))
    lanes = np.unpackbits(hits.view(np.uint8), bitorder="little").reshape(-1, 64)
    word, bit = np.nonzero(lanes)
    return at[word] * 64 + bit


def _more(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    more = np.zeros_like(counter[0])
    level = np.full_like(counter[0], FULL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            level &= counter[k]
        else:
            more |= level & counter[k]
            level &= ~counter[k]
    return more


def _join(roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Unites the sets of left and right; roots[i] <= i leads to the least member."""
    while True:
        a, b = roots[left], roots[right]
        if not (apart := a != b).any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while ((up := roots[roots]) != roots).any():
            roots[:] = up


def linked(fps: np.ndarray, groups: np.ndarray, radius: int = 4) -> np.ndarray:
    """For each fingerprint the position of the first one of its group that it is linked to, straight or over others
    of the group. groups: equal numbers stand together."""
    final = np.arange(len(fps))
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(fps) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(fps)])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    if not len(order):
        return final
    # lanes by falling size of their group: those that a shift still concerns come first
    lane = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in order])
    group = np.repeat(np.arange(len(order)), sizes[order])
    size = np.repeat(sizes[order], sizes[order])
    shift, look = 1, 4
    roots = np.arange(len(lane))
    planes = _planes(fps[lane])
    while len(lane):
        active = int(np.searchsorted(-size, -shift, side="left"))  # groups larger than the shift
        if active <= shift:
            break
        same = _lanes(group[: active - shift] == group[shift:active])
        hits = _within(planes, shift, same, radius)
        if len(hits):
            _join(roots, hits, hits + shift)
        shift += 1
        if shift == look:  # groups that are one set already need no more comparisons
            look *= 2
            first = np.r_[True, group[1:] != group[:-1]]
            apart = np.add.reduceat((roots == np.arange(len(roots))).astype(np.int64), np.flatnonzero(first))[np.cumsum(first) - 1] > 1
            keep = apart & (size > shift)
            done = ~keep
            final[lane[done]] = lane[roots[done]]
            new = np.cumsum(keep) - 1
            roots = new[roots[keep]]
            lane, group, size = lane[keep], group[keep], size[keep]
            planes = _planes(fps[lane])
    final[lane] = lane[roots]
    return final


def _buckets(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp, id): each distinct fingerprint once for every pair of blocks; the key names the pair and its bits."""
    blocks, edges = radius + 2, [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    part = [f"(shiftrightunsigned(fp, {edges[i]}) & {(1 << edges[i + 1] - edges[i]) - 1}L)" for i in range(blocks)]
    keys = [f"shiftleft({n}L, 56) | shiftleft({part[i]}, {edges[j + 1] - edges[j]}) | {part[j]}" for n, (i, j) in enumerate(combinations(range(blocks), 2))]
    return fps.select(F.explode(F.array(*[F.expr(k) for k in keys])).alias("key"), "fp", "id")


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, id) sorted by key: a link from every fingerprint to the first of its set in the bucket."""

    def links(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        at = 0
        while at < len(keys):  # whole buckets, about LANES at once
            k = np.searchsorted(cuts, at + LANES)
            end = int(cuts[k]) if k < len(cuts) else len(keys)
            first = linked(fps[at:end], keys[at:end], radius)
            if len(moved := np.flatnonzero(first != np.arange(end - at))):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:end][moved]), pa.array(ids[at:end][first[moved]])], ["a", "b"])
            at = end

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held.append(cols)
        rows += batch.num_rows
        if rows >= LANES and cols[0][0] != cols[0][-1]:
            keys, fps, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from links(keys[:cut], fps[:cut], ids[:cut])
            held, rows = [(keys[cut:], fps[cut:], ids[cut:])], len(keys) - cut
    if rows:
        yield from links(*(np.concatenate(c) for c in zip(*held, strict=True)))


def near_links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b) of ids: links that connect the same sets as all pairs within the radius do. fps: distinct (fp, id).

    A bucket of more than `tile` fingerprints becomes pairs of tiles, so that no task compares it alone; whether there
    can be one is known from the count."""
    buckets = _buckets(fps, radius)
    if fps.count() > tile:
        hot = buckets.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("n"))
        own = F.expr("pmod(xxhash64(fp), n)")
        buckets = buckets.join(hot, "key", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", own)
        buckets = buckets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pair = F.xxhash64("key", F.least("own", F.col("other").cast("long")), F.greatest("own", F.col("other").cast("long")))
        buckets = buckets.select(F.when(F.col("n") == 1, F.col("key")).otherwise(pair).alias("key"), "fp", "id")
    dealt = buckets.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(tidy(lambda batches: _links(batches, radius)), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least id that can be reached over links between
    fingerprints of at most `radius` differing bits.

    Equal fingerprints are linked; texts without words have fingerprint zero and are linked like others. Rows of one id
    are one document, whatever their texts. A row without an id is fingerprinted, links nothing, and has no component.
    No rows give no rows. Other columns of docs play no part."""
    prints = written(fingerprints(docs, id_column, text_column, shingle, seed), "fingerprints")
    distinct = written(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    first = distinct.select("fp", F.col("id").alias("first"))
    # ids of a repeated id's fingerprints are one document: link each fingerprint's first id to such ids
    repeated = prints.where("id is not null").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("id")
    again = prints.join(repeated, "id", "left_semi").join(first, "fp").select(F.col("id").alias("a"), F.col("first").alias("b"))
    found = components(near_links(distinct.select("fp", "id"), radius).unionByName(again), "a", "b")
    # only fingerprints whose component is not simply their one document's id need a look-up
    known = distinct.join(found, distinct["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component"), "n", "id")
    known = known.where("n > 1 or component <> id").select(F.col("fp").alias("kfp"), F.col("component"))
    out = prints.join(known, prints["fp"] == known["kfp"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), "fp", component.alias("component_id"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, fingerprint, component_id (see near_duplicates()). Null and empty texts have
    fingerprint zero and are linked like others; a row without an id has no component; repeated rows stay; no rows
    give no rows. Other columns play no part."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that another document of their group stands for: the one of the least id stays. Classes of
    fingerprints within CANDIDATES bits are verified by the similarity of five-word shingles, and similar documents that
    lie further apart are found by prefixes; the radius of four alone is the contract of op7.
    Rows without an id stay, and so do all columns, whatever they are called."""
    near = near_duplicates(docs, radius=CANDIDATES)
    classes = written(near.where("doc_id <> component_id").select("doc_id", "component_id").distinct(), "classes")
    forget(near)
    gone = written(groups(docs, near=classes).where("id <> component").select(F.col("id").alias("gone_id")).distinct(), "gone")
    forget(classes)
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
