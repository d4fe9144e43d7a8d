"""Groups of documents whose sets of word shingles have a Jaccard similarity of a bound and more, without loss.

A common global order of shingles makes candidates: of two sets that are similar enough, the first few of each (a fifth
and one more, at four fifths) have a shingle in common. Common shingles come last in that order, so that text which
many documents hold does not bring them together. Candidates are verified on the whole sets: first what another method
proposes (SimHash, in the pipeline); then each set with the least one of every shingle that it shares, which makes one
group of many near copies without pairs of all; then all pairs of sets that share a shingle and are not in one group
yet. Equal sets are one from the start. The sets, larger than the texts, are made again for candidates alone; pairs are
first compared by bitmaps of parities, which differ in at most as many bits as the sets in shingles, and meet only if
these are close enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, named, slices, swept, texts_of, tidy, with_nulls, written
from .components import components

#: Words of a shingle, and the least similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Shingles among the first of more sets than this come last, at most so many; any choice gives the same groups.
COMMON, MOST = 32, 1 << 18
#: Words of 64 bits in a bitmap of parities.
BITMAP = 16
#: Pivots that a shingle has at most in a round, and rounds; any choice gives the same groups.
PIVOTS, ROUNDS = 8, 2


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted; one of all words if there are fewer, none without a word."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    count = max(1, len(parts) - words + 1) if parts else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(parts[i : i + words])) for i in range(count)), np.uint64, count)).view(np.int64)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, sizes]).astype(np.int32)), pa.array(values))


def _bitmap(grams: np.ndarray) -> np.ndarray:
    odd = np.bincount(grams.view(np.uint64) % np.uint64(64 * BITMAP), minlength=64 * BITMAP) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, words: int, similar: tuple[int, int], common: np.ndarray, columns: list[str]) -> DataFrame:
    """Of docs (id, text) the columns that are asked for: id; mark, a hash of the set; n, its size; grams, the set;
    bits, its bitmap; firsts, the shingles that come first where those of common come after all others."""
    last = docs.sparkSession.sparkContext.broadcast(np.sort(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets = [shingles(t, words) for t in texts_of(part, 1)]
            n = np.array([len(s) for s in sets], np.int32)
            grams = np.concatenate(sets)
            out = {"id": part.column(0), "n": pa.array(n)}
            out["mark"] = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
            if "grams" in columns:
                out["grams"] = _lists(n, grams)
            if "bits" in columns:
                out["bits"] = _lists(np.full(len(sets), BITMAP), np.concatenate([_bitmap(s) for s in sets]))
            if "firsts" in columns:
                most = np.where(n > 0, n * (similar[1] - similar[0]) // similar[1] + 1, 0)
                owner, begins = np.repeat(np.arange(len(n)), n), np.cumsum(np.r_[0, n])
                order = np.lexsort((np.isin(grams, last.value), owner))  # stable: by hash within
                out["firsts"] = _lists(most, grams[order[np.arange(len(grams)) - begins[owner] < most[owner]]])
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], columns)

    kinds = {"id": "long", "mark": "long", "n": "int", "grams": "array<long>", "bits": "array<long>", "firsts": "array<long>"}
    return docs.mapInArrow(tidy(run), ", ".join(f"{c} {kinds[c]}" for c in columns))


def _able(similar: tuple[int, int]) -> Column:
    """Whether sets a and b can be similar enough, by sizes na and nb and bitmaps ba and bb."""
    close = F.least("na", "nb") * similar[1] >= F.greatest("na", "nb") * similar[0]
    apart = F.bit_count(F.col("ba")[0].bitwiseXOR(F.col("bb")[0]))
    for k in range(1, BITMAP):
        apart += F.bit_count(F.col("ba")[k].bitwiseXOR(F.col("bb")[k]))
    # of n in both sets together, at least n * p / (p + q) are common twice: the others are the difference
    return close & (apart * sum(similar) <= (F.col("na") + F.col("nb")) * (similar[1] - similar[0]))


def _similar(pairs: DataFrame, marks: DataFrame, docs: DataFrame, words: int, similar: tuple[int, int], able: bool = False) -> DataFrame:
    """Those of the distinct pairs (a, b) of marks that are similar enough, by their whole sets. able: the pairs are
    known to be close enough by bitmaps."""
    if not able:
        one, two = (marks.select(F.col("mark").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")
        pairs = pairs.join(one, "a").join(two, "b").where(_able(similar)).select("a", "b")
    pairs = written(pairs, "candidates")
    needed = pairs.select(F.col("a").alias("mark")).unionByName(pairs.select(F.col("b").alias("mark"))).distinct()
    needed = written(marks.select("mark", "id").join(needed, "mark", "left_semi"), "needed")
    texts = docs.join(needed.select("id").distinct(), "id", "left_semi")
    some = written(shingle_sets(texts, words, similar, np.zeros(0, np.int64), ["mark", "n", "grams"]), "candidate-sets")
    # rows of one id or of one set: one of them will do
    some = some.join(needed.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])
    one, two = (some.select(F.col("mark").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}")) for x in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    near = written(pairs.join(one, "a").join(two, "b").where(both * sum(similar) >= (F.col("na") + F.col("nb")) * similar[0]).select("a", "b"), "similar")
    for done in (some, needed, pairs):
        forget(done)
    swept(docs.sparkSession)
    return near


def _pivots(placed: DataFrame, found: DataFrame | None, turn: int) -> DataFrame:
    """Pairs (a, b) of placed (g, mark, c): each mark with a few pivots of its shingles that are not in its group. A
    shingle's pivots are the marks of the least hashes of some classes, found by partial sums; they are written, so
    that the join back holds no aggregate and a very common shingle can be split."""
    h = F.xxhash64(F.lit(turn), "mark")
    of = [F.pmod(h, F.lit(PIVOTS)) == k for k in range(PIVOTS)]
    chosen = written(placed.groupBy("g").agg(*[F.min_by(F.when(x, F.col("mark")), F.when(x, h)).alias(f"p{k}") for k, x in enumerate(of)]), "pivots")
    own = placed.join(chosen, "g").groupBy("mark", "c").agg(*[F.min(f"p{k}").alias(f"p{k}") for k in range(PIVOTS)])
    pairs = own.select(F.col("mark").alias("a"), "c", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("b")).where("b <> a")
    if found is not None:
        other = found.select(F.col("node").alias("b"), F.col("component").alias("d"))
        pairs = pairs.join(other, "b", "left").where(F.col("c") != F.coalesce("d", "b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _proposed(near: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of marks: each document of near (doc_id, component_id) with the one that its class is named after.
    Equal sets are one before the second join, in which the name of a large class is common."""
    own = rows.groupBy("id").agg(F.min("mark").alias("mark"))
    moved = near.where("doc_id <> component_id").select(F.col("doc_id").alias("id"), F.col("component_id").alias("name"))
    classed = written(moved.join(own, "id").select(F.col("mark").alias("a"), "name").distinct(), "classed")
    pairs = classed.join(own.select(F.col("id").alias("name"), F.col("mark").alias("b")), "name").where("a <> b")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = SHINGLE,
    similar: tuple[int, int] = SIMILAR,
    near: DataFrame | None = None,
) -> DataFrame:
    """(id, component) of every row with an id: component is the least id that can be reached over pairs of documents
    of that similarity. Texts without words are equal. Rows of one id are one document, whatever their texts.

    near: (doc_id, component_id) of classes that another method has found. They are verified before anything else, and
    pairs are made only of what they leave apart; any classes give the same groups."""
    docs = with_nulls(docs, text_column)
    docs = docs.select(named(id_column).cast("long").alias("id"), named(text_column).alias("text")).where("id is not null")
    heads = written(shingle_sets(docs, words, similar, np.zeros(0, np.int64), ["id", "mark", "n", "bits", "firsts"]), "heads")
    counts = heads.select(F.explode("firsts").alias("g")).groupBy("g").count().where(F.col("count") > COMMON)
    common = np.array([r.g for r in counts.orderBy(F.desc("count"), "g").limit(MOST).collect()], np.int64)
    rows = written(heads.select("id", "mark", "n", "bits"), "marks-of-ids")
    forget(heads)
    least = rows.groupBy("mark").agg(F.min("id").alias("id"))
    marks = written(rows.join(least, ["mark", "id"], "left_semi").dropDuplicates(["mark"]), "marks")
    firsts = written(shingle_sets(docs, words, similar, common, ["mark", "firsts"]).select(F.explode("firsts").alias("g"), "mark"), "firsts")
    # written, so that the join back holds no aggregate and a very common shingle can be split
    shared = written(firsts.groupBy("g").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high").select("g"), "shared-shingles")
    members = written(firsts.join(shared, "g").distinct(), "members")
    forget(firsts)
    forget(shared)
    swept(docs.sparkSession)

    # rows of one id are one document
    twice = rows.groupBy("id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high").select("id", "low")
    links = rows.join(twice, "id").select(F.col("mark").alias("a"), F.col("low").alias("b"))
    found, left = None, members.withColumn("c", F.col("mark"))
    for turn in range(0 if near is None else -1, ROUNDS):
        pairs = _proposed(near, rows) if turn < 0 else _pivots(left, found, turn)
        links = links.unionByName(_similar(pairs, marks, docs, words, similar))
        if found is not None:
            forget(left)
        found = written(components(links, "a", "b"), "groups-so-far")
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        # what is left: sets that share a shingle with one of another group
        placed = members.join(found, members["mark"] == found["node"], "left").select("g", "mark", F.coalesce("component", "mark").alias("c"))
        placed = written(placed, "placed")
        apart = written(placed.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("g"), "apart")
        left = written(placed.join(apart, "g", "left_semi"), "left")
        for done in (placed, apart):
            forget(done)
        swept(docs.sparkSession)
        if left.isEmpty():
            break

    # all pairs of those that can be similar enough; the conditions hold in the join, so that no others come out of it
    left = left.join(marks.select("mark", "n", "bits"), "mark")
    one, two = (left.select("g", F.col("mark").alias(x), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")
    pairs = one.join(two, (one["g"] == two["g"]) & (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & _able(similar))
    more = _similar(pairs.select("a", "b").distinct(), marks, docs, words, similar, able=True)
    final = written(components(links.unionByName(more), "a", "b"), "groups")
    out = rows.select("id", "mark").join(final, rows["mark"] == final["node"], "left").select("id", F.coalesce("component", "mark").alias("c"))
    out = written(out, "placed-ids")
    least = written(out.groupBy("c").agg(F.min("id").alias("component")), "least-ids")
    for done in (rows, marks, members, final):
        forget(done)
    return out.join(least, "c").select("id", "component")
