"""Benchmark passages in training texts: n-gram seeds, then Smith-Waterman alignment.

One pass over all documents looks every word n-gram of the benchmark up in each whole text, however frequent it is: an
edited copy may keep any of them. Where the words around the seeds could still reach the score, the item is aligned
with them. Alignments are kept whose score is a share of the item's best possible one, or that of an excerpt of so many
words, however long the item is. The pass goes by rows and moves no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, named, slices, table, texts_of, with_nulls
from .words import Words, hash64

#: Words of a seed, and the least share of an item's own score.
SEED_WORDS, THRESHOLD = 3, 0.5
#: Words of a verbatim excerpt whose score is enough, whatever share of the item's own score it is.
EXCERPT_WORDS = 13
MATCH, MISMATCH, GAP = 2, -1, -1
#: Benchmark text that is indexed and sent to the executors at once; a larger benchmark goes in several blocks.
BLOCK_BYTES = 8 << 20
#: Cells of alignments done together, and seeds (of whole texts) looked at together.
CELLS, HITS = 1 << 19, 1 << 20
_OTHER = re.compile(r"[^\w\n]+|_+")
_WORD = re.compile(r"\S+")


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash of each word's lower-case letters and digits; 0 without any."""
    plain = _OTHER.sub("", "\n".join(words).lower()).split("\n") if words else []
    return np.fromiter((hash64(w) | 1 if w else 0 for w in plain), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : len(hashes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _owned(hashes: np.ndarray, items: np.ndarray) -> np.ndarray:
    """A hash of each word together with its item."""
    out = (hashes ^ (items.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


class Index:
    """The n-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], n: int = SEED_WORDS):
        self.ids = [i for i, _ in items]
        split = [text.split() for _, text in items]
        table = dict.fromkeys(w for words in split for w in words)
        table = dict(zip(table, word_hashes(list(table)).tolist(), strict=True))
        self.words = [np.array([h for w in words if (h := table[w])], np.uint64) for words in split]
        self.lengths = sorted({min(n, len(w)) for w in self.words if len(w)})
        rows = []  # of each n-gram of each item: hash, length, item, position
        for k, w in enumerate(self.words):
            if len(w):
                g = grams(w, min(n, len(w)))
                rows.append(np.stack([g.view(np.int64), np.full(len(g), min(n, len(w))), np.full(len(g), k), np.arange(len(g))]))
        rows = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0), np.int64)
        self.by = {}
        for length in self.lengths:
            own = rows[:, rows[1] == length]
            own = own[:, np.argsort(own[0].view(np.uint64), kind="stable")]
            self.by[length] = self._table(own)
        owned = [_owned(w, np.full(len(w), k)) for k, w in enumerate(self.words)]
        self.owned = np.unique(np.concatenate(owned)) if owned else np.zeros(0, np.uint64)

    @staticmethod
    def _table(own: np.ndarray) -> tuple[np.ndarray, ...]:
        keys, first, counts = np.unique(own[0].view(np.uint64), return_index=True, return_counts=True)
        low = np.zeros(1 << 20, bool)
        low[keys & np.uint64((1 << 20) - 1)] = True
        return keys, first, counts, own[2], own[3], low

    def found(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, place of the n-gram among the keys) of the index's n-grams in a row of words."""
        keys, *_, low = self.by[length]
        g = grams(hashes, length)
        at = np.flatnonzero(low[g & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
        real = keys[place] == g[at]
        return at[real], place[real]

    def common(self, items: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
        """How many words of each window its item has: no alignment of both matches more."""
        sizes = np.array([len(w) for w in windows], np.int64)
        owned = _owned(np.concatenate(windows), np.repeat(items, sizes))
        place = np.minimum(np.searchsorted(self.owned, owned), len(self.owned) - 1)
        return np.diff(np.cumsum(np.r_[0, self.owned[place] == owned])[np.cumsum(np.r_[0, sizes])])


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end of its alignment in the window) of each item against its window."""
    best, ends = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    sizes = np.array([[len(a), len(b)] for a, b in zip(items, windows, strict=True)]).reshape(-1, 2)
    order = np.lexsort((sizes[:, 0], sizes[:, 1]))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * sizes[order[at + n], 1] * 64 <= CELLS * 8 and sizes[order[at + n], 1] <= 2 * sizes[order[at], 1] + 8:
            n += 1
        some = order[at : at + n]
        m, w = sizes[some].max(axis=0)
        left, right = np.zeros((n, m), np.uint64), np.zeros((n, w), np.uint64)
        for k, s in enumerate(some):
            left[k, : len(items[s])], right[k, : len(windows[s])] = items[s], windows[s]
        slope = np.arange(w, dtype=np.int32) * -GAP
        h = np.zeros((n, w), np.int32)
        top, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for i in range(m):
            a = left[:, i : i + 1]
            step = np.where((right == a) & (a != 0), MATCH, MISMATCH).astype(np.int32)
            t = step.copy()
            t[:, 1:] += h[:, :-1]
            np.maximum(t, h + GAP, out=t)
            np.maximum(t, 0, out=t)
            h = np.maximum.accumulate(t + slope, axis=1) - slope
            most = h.argmax(axis=1)
            value = h[np.arange(n), most]
            better = value > top
            top[better], end[better] = value[better], most[better]
        best[some], ends[some] = top, end
        at += n
    return best, ends


def find(index: Index, hashes: np.ndarray, sizes: np.ndarray, threshold: float = THRESHOLD, excerpt: int | None = None) -> list[tuple[int, int, float, int, int]]:
    """(text, item, share of the item's score, first and last word) of the best alignment of each item that a text
    shares a seed with, if it reaches the threshold, or the score of an excerpt of so many words. hashes: of the words of
    all texts in a row."""
    begins = np.cumsum(np.r_[0, sizes])
    seeds, load = [], np.zeros(len(sizes), np.int64)
    for length in index.lengths:
        at, place = index.found(hashes, length)
        text = np.searchsorted(begins, at, side="right") - 1
        inside = at + length <= begins[text + 1]
        at, place, text = at[inside], place[inside], text[inside]
        seeds.append((length, at, place, text))
        load += np.bincount(text, index.by[length][2][place], minlength=len(sizes)).astype(np.int64)
    turn = np.cumsum(load) // HITS
    cuts = np.r_[np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]), len(sizes)] if load.any() else []
    found = []
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        some = [(n, *(x[slice(*np.searchsorted(text, [first, last]))] for x in (at, place, text))) for n, at, place, text in seeds]
        found += _aligned(index, hashes, begins, some, threshold, excerpt)
    return found


def _aligned(index: Index, hashes: np.ndarray, begins: np.ndarray, seeds: list[tuple], threshold: float, excerpt: int | None) -> list[tuple[int, int, float, int, int]]:
    """What find() gives, of the seeds (length, word, place, text) of some whole texts."""
    rows = []
    for length, at, place, text in seeds:
        _, first, counts, item, position, _ = index.by[length]
        each = counts[place]
        hit = np.repeat(first[place] - np.cumsum(np.r_[0, each[:-1]]), each) + np.arange(each.sum()) if len(at) else np.zeros(0, np.int64)
        rows.append(np.stack([np.repeat(text, each), item[hit], np.repeat(at, each) - position[hit]]))
    rows = np.concatenate(rows, axis=1)
    if not rows.shape[1]:
        return []
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    length = np.array([len(w) for w in index.words])[rows[1]]
    slack = np.maximum(4, length // 4)
    new = np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) > slack[1:])]
    cut = np.flatnonzero(new)
    last = np.r_[cut[1:], len(new)] - 1
    text, item, length = rows[0, cut], rows[1, cut], length[cut]
    low = np.maximum(rows[2, cut] - slack[cut], begins[text])
    high = np.minimum(rows[2, last] + length + slack[cut], begins[text + 1])
    windows = [hashes[a:b] for a, b in zip(low, high, strict=True)]
    common = index.common(item, windows)
    enough = np.flatnonzero((common / length >= threshold) | (common >= (np.inf if excerpt is None else excerpt)))
    text, item, length, low = text[enough], item[enough], length[enough], low[enough]
    items, windows = [index.words[k] for k in item], [windows[k] for k in enough]
    score, end = align(items, windows)
    share = score / (MATCH * length)
    good = np.flatnonzero((share >= threshold) | (score >= (np.inf if excerpt is None else MATCH * excerpt)))
    # where it begins: the alignment of both turned round, from its end
    _, back = align([items[k][::-1] for k in good], [windows[k][: end[k] + 1][::-1] for k in good])
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for k, b in zip(good.tolist(), back.tolist(), strict=True):
        stop = int(low[k] + end[k] - begins[text[k]])
        own = (float(share[k]), -(stop - b), stop)
        best[int(text[k]), int(item[k])] = max(own, best.get((int(text[k]), int(item[k])), own))
    return [(t, i, s, -a, e) for (t, i), (s, a, e) in best.items()]


def _words(words: Words, part: pa.RecordBatch, at: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    texts = texts_of(part, at)
    numbers, sizes = words.numbers(texts)
    hashes = words.rows[numbers]
    real = hashes != 0
    owner = np.repeat(np.arange(len(sizes)), sizes)[real]
    return texts, hashes[real], np.bincount(owner, minlength=len(sizes))


def annotate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", name: str = "matches", seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, excerpt: int | None = EXCERPT_WORDS) -> DataFrame:
    """docs with a column `name`: array<struct<item_id, score, start, end>> of the benchmark items found in the whole
    text, by item id; code points, end exclusive. Other columns and all rows stay; a column of that name is replaced.

    Null or empty texts, and an empty benchmark, give empty arrays. Items without a word are never found; items of one
    id are found each on its own; a null item id stays null. The benchmark is measured first: it is indexed in blocks
    of BLOCK_BYTES, each of which goes over all documents."""
    spark = docs.sparkSession
    docs, benchmark = with_nulls(docs, text_column), with_nulls(benchmark, "text")
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    if text_column not in columns:
        raise ValueError(f"{name} is the text itself")
    at = columns.index(text_column)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    items = benchmark.where("length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head().n
    blocks = max(1, -(-size // BLOCK_BYTES))
    none = F.expr("cast(array() as array<struct<item_id: bigint, score: double, start: bigint, end: bigint>>)").alias(name)
    out = docs.select(*[named(c) for c in columns], none)
    for block in range(blocks if size else 0):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = Index([(r.item_id, r.text) for r in some], seed_words)
        out = map_rows(out, _matcher(spark.sparkContext.broadcast(index), at, threshold, excerpt, kind, len(columns)))
        del index, some
    return out


def _matcher(shared, at: int, threshold: float, excerpt: int | None, kind: pa.DataType, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words = shared.value, Words(word_hashes)
        for part in slices(batches, at):
            texts, hashes, sizes = _words(words, part, at)
            rows = part.column(last).to_pylist()
            by: dict[int, list] = {}
            for t, item, share, start, end in find(index, hashes, sizes, threshold, excerpt):
                by.setdefault(t, []).append((item, share, start, end))
            for t, found in by.items():
                spans = [(m.start(), m.end()) for m in _WORD.finditer(texts[t])]
                real = [s for s, h in zip(spans, word_hashes(texts[t].split()).tolist(), strict=True) if h]
                more = [{"item_id": index.ids[i], "score": s, "start": real[a][0], "end": real[b][1]} for i, s, a, b in found]
                rows[t] = sorted([*rows[t], *more], key=lambda m: (m["item_id"] is not None, m["item_id"] or 0, m["start"]))
            yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(rows, kind)], part.schema.names)

    return run


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, contaminated, item_ids, best_score, matches (see annotate()). Null and empty texts
    and an empty benchmark give no match; repeated rows and null ids stay; no rows give no rows. Other columns play no
    part."""
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.array_max(F.transform("matches", lambda m: m["score"]))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.transform("matches", lambda m: m["item_id"]).alias("item_ids"), best.alias("best_score"), "matches")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those in which a benchmark item was found. All columns stay, whatever they are called; null and
    empty texts and null ids are kept like others."""
    name = "matches"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    found = annotate(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.where(F.size(name) == 0).drop(name)
