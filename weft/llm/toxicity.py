"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark whole documents, so tokens are labelled first: in toxic documents, those with a feature (the word, or a
beginning or end of it) that the labels tie to toxic documents beyond chance; in clean documents, none. Near copies of
an earlier document of the sample are left out there, so that a copied passage is no evidence. The field has two states
over the words of a sentence; forward and backward passes give each word's marginal. A document's score is a logistic
function of its largest marginals, fitted to the document labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FIT_BYTES, fitted, forget, held_out, least, map_rows, named, slices, table, texts_of, tidy, with_nulls, written
from .words import Words, hash64

#: Labelled documents that the field is fitted to at most, toxic and clean: those of the least hashes of the ids. The
#: text of either is bounded by FIT_BYTES too.
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
#: Documents of the sample that are tagged together when the score is fitted.
TAGGED = 256
BITS, EPOCHS, RATE, DECAY, SEED = 18, 30, 0.5, 1e-4, 5
#: Words of a chain at most; a longer sentence goes on in the next chain.
CHAIN = 64
#: Share of new word triples under which a sampled document is a copy of earlier ones.
NOVEL = 0.5
OFFENDING = 0.5
_WORD = re.compile(r"\S+")
_OTHER = re.compile(r"[^\w\n]+|_+")


def features(words: list[str]) -> np.ndarray:
    """(words, 6) buckets of each word: itself, its first 3 to 6 letters, its last 3; -1 for those it has not."""
    out = np.full((len(words), 6), -1, np.int32)
    mask = (1 << BITS) - 1
    for k, w in enumerate(_OTHER.sub("", "\n".join(words).lower()).split("\n") if words else []):
        if w:
            out[k, 0] = hash64(w) & mask
            for j in range(3, 7):
                if len(w) >= j:
                    out[k, j - 2] = hash64(f"{w[:j]}-") & mask
            if len(w) > 3:
                out[k, 5] = hash64(f"-{w[-3:]}") & mask
    return out


def ends_sentence(words: list[str]) -> np.ndarray:
    return np.array([w.rstrip("\"')]}»”’").endswith((".", "!", "?", "…")) for w in words], bool)


def chains(sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of the chains of texts of so many words; ends: words that end a sentence."""
    n = len(ends)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[1:] = ends
    first[np.cumsum(sizes)] = True
    begins = np.flatnonzero(first[:n])
    lengths = np.diff(np.r_[begins, n])
    parts = -(-lengths // CHAIN)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(np.r_[0, parts[:-1]]), parts)
    return np.repeat(begins, parts) + place * CHAIN, np.minimum(np.repeat(lengths, parts) - place * CHAIN, CHAIN)


def marginals(scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """The probability of the toxic state at each word. scores: of that state against the other, by word; moves: of
    the steps (plain to toxic, toxic to plain, toxic to toxic) against plain to plain; a chain begins after plain.

    With pairs, also the expected number of each of the three steps over all chains."""
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    still = np.searchsorted(-lengths, -np.arange(steps), side="left")  # chains longer than t
    e = np.exp(np.clip(scores, -30, 30))
    ot, to, tt = np.exp(np.clip(moves, -30, 30))
    ahead, back = np.zeros(len(scores)), np.ones(len(scores))
    r = np.zeros(len(begins))
    for t in range(steps):  # toxic against plain, of all that leads up to the word
        m = still[t]
        at = begins[:m] + t
        r = e[at] * (ot + r[:m] * tt) / (1 + r[:m] * to)
        ahead[at] = r
    b = np.ones(0)
    for t in range(steps - 1, -1, -1):  # and of all that comes after it
        m = still[t]
        at = begins[:m] + t
        now = np.ones(m)
        if len(b):
            x = e[at[: len(b)] + 1] * b
            now[: len(b)] = (to + tt * x) / (1 + ot * x)
        back[at] = b = now
    p = ahead * back / (1 + ahead * back)
    if not pairs:
        return p
    before = np.r_[0.0, ahead[:-1]]
    before[begins] = 0
    x = e * back
    w = np.stack([np.ones_like(x), ot * x, to * before, tt * before * x])
    return p, (w / w.sum(axis=0))[1:].sum(axis=1)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: Of a document's logit: constant, largest marginal's logit, log of 1 + offending words.
    document: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, 0.0]))

    def describe(self, words: list[str]) -> np.ndarray:
        """Score of the toxic state, and whether the word ends a sentence."""
        buckets = features(words)
        scores = np.where(buckets >= 0, self.weights[buckets], 0).sum(axis=1, dtype=np.float64) + self.bias
        return np.stack([scores, ends_sentence(words)], axis=1)

    def tag(self, texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of each word of all texts, words of each text)."""
        numbers, sizes = words.numbers(texts)
        rows = words.rows[numbers]
        return marginals(rows[:, 0], *chains(sizes, rows[:, 1] > 0), self.moves), sizes

    def scores(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Score of each text."""
        return _sigmoid(_summary(p, sizes) @ self.document)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    most, count = np.zeros(len(sizes)), np.zeros(len(sizes))
    if len(p):
        begins = np.cumsum(np.r_[0, sizes[sizes > 0]])[:-1]
        most[sizes > 0] = np.maximum.reduceat(p, begins)
        count[sizes > 0] = np.add.reduceat((p > OFFENDING).astype(float), begins)
    logit = np.log(np.clip(most, 1e-4, 1) / np.clip(1 - most, 1e-4, 1))
    return np.stack([np.ones(len(sizes)), logit / 4, np.log1p(count)], axis=1)


def _unseen(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts of which at least NOVEL of the word triples come in no earlier text."""
    if len(numbers) < 3:
        return np.ones(len(sizes), bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mixed = _triples(numbers)[: len(numbers) - 2]
    owner = owner[: len(mixed)]
    _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
    new = np.bincount(owner, owner[first[back]] == owner, minlength=len(sizes))
    return new >= NOVEL * np.bincount(owner, minlength=len(sizes))


def _triples(numbers: np.ndarray) -> np.ndarray:
    """A mix of each word's number with the next two, for all but the last two."""
    a = numbers.astype(np.uint64)
    a = np.r_[a, np.zeros(2, np.uint64)]
    return (a[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ a[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ a[2:]


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model of labelled documents; without both labels, one that finds nothing toxic."""
    y = np.array(toxic, np.int64)
    model = Model()
    if not len(y) or y.min() == y.max():
        return model
    known: dict[str, int] = {}
    parts = [np.array([known.setdefault(w, len(known)) for w in t.split()], np.int32) for t in texts]
    sizes, numbers = np.array([len(p) for p in parts]), np.concatenate(parts)
    words = list(known)
    del known, parts
    buckets, ends = features(words), ends_sentence(words)
    owner = np.repeat(np.arange(len(y), dtype=np.int32), sizes)

    # which features the labels tie to toxic documents: uses in different surroundings, in toxic and clean ones
    fresh = _unseen(numbers, sizes)[owner]
    around = np.roll(_triples(numbers), 1)
    own = y[owner] == 1
    uses = np.zeros((2, 1 << BITS))
    for column in range(6):
        for side in (0, 1):
            use = np.flatnonzero(fresh & (own == side))
            f = buckets[numbers[use], column]
            use, f = use[f >= 0], f[f >= 0].astype(np.uint64)
            # one number for feature and surroundings: the feature in the low bits, a mix of both above
            mixed = (around[use] ^ f * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
            mixed &= ~np.uint64((1 << BITS) - 1)
            mixed |= f
            mixed.sort()
            new = np.r_[True, mixed[1:] != mixed[:-1]][: len(mixed)]
            uses[side] += np.bincount((mixed[new] & np.uint64((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
    del around
    clean, bad = uses
    share = (fresh & own).sum() / max(1, fresh.sum())
    at = np.clip(bad / np.maximum(bad + clean, 1), 1e-9, 1 - 1e-9)
    evidence = bad * np.log(at / share) + clean * np.log((1 - at) / (1 - share))
    tied = (at > max(0.9, share)) & (bad >= 3) & (evidence > np.log((bad + clean > 0).sum() + 1) + 2)
    marked = (np.where(buckets >= 0, tied[buckets], False).any(axis=1))[numbers] & own

    # chains with a marked word, and as many times three others of documents whose labels are explained
    begins, lengths = chains(sizes, ends[numbers])
    hits = np.add.reduceat(marked, begins) > 0 if len(begins) else np.zeros(0, bool)
    explained = ~own | (np.bincount(owner, marked, minlength=len(y)) > 0)[owner]
    rng = np.random.default_rng(SEED)
    plain = np.flatnonzero(~hits & explained[begins])
    if not hits.any() or not len(plain):
        return model
    take = np.r_[np.flatnonzero(hits), rng.permutation(plain)[: 3 * hits.sum() + 2000]]
    _fit_field(model, buckets, numbers, marked, begins[take], lengths[take])
    del words, buckets, ends, numbers, owner, own, fresh, marked, explained, begins, lengths, hits, plain, take, uses, clean, bad, at, evidence

    # documents: the score is fitted to their labels
    found = Words(model.describe)
    parts = [_summary(*model.tag(texts[i : i + TAGGED], found)) for i in range(0, len(texts), TAGGED)]
    x, prior = np.concatenate(parts), np.array([0.0, 1.0, 1.0])
    w = prior.copy()
    for _ in range(50):
        q = _sigmoid(x @ w)
        slope = x.T @ (q - y) + 0.5 * (w - prior)
        w = w - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(3), slope)
    model.document, model.weights = w, model.weights.astype(np.float32)
    return model


def _fit_field(model: Model, buckets: np.ndarray, numbers: np.ndarray, marked: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
    """Likelihood of the marked words in these chains, by adaptive gradient steps over all of them."""
    at = np.repeat(begins - np.cumsum(np.r_[0, lengths[:-1]]), lengths) + np.arange(lengths.sum())
    words, y = numbers[at], marked[at].astype(float)
    begins = np.cumsum(np.r_[0, lengths[:-1]])
    used, words = np.unique(words, return_inverse=True)
    table = buckets[used]
    have = table >= 0
    first = np.zeros(len(y), bool)
    first[begins] = True
    last = np.where(first, 0, np.r_[0, y[:-1]])
    steps = np.array([((1 - last) * y).sum(), (last * (1 - y)).sum(), (last * y).sum()])
    squares, own = np.full(1 << BITS, 1e-3), np.full(4, 1e-3)
    model.weights = model.weights.astype(np.float64)
    for _ in range(EPOCHS):
        scores = np.where(have, model.weights[table], 0).sum(axis=1) + model.bias
        p, expected = marginals(scores[words], begins, lengths, model.moves, pairs=True)
        by_word = np.bincount(words, p - y, minlength=len(used))
        slope = np.bincount(table[have], np.repeat(by_word, have.sum(axis=1)), minlength=1 << BITS) + DECAY * len(y) / 100 * model.weights
        squares += slope**2
        model.weights -= RATE * slope / np.sqrt(squares)
        rest = np.r_[by_word.sum(), expected - steps]
        own += rest**2
        change = RATE * rest / np.sqrt(own)
        model.bias -= change[0]
        model.moves -= change[1:]


def _learn(rows: list[tuple]) -> Model:
    """The model of rows (toxic, h, text); nothing that training held outlives it but the model."""
    return train([text or "" for _, _, text in rows], [toxic for toxic, _, _ in rows])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    """A model of the labelled rows of docs, at most so many toxic and clean ones, and of each so many bytes of text.
    labels: doc_id, toxic; a null label counts for nothing, and a document that has both labels is left out. Rows of
    one id teach once, by the least of their texts. Training is one task of an executor."""
    docs = with_nulls(docs, text_column)
    docs = docs.select(named(id_column).cast("long").alias("id"), named(text_column).alias("text")).withColumn("h", F.xxhash64("id"))
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("label_id"))
    one = one.agg(F.min("toxic").cast("int").alias("g"), F.max("toxic").alias("most")).where("g = most").select("label_id", "g")
    sizes = docs.where("id is not null").select("id", "h", F.octet_length("text").alias("n"))
    keys = written(sizes.join(one, sizes["id"] == one["label_id"]).groupBy("g", "id", "h").agg(F.max("n").alias("n")), "labelled")
    taken = F.lit(False)
    for g, h in least(keys, {1: toxic_rows, 0: clean_rows}, most_bytes).items():
        taken |= (F.col("g") == g) & (F.col("h") <= h)
    few = keys.where(taken).select("g", F.col("id").alias("few_id"))  # of a size that the bounds on rows give
    some = docs.join(F.broadcast(few), docs["id"] == few["few_id"]).groupBy("g", "h").agg(F.min("text").alias("text"))
    model = fitted(some, _learn)
    forget(keys)
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans array<struct<start, end, p>>) of every row, from its whole text alone. Spans are
    runs of offending words in code points, with the largest marginal of the run. Null and empty texts have no span
    and the score of a text without words. Repeated rows and null ids stay."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.describe)
        for part in slices(batches, 1):
            texts = texts_of(part, 1)
            p, sizes = model.tag(texts, words)
            scores = model.scores(p, sizes)
            spans = []
            for text, own in zip(texts, np.split(p, np.cumsum(sizes)[:-1]), strict=True):
                runs: list[dict] = []
                if (own > OFFENDING).any():
                    before = False
                    for m, q in zip(_WORD.finditer(text), own.tolist(), strict=True):
                        if q > OFFENDING and before:
                            runs[-1] |= {"end": m.end(), "p": max(q, runs[-1]["p"])}
                        elif q > OFFENDING:
                            runs.append({"start": m.start(), "end": m.end(), "p": q})
                        before = q > OFFENDING
                spans.append(runs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

    docs = with_nulls(docs, text_column)
    rows = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double, predicted int, spans array<struct<start: long, end: long, p: double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, held_out, score, predicted, spans (see score()). Null ids are not held out and
    teach nothing; null and empty texts have the score of a text without words and no span; repeated rows stay; no
    rows give no rows, no labels a model that finds nothing. Other columns play no part."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 5, 0)), table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model rejects, in one pass: a row's own text decides. Labels train it as in the
    query; a document's own label is not looked up. All columns stay, whatever they are called; null and empty texts and
    null ids are kept like others."""
    model = fit(docs.where(~held_out("doc_id", 5, 0)), table(spark, sf_dir, "labels"))
    docs = with_nulls(docs, "text")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.describe)
        for part in slices(batches, at):
            yield part.filter(pa.array(model.scores(*model.tag(texts_of(part, at), words)) < 0.5))

    return map_rows(docs, run)
