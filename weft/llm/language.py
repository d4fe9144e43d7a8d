"""Language by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its words' subwords (letter n-grams of 1 to 4 with the word's ends marked, and
the word itself, hashed to buckets); a linear softmax over the mean gives the languages. Both are trained together by
stochastic gradient descent in numpy. A temperature and a rejection level are set on samples the descent did not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FIT_BYTES, fitted, forget, held_out, least, named, slices, table, texts_of, tidy, with_nulls, written
from .words import Words, hash64

#: Documents a language is learned from, those of the least hashes of the ids; one in five for calibration. The text of
#: a language is bounded by FIT_BYTES too.
ROWS_PER_LANGUAGE = 400
#: Words of a training text in one sample, drawn from the whole text.
SAMPLE_WORDS = 96
BITS, WIDTH, EPOCHS, RATE, SEED = 16, 12, 12, 2.0, 11
#: Share of right calibration samples that the rejection level turns away.
REJECT_SHARE = 0.01
UNKNOWN = "und"
_OTHER = re.compile(r"[^\w\n]+|[\d_]+")


def subwords(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the subwords of all words in a row, subwords of each word). The subwords of a word are the runs of
    1 to 4 bytes of its lower-case letters between end marks, and the whole; a word without a letter has none."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = _OTHER.sub("", "\n".join(words).lower())
    if odd := {ord(c): None for c in set(letters) if c != "\n" and not c.isalpha()}:
        letters = letters.translate(odd)
    raw = np.frombuffer(f"\n{letters}\n".encode("utf-8", "surrogatepass"), np.uint8)
    mark = raw == 10
    breaks = np.flatnonzero(mark)
    sizes = np.diff(breaks) - 1
    owner = np.minimum(np.cumsum(mark) - 1, len(words) - 1)  # a mark belongs to the word after it
    real = sizes[owner] > 0
    flat, owners = [], []
    mixed = np.zeros(len(raw), np.uint64)
    for n in range(1, 5):
        last = n - 1
        mixed = mixed[: len(raw) - last] * np.uint64(0x100000001B3) + raw[last:] + np.uint64(1)
        first = slice(0, len(mixed))
        # within one word and its two marks: no mark inside, and not a mark alone
        inside = breaks[np.minimum(owner[first] + 1, len(breaks) - 1)] >= np.arange(len(mixed)) + last
        at = np.flatnonzero(inside & real[first] & (~mark[first] if n == 1 else True))
        at = at[at < breaks[-1]]
        flat.append((mixed[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits))
        owners.append(owner[at])
    full = np.flatnonzero(sizes > 0)
    flat.append(np.fromiter((hash64(w) >> (64 - bits) for w in letters.split("\n") if w), np.uint64, len(full)))
    owners.append(full)
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(flat)[order].astype(np.int64), np.bincount(np.concatenate(owners), minlength=len(words))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    #: Logits that each bucket adds, and how much each weighs: embedding times output matrix.
    buckets: np.ndarray
    bias: np.ndarray
    bits: int = BITS
    temperature: float = 1.0
    reject_below: float = 0.0

    def describe(self, words: list[str]) -> np.ndarray:
        """Sum of the logits of each word's subwords, and their number."""
        flat, sizes = subwords(words, self.bits)
        out = np.zeros((len(words), len(self.languages) + 1))
        if len(flat):
            out[sizes > 0, :-1] = np.add.reduceat(self.buckets[flat], np.cumsum(np.r_[0, sizes[sizes > 0]])[:-1])
        out[:, -1] = sizes
        return out

    def predict(self, texts: list[str], words: Words) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each whole text."""
        numbers, sizes = words.numbers(texts)
        sums = np.zeros((len(texts), len(self.languages) + 1))
        if len(numbers):
            filled = sizes > 0
            sums[filled] = np.add.reduceat(words.rows[numbers], np.cumsum(np.r_[0, sizes[filled]])[:-1])
        known = sums[:, -1] > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        shares = _softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature)
        best = shares.argmax(axis=1)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, shares.max(axis=1), 0.0)


def train(texts: list[str], langs: list[str], bits: int = BITS) -> Model:
    """A model of labelled texts. Words are drawn from the whole texts, anew in each epoch."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0), bits)
    rng = np.random.default_rng(SEED)
    size = len(languages)
    places = {lang: k for k, lang in enumerate(languages)}
    known: dict[str, int] = {}
    split = [t.split() for t in texts]
    numbers = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words in split]
    buckets, counts = subwords(list(known), bits)
    begins = np.cumsum(np.r_[0, counts])
    docs, labels = [], []
    for words, lang in zip(numbers, langs, strict=True):
        if len(words := words[counts[words] > 0]):
            docs.append(words)
            labels.append(places[lang])
    y = np.array(labels, np.int64)
    embed = rng.normal(0, 0.1, (1 << bits, WIDTH))
    out, bias = np.zeros((WIDTH, size)), np.zeros(size)
    order = rng.permutation(len(docs))
    check, learn = order[: len(docs) // 5], order[len(docs) // 5 :]
    if not len(learn):
        learn = order
    weight = np.array([1.0 / max(1, (y[learn] == k).sum()) for k in range(size)])
    weight *= size / weight.sum() if size else 1

    def sample(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for d in which:
            words = docs[d]
            n = int(rng.integers(1, rng.choice([8, SAMPLE_WORDS]) + 1))
            at = int(rng.integers(0, max(1, len(words) - n + 1)))
            parts.append(words[at : at + n])
        words = np.concatenate(parts)
        sizes = counts[words]
        flat = np.repeat(begins[words] - np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.arange(sizes.sum())
        return buckets[flat], np.add.reduceat(sizes, np.cumsum([0, *map(len, parts)])[:-1])

    def means(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(embed[flat], np.cumsum(np.r_[0, sizes])[:-1]) / sizes[:, None]

    batches = [learn[i : i + 32] for i in range(0, len(learn), 32)]
    for epoch in range(EPOCHS if len(learn) else 0):
        rng.shuffle(learn)
        for step, batch in enumerate(batches):
            rate = RATE * (1 - (epoch * len(batches) + step) / (EPOCHS * len(batches)))
            flat, sizes = sample(batch)
            mean = means(flat, sizes)
            slope = _softmax(mean @ out + bias)
            slope[np.arange(len(batch)), y[batch]] -= 1
            slope *= weight[y[batch]][:, None] / len(batch)
            back = slope @ out.T
            out -= rate * mean.T @ slope
            bias -= rate * slope.sum(axis=0)
            np.add.at(embed, flat, np.repeat(-rate * back / sizes[:, None] * len(batch), sizes, axis=0))
    model = Model(languages, embed @ out, bias, bits)
    if len(check):
        flat, sizes = sample(check)
        logits = means(flat, sizes) @ out + bias

        def loss(t: float) -> float:
            return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean()

        model.temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
        shares = _softmax(logits / model.temperature)
        right = shares.max(axis=1)[shares.argmax(axis=1) == y[check]]
        if len(right):
            model.reject_below = float(np.quantile(right, REJECT_SHARE))
    return model


def _learn(rows: list[tuple]) -> Model:
    """The model of rows (lang, h, text)."""
    return train([text for _, _, text in rows], [lang for lang, _, _ in rows])


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rows: int = ROWS_PER_LANGUAGE, most_bytes: int = FIT_BYTES) -> Model:
    """A model of at most `rows` documents of each non-null language of `labelled`, those of the least hashes of the
    ids, and so many bytes of text of each. Rows of one id and language teach once, by the least of their texts. Texts
    without a letter teach nothing. Training is one task of an executor."""
    some = with_nulls(with_nulls(labelled, text_column), lang_column)
    some = some.select(named(lang_column).alias("g"), F.xxhash64(named(id_column)).alias("h"), named(text_column).alias("text"))
    lettered = F.col("text").rlike(r"\p{L}")
    # languages and hashes alone say which rows
    keys = written(some.where(F.col("g").isNotNull() & lettered).select("g", "h", F.octet_length("text").alias("n")), "languages")
    taken = F.lit(False)
    for lang, h in least(keys, rows, most_bytes).items():
        taken |= (F.col("g") == lang) & (F.col("h") <= h)
    model = fitted(some.where(taken & lettered).groupBy("g", "h").agg(F.min("text").alias("text")), _learn)
    forget(keys)
    return model


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, from the whole text alone. und with score 0 where the text is
    null or has no letter; rejected: the score is under the model's level. Repeated rows and null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.describe)
        for part in slices(batches, 1):
            names, scores = model.predict(texts_of(part, 1), words)
            rejected = scores < model.reject_below
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    docs = with_nulls(docs, text_column)
    rows = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, held_out, lang_pred, score, rejected (see identify()). Null ids are not held out;
    null, empty and letterless texts are und with score 0; repeated rows stay; no rows give no rows, and without a
    known language all are und. Other columns play no part."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
