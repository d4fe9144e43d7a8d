"""Secrets in texts: three fixed rules, and strings that look random to a pair of character models.

Two Markov chains over characters, each giving the next character from the two before it, are trained from labelled
samples: what the rules find in the corpus is labelled random, words that no rule touches are labelled ordinary, and
seeded strings of usual alphabets join the first. A candidate is a run of 16 or more key characters; its score is the
log-likelihood ratio of the chains per character. The threshold comes from samples that the chains have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FIT_BYTES, fitted, forget, least, named, slices, table, texts_of, tidy, with_nulls, written

KINDS = ("assign", "access", "hex", "model")
#: The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones fail
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Rows that the samples come from (least hashes of the ids), one in two of them for the threshold. The text of those
#: with a rule's match, and of those without, is bounded by FIT_BYTES too.
SAMPLE_ROWS, PLANTED = 2000, 4000
#: Share of ordinary words of the held-out half that may pass the threshold.
FALSE_SHARE = 0.0005
SIZE = 67  # letters, digits, five signs, and the rest as one

_CODES = np.full(256, SIZE - 1, dtype=np.int64)
_CODES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=", np.uint8)] = np.arange(66)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the rules' matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _steps(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of all steps (two before, next) of the words in a row, and where each word begins."""
    raw = np.frombuffer("\n\n".join(["", *words]).encode("ascii", "replace"), np.uint8)
    codes = _CODES[raw]
    steps = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(np.r_[0, sizes[:-1] + 2]) if len(words) else np.zeros(0, np.int64)
    real = np.concatenate([np.arange(b, b + n) for b, n in zip(begins, sizes, strict=True)]) if len(words) else np.zeros(0, np.int64)
    return steps[real], np.cumsum(np.r_[0, sizes[:-1]]) if len(words) else begins


def _chain(words: list[str]) -> np.ndarray:
    """Log-probabilities of the steps, each backed off to the step from one character and to the share of the character."""
    steps, _ = _steps(words)
    three = np.bincount(steps, minlength=SIZE**3).reshape(SIZE, SIZE, SIZE).astype(np.float64)
    two = three.sum(axis=0)
    one = (two.sum(axis=0) + 0.5) / (two.sum() + 0.5 * SIZE)
    low = (two + 4.0 * one) / (two.sum(axis=1, keepdims=True) + 4.0)
    return np.log((three + 8.0 * low) / (three.sum(axis=2, keepdims=True) + 8.0)).reshape(-1).astype(np.float32)


class Model:
    """The two chains as one table of log-ratios, and the threshold."""

    def __init__(self, random: list[str], ordinary: list[str], false_share: float = FALSE_SHARE):
        self.ratio = _chain(random[::2]) - _chain(ordinary[::2])
        plain, odd = np.sort(self.scores(ordinary[1::2])), np.sort(self.scores(random[1::2]))
        least = float(plain[min(len(plain) - 1, int(len(plain) * (1 - false_share)))]) if len(plain) else 0.0
        low = float(odd[len(odd) // 50]) if len(odd) else least
        # over nearly all ordinary words, and halfway to nearly all random strings where there is room
        self.threshold = max(0.0, least, (least + low) / 2)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio per character of each word."""
        if not words:
            return np.zeros(0)
        steps, begins = _steps(words)
        return np.add.reduceat(self.ratio[steps].astype(np.float64), begins) / np.diff(np.r_[begins, len(steps)])


def _planted(count: int, seed: int = 7) -> list[str]:
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    return ["".join(rng.choice(list(alphabets[k % 4]), rng.integers(16, 48))) for k in range(count)]


def samples(texts: list[str]) -> tuple[list[str], list[str]]:
    """(random, ordinary) strings of texts: what the rules find, and the words of eight or more key characters that
    no rule touches; each string once."""
    found, plain = {}, {}
    for text in texts:
        spans = base_spans(text)
        for start, kind, end in spans:
            found[ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]] = None
        at = 0
        for start, _, end in [*spans, (len(text), 0, len(text))]:
            plain |= dict.fromkeys(re.findall(r"[A-Za-z0-9+/_=-]{8,}", text[at:start]))
            at = max(at, end)
    return list(found), list(plain)


def _learn(rows: list[tuple]) -> Model:
    """The model of rows (hinted, h, text)."""
    random, ordinary = samples([text for _, _, text in rows])
    return Model(random + _planted(PLANTED), ordinary)


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    """Chains from at most `rows` documents, those of the least hashes of the ids; half of them with a rule's match
    where there are such; of either half so many bytes of text. Rows of one id teach once, by the least of their texts.
    Without any text, from the planted strings alone. Training is one task of an executor."""
    docs = with_nulls(docs, text_column)
    docs = docs.select(F.xxhash64(named(id_column)).alias("h"), named(text_column).alias("text")).where("length(text) > 0")
    hint = F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    # one pass over the texts finds hints and hashes; the second takes the few that are chosen
    keys = written(docs.select(hint.alias("g"), "h", F.octet_length("text").alias("n")), "hints")
    bounds = least(keys, rows // 2, most_bytes)
    taken = F.lit(False)
    for g, h in bounds.items():
        taken |= (F.col("h") <= h) & (F.col("g") == g)
    some = docs.where(F.col("h") <= max(bounds.values())).withColumn("g", hint).where(taken) if bounds else docs.limit(0).withColumn("g", hint)
    model = fitted(some.groupBy("g", "h").agg(F.min("text").alias("text")), _learn)
    forget(keys)
    return model


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end>>) of every row, in order of start and kind; code points, end
    exclusive. Rules' spans stay as they are; the model adds candidates that touch none of them. Null and empty texts
    have none; repeated rows and null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for part in slices(batches, 1):
            rows, words, places = [], [], []
            for n, text in enumerate(texts_of(part, 1)):
                spans = base_spans(text)
                rows.append(spans)
                for m in CANDIDATE.finditer(text):
                    if not any(s < m.end() and m.start() < e for s, _, e in spans):
                        words.append(m[0])
                        places.append((n, m.start(), m.end()))
            for k in np.flatnonzero(model.scores(words) > model.threshold).tolist():
                n, start, end = places[k]
                rows[n].append((start, 3, end))
            out = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(spans)] for spans in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    docs = with_nulls(docs, text_column)
    rows = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, spans array<struct<start: long, kind: string, end: long>>")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, the counts by kind, base_sha256 and spans. Null and empty texts have no spans;
    repeated rows and null ids stay; no rows give no rows. Other columns play no part."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
