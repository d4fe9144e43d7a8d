"""Token counts of the sections of texts, from one encoding of each whole text.

Ids of a byte-level vocabulary give the bytes of every token, so the tokens' spans are running sums. Spans are joined
to the sections by searching the sections' starts. A token that lies in several sections goes to one of them by a rule:

    first   the section of its first byte
    most    the section that holds most of its bytes, of equal ones the first

Bytes of no section are a section of their own to this rule, whose tokens are not reported. Counts of the sections
of a text whose sections cover it add up to the tokens of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, slices, table, texts_of, tidy, with_nulls
from .token_files import VOCABULARY, chunks

RULES = ("first", "most")


def token_bytes(vocabulary: str = VOCABULARY) -> np.ndarray:
    """Bytes of each id: a byte-level vocabulary writes each byte as one character; added tokens are plain text."""
    own = chunks(vocabulary)
    pieces = own.library.get_vocab()
    out = np.zeros(max(pieces.values()) + 1, np.int64)
    for piece, i in pieces.items():
        out[i] = len(piece.encode()) if piece in own.added else len(piece)
    return out


def allocate(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it reaches out of it); -1 for tokens of no section. Sections [low, high) are
    in order; where they overlap, bytes belong to the last that has begun."""
    cuts = np.unique(np.r_[0, low, high])  # from each cut to the next, one section or none
    if not len(low):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    # of equal starts the last counts, empty sections hold no byte
    real = np.flatnonzero(high > low)
    place = np.searchsorted(low[real], cuts, side="right") - 1
    owner = np.where(place >= 0, real[np.maximum(place, 0)], -1) if len(real) else np.full(len(cuts), -1)
    owner = np.where((owner >= 0) & (cuts < high[np.maximum(owner, 0)]), owner, -1)
    first = np.searchsorted(cuts, starts, side="right") - 1
    last = np.searchsorted(cuts, np.maximum(ends - 1, starts), side="right") - 1
    out = owner[first]
    several = np.flatnonzero(first != last)
    crossing = np.zeros(len(starts), bool)
    if not len(several):
        return out, crossing
    # the tokens over more than one cut, part by part: (token, section, bytes)
    parts = (last - first)[several] + 1
    token = np.repeat(np.arange(len(several)), parts)
    place = first[several][token] + np.arange(parts.sum()) - np.repeat(np.cumsum(np.r_[0, parts[:-1]]), parts)
    after = np.r_[cuts[1:], np.iinfo(np.int64).max]
    held = np.minimum(after[place], ends[several][token]) - np.maximum(cuts[place], starts[several][token])
    order = np.lexsort((place, owner[place], token))
    token, place, held = token[order], place[order], held[order]
    new = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (owner[place[1:]] != owner[place[:-1]])])
    token, begin, section, held = token[new], place[new], owner[place[new]], np.add.reduceat(held, new)
    crossing[several] = np.bincount(token, minlength=len(several)) > 1
    if rule == "most":  # of equal shares the one that begins first
        order = np.lexsort((begin, -held, token))
        out[several] = section[order][np.flatnonzero(np.r_[True, np.diff(token[order]) != 0])]
    return out, crossing


def _count(texts: list[str], sections: list[list[tuple[int, int]]] | None, own, widths: np.ndarray, rule: str):
    """Of all texts in a row: (text, section, start, end, tokens, crossing) by section."""
    raw = "".join(texts).encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    lead = (data & 0xC0) != 0x80
    chars = np.cumsum(lead)  # characters up to and with each byte
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
    begins = np.cumsum(np.r_[0, sizes[:-1]])
    ids = np.frombuffer(b"".join(map(own.packed, texts)), own.kind)
    ends = np.cumsum(widths[ids])
    starts = ends - widths[ids]
    before = np.r_[0, chars][begins]  # characters before each text
    if sections is None:  # the lines, each with its end
        breaks = np.flatnonzero(data == 10)
        owner = np.searchsorted(begins, breaks, side="right") - 1
        low = np.concatenate([begins, breaks + 1])
        text = np.concatenate([np.arange(len(texts)), owner])
        order = np.lexsort((low, text))
        low, text = low[order], text[order]
        high = np.where(np.r_[text[1:] == text[:-1], False], np.r_[low[1:], 0], (begins + sizes)[text])
    else:
        byte = np.r_[np.flatnonzero(lead), len(data)]
        text = np.repeat(np.arange(len(texts)), [len(s) for s in sections])
        spans = np.array([p for s in sections for p in s], np.int64).reshape(-1, 2)
        own_chars = np.array([len(t) for t in texts], np.int64)[text]
        spans = np.clip(spans, 0, own_chars[:, None]) + before[text][:, None]
        order = np.lexsort((spans[:, 0], text))
        text, spans = text[order], spans[order]
        low, high = byte[spans[:, 0]], np.maximum(byte[spans[:, 1]], byte[spans[:, 0]])
    place, crossing = allocate(starts, ends, low, high, rule)
    tokens = np.bincount(place[place >= 0], minlength=len(low))
    crossed = np.bincount(place[(place >= 0) & crossing], minlength=len(low))
    number = np.arange(len(text)) - np.searchsorted(text, text)
    at = np.r_[0, chars]
    return text, number, at[low] - before[text], at[high] - before[text], tokens, crossed


def section_tokens(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sections_column: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) of each section of every row, sections numbered from 0 by
    their starts; code points, end exclusive. n_crossing: of the tokens, those that also lie outside.

    sections_column: array<struct<start, end>> of code points, cut off at the text's ends; a null column or span has no
    section. Without one, sections are the lines, each with its line end, so that the counts add up to the text's.
    Null is the empty text, which is one empty line. Repeated rows and null ids stay; no rows give no rows."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    docs = with_nulls(docs, text_column)
    columns = [named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text")]
    if sections_column:
        spans = F.filter(named(sections_column), lambda s: s["start"].isNotNull() & s["end"].isNotNull())
        columns.append(F.transform(spans, lambda s: F.array(s["start"].cast("long"), s["end"].cast("long"))).alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, widths = chunks(vocabulary), token_bytes(vocabulary)
        for part in slices(batches, 1):
            sections = [s or [] for s in part.column(2).to_pylist()] if sections_column else None
            text, *rest = _count(texts_of(part, 1), sections, own, widths, rule)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), *map(pa.array, rest)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return docs.select(*columns).mapInArrow(tidy(run), "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every row of documents with their tokens: doc_id, section, start, end, n_tokens, n_crossing. A null
    or empty text is one line without tokens; null ids and repeated rows stay; no rows give no rows. Other columns play
    no part."""
    return section_tokens(table(spark, sf_dir, "documents"))
