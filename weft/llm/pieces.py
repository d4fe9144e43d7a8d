"""SentencePiece ids by a table of distinct chunks.

No piece of the model has a space marker after another character, so no merge crosses the place before a marker: a
text is cut there, each distinct chunk is segmented once by the library, and the ids are joined by position. The
table belongs to a Python worker, has a bound on its entries, and lasts from task to task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import map_rows, named, slices, table, texts_of, tidy, with_nulls

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Entries of a worker's table; when it is full it begins anew.
ENTRIES = 250_000
MARK = "▁"
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


class Chunks(dict):
    """Text after a chunk's first marker -> ids of the chunk, packed as little-endian numbers."""

    def __init__(self, model: str, entries: int = ENTRIES):
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.entries = entries
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses the place before a marker")
        if self.library.encode(" a  b", out_type=str)[0][0] != MARK or self.library.encode("a")[0] != self.library.piece_to_id(f"{MARK}a"):
            raise ValueError("this model changes spaces")
        self.mark = self.library.piece_to_id(MARK)
        self.decimal = [str(i) for i in range(size)]
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = self.library.eos_id()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        # the library puts the first marker itself, except on the empty text
        self[chunk] = out = np.array(self.library.encode(chunk) if chunk else [self.mark], self.kind).tobytes()
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a text, without an end id, as little-endian numbers of the kind that the model needs."""
        if not text:
            return b""
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            words = [c[1:].replace(MARK, " ") for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        return b"".join(map(self.__getitem__, words))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), self.kind).tolist()


_tables: dict[str, Chunks] = {}


def chunks(model: str) -> Chunks:
    """This process's table for a model."""
    if model not in _tables:
        _tables[model] = Chunks(model)
    return _tables[model]


def encode(docs: DataFrame, text_column: str = "text", model: str = MODEL, name: str = "ids") -> DataFrame:
    """docs with a column `name` (array<int>): the ids of the whole text and an end id; null and empty texts have the
    end id only. A column of that name is replaced; other columns stay."""
    docs = with_nulls(docs, text_column)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    # the text itself may be the column that is replaced: it stands last then
    source = docs.select(*[named(c) for c in kept], *([named(text_column)] if text_column not in kept else []))
    at = source.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunks(model)
        end = np.array([own.end], own.kind).tobytes()
        for part in slices(batches, at):
            packed = [own.packed(t) + end for t in texts_of(part, at)]
            offsets = np.cumsum([0, *map(len, packed)]) // own.kind.itemsize
            ids = np.frombuffer(b"".join(packed), own.kind).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], [*part.schema.names, "ids"])

    out = map_rows(source.toDF(*[f"t{k}" for k in range(len(source.columns))]), run, StructType([StructField("ids", ArrayType(IntegerType()))]))
    return out.select(*[F.col(f"t{k}").alias(c) for k, c in enumerate(kept)], F.col("ids").alias(name))


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: the ids with their end id, and what the library's
    decode makes of them. Null is the empty text; rows stay as they are repeated, null ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunks(model)
        decimal, decode = own.decimal.__getitem__, own.library.decode
        for part in slices(batches, 1):
            counts, shas, texts = [], [], []
            for text in texts_of(part, 1):
                ids = [*own.ids(text), own.end]
                counts.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                texts.append(hashlib.sha256(decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = with_nulls(docs, text_column)
    rows = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts are the end id alone;
    repeated rows and null ids stay; no rows give no rows. Other columns play no part."""
    return digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids: all columns but the text, and ids and n_tokens in place of such columns if there are any."""
    out = encode(docs)
    rest = [c for c in out.columns if c != "text" and c.lower() not in ("ids", "n_tokens")]
    return out.select(*[named(c) for c in rest], "ids", F.size("ids").cast("long").alias("n_tokens"))
