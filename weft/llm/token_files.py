"""Token ids in compressed files that a single document can be read from.

A file is one shard: a run of documents in ascending order of their ids. All numbers are little-endian.

    magic            8 bytes   WEFTIDS1
    dictionary hash  8 bytes   XXH64 of the zstandard dictionary that all frames share
    documents        8 bytes   n
    tokens           8 bytes   of all documents, end ids too
    width            8 bytes   of an id in a frame: 2 or 4
    document ids     n x 8     signed; order of the frames
    token counts     n x 8     with the end id
    offset index     (n+1) x 8 start of each frame, counted from the first
    frames           each document's ids, compressed on their own

The files go through Spark's own writer, one row to a shard, so they can be in any store and a lost executor's shards
are written again. Null ids come first; rows of one id stand side by side.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import FIT_BYTES, fitted, forget, least, named, shared_dir, slices, table, texts_of, tidy, with_nulls, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MAGIC = b"WEFTIDS1"
#: Documents that the dictionary is trained on (those of the least hashes of the ids, FIT_BYTES of text at most), and its size.
SAMPLE, DICTIONARY_BYTES = 500, 64 << 10
#: Text of a shard, roughly: a shard is held in memory while it is written.
SHARD_BYTES = 16 << 20
#: Entries of a worker's table of chunks.
ENTRIES = 1_000_000
NO_ID = -(1 << 63)
#: Letters before this are letters in every version of the character tables.
OLD = "\u0530"
#: Characters that the pattern takes as one word after letters; no apostrophe, which may begin a word of its own.
TAIL = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Before a single space or newline between other characters the tokenizer's pattern always begins a new word.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


class Chunks(dict):
    """Word after `lead` (a space, or nothing) -> ids of both, as the library gives them, packed. The tokenizer's pattern
    begins a new word at a single space, and before and after a single line end, whatever stands around, so the ids of a
    text are those of its parts in a row. None: white space touches white space, and the pattern cuts the text instead.
    The vocabulary's added tokens are found in a text first, as the library finds them, and part it."""

    def __init__(self, vocabulary: str, entries: int = ENTRIES, lead: str = " ", library: Tokenizer | None = None):
        super().__init__()
        self.library = library or Tokenizer.from_file(vocabulary)
        self.entries, self.lead = entries, lead
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        # else a text that holds such a token is left to the library whole
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.merges, self.tails = self.library.model.tokenize, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow 255
        hidden = sorted({*range(256)} - {*shown})
        self.symbols = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.bare = Chunks(vocabulary, max(1, entries // 8), "", self.library) if lead else self
        self.line_end = self._encode("\n")

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= self.entries:
            self.clear()
            self.tails.clear()
        if word.isalpha() and max(word) < OLD:  # one word of the pattern: straight to the library's merges
            symbols = f"{self.lead}{word}".encode().decode("latin-1").translate(self.symbols)
            out = np.array([t.id for t in self.merges(symbols)], dtype=self.kind).tobytes()
        elif not word or word[0].isspace() or word[-1].isspace():
            out = None
        elif "\n" in word:  # lines; not kept, as hardly any comes again
            first, *rest = word.split("\n")
            parts = [self[first], *map(self.bare.__getitem__, rest)]
            return None if None in parts else self.line_end.join(parts)
        elif (core := word.rstrip(TAIL)) != word and core.isalpha():  # two words of the pattern
            if (end := self.tails.get(tail := word[len(core) :])) is None:
                end = self.tails[tail] = self._encode(tail)
            out = self[core] + end
        else:
            out = self._encode(f"{self.lead}{word}")
        self[word] = out
        return out

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian numbers of the kind that the vocabulary needs."""
        if not text:
            return b""
        if self.cut.search(text):
            if not self.plain:
                return self._encode(text)
            marks = [np.array([self.added[t]], self.kind).tobytes() for t in self.cut.findall(text)]
            parts = [self._packed(t) for t in self.cut.split(text)]
            return parts[0] + b"".join(m + p for m, p in zip(marks, parts[1:], strict=True))
        return self._packed(text)

    def _packed(self, text: str) -> bytes:
        if not text:
            return b""
        first, *words = text.split(" ")
        try:
            return self.bare[first] + b"".join(map(self.__getitem__, words))
        except TypeError:  # a part is None
            return b"".join(map(self._encode, _CUT.split(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), self.kind).tolist()


_tables: dict[str, Chunks] = {}


def chunks(vocabulary: str) -> Chunks:
    if vocabulary not in _tables:
        _tables[vocabulary] = Chunks(vocabulary)
    return _tables[vocabulary]


def train_dictionary(texts: list[str], vocabulary: str = VOCABULARY, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays; with too little to learn from, the arrays themselves."""
    own = chunks(vocabulary)
    samples = [own.packed(t) + bytes(own.kind.itemsize) for t in texts]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or b"\0" * 8


def shard(ids: list[int], packed: list[bytes], width: int, dictionary: bytes, level: int = 3) -> bytes:
    """One file. packed: each document's ids as numbers of that many bytes."""
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
    frames = [press.compress(x) for x in packed]
    counts = np.array([len(x) // width for x in packed], dtype="<i8")
    index = np.zeros(len(ids) + 1, dtype="<i8")
    np.cumsum([len(f) for f in frames], out=index[1:])
    head = MAGIC + struct.pack("<Qqqq", xxhash.xxh64_intdigest(dictionary), len(ids), int(counts.sum()), width)
    return b"".join([head, np.array(ids, dtype="<i8").tobytes(), counts.tobytes(), index.tobytes(), *frames])


class Shard:
    """A file, read without touching other documents' frames."""

    def __init__(self, data: bytes, dictionary: bytes):
        self.data, head = memoryview(data), struct.unpack_from("<8sQqqq", data)
        if head[0] != MAGIC:
            raise ValueError("not a file of token ids")
        if head[1] != xxhash.xxh64_intdigest(dictionary):
            raise ValueError("the file was written with another dictionary")
        n = head[2]
        self.tokens, self.kind = head[3], f"<u{head[4]}"
        self.doc_ids, self.counts = (np.frombuffer(data, "<i8", n, 40 + 8 * n * k) for k in range(2))
        self.index = np.frombuffer(data, "<i8", n + 1, 40 + 16 * n)
        self.at = 40 + 16 * n + 8 * (n + 1)
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return np.frombuffer(self.press.decompress(self.data[self.at + self.index[k] : self.at + self.index[k + 1]]), self.kind)


def _sample(docs: DataFrame, rows: int, most_bytes: int) -> DataFrame:
    """(h, text) of at most so many documents of docs (id, text), and so many bytes: one text, the least, of each of
    the least hashes of the ids."""
    docs = docs.select(F.xxhash64("id").alias("h"), "text").where("length(text) > 0")
    keys = written(docs.select(F.lit(0).alias("g"), "h", F.octet_length("text").alias("n")), "sizes")
    bound = least(keys, rows, most_bytes)
    forget(keys)
    return docs.where(F.col("h") <= bound[0] if bound else F.lit(False)).groupBy("h").agg(F.min("text").alias("text"))


def write(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> bytes:
    """Writes the ids of all whole texts, id 0 after each, in ascending order of the ids, under path; gives the
    dictionary, which is also written. Null is the empty text. A null id comes first, as the least number; rows of one
    id follow each other by the hash of the text."""
    spark = docs.sparkSession
    docs = with_nulls(docs, text_column)
    rows = docs.select(F.coalesce(named(id_column).cast("long"), F.lit(NO_ID)).alias("id"), named(text_column).alias("text"))
    dictionary = fitted(_sample(rows, SAMPLE, FIT_BYTES), lambda some: train_dictionary([t for _, t in some], vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunks(vocabulary)
        width = own.kind.itemsize
        ids: list[int] = []
        packed: list[bytes] = []
        held = before = 0

        def out() -> pa.RecordBatch:
            nonlocal before
            tokens = sum(map(len, packed)) // width
            before += tokens
            columns = [pa.array([x], pa.int64()) for x in (ids[0], before - tokens, tokens)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([shard(ids, packed, width, dictionary)], pa.binary())], ["first", "before", "tokens", "data"])

        for part in slices(batches, 1):
            texts = texts_of(part, 1)
            ids += part.column(0).to_pylist()
            packed += [own.packed(t) + bytes(width) for t in texts]
            held += sum(map(len, texts))
            if held >= shard_bytes:
                yield out()
                ids, packed, held = [], [], 0
        if ids:
            yield out()

    # dealt by id as plain text, before encoding: the sample that finds the ranges reads no ids of tokens
    dealt = rows.withColumn("t", F.xxhash64("text")).repartitionByRange("id", "t").sortWithinPartitions("id", "t").select("id", "text")
    shards = dealt.mapInArrow(tidy(run), "first long, before long, tokens long, data binary")
    shards.select("*", F.spark_partition_id().alias("part")).write.parquet(f"{path}/shards")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return dictionary


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids array<int>) of every document in the files under path; the ids are read
    in any case, and left out of the rows without with_ids."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").head().dictionary)
    shards = spark.read.parquet(f"{path}/shards")
    # a number for each partition of the writer goes to the driver and back, nothing for each shard or document
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    bases = dict(zip([p for p, _ in totals], np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast(bases)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = Shard(data.as_py(), dictionary)
                start = shared.value[part] + before + np.concatenate([[0], np.cumsum(own.counts)[:-1]])
                for at in range(0, len(own.doc_ids), 2048):
                    some = range(at, min(at + 2048, len(own.doc_ids)))
                    ids = [own.document(k).astype("<u4") for k in some]
                    doc_ids = [None if i == NO_ID else i for i in own.doc_ids[some.start : some.stop].tolist()]
                    columns = [pa.array(doc_ids, pa.int64()), pa.array(start[some.start : some.stop]), pa.array([len(x) for x in ids], pa.int64())]
                    columns.append(pa.array([zlib.crc32(x) for x in ids], pa.int64()))
                    if with_ids:
                        offsets = np.cumsum([0, *map(len, ids)])
                        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids).view("<i4"))))
                    yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.select("part", "before", "data").mapInArrow(tidy(run), kinds)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, read back from its file: doc_id, start, n_tokens, ids_crc32. Null and empty texts are the
    end id alone; null ids come first; repeated rows are documents of their own; no rows give no rows. Added tokens of
    the vocabulary in a text are those tokens, as the library has it. Other columns play no part."""
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, with_ids=False)
