import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weft.llm import pieces, token_files

TEXTS = ["", "a", " ", "  ", "a ", " a", "a  b", "x\ny", "x\n\ny", "x \ny", "don't  'll stop", "<|endoftext|> end", "hi <|endoftext|> there", "x<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n<|endoftext|", "▁a ▁ b", "</s> <unk>", "é́ ü 漢字 \U0001f600", "a\tb\r\nc", " nb sp　x", "12 345,6", "%%% a***", "the the", "\u0000 z", "a\n b\n", "A" * 3000]
text = st.text(st.sampled_from(list("ab'sst \n\t▁é漢1.,  <|>")), max_size=40)


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(piece):
    own = pieces.chunks(pieces.MODEL)
    for t in TEXTS:
        assert own.ids(t) == piece.encode(t), t

    @settings(max_examples=500, deadline=None)
    @given(text)
    def check(t):
        assert own.ids(t) == piece.encode(t)

    check()


def test_byte_chunks_equal_the_library():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = token_files.chunks(token_files.VOCABULARY)
    for t in TEXTS:
        assert own.ids(t) == whole.encode(t, add_special_tokens=False).ids, t

    @settings(max_examples=500, deadline=None)
    @given(text)
    def check(t):
        assert own.ids(t) == whole.encode(t, add_special_tokens=False).ids

    check()


def test_byte_chunks_at_line_ends():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = token_files.Chunks(token_files.VOCABULARY, entries=5)

    @settings(max_examples=800, deadline=None)
    @given(st.lists(st.sampled_from(["the", "Der.", "é", "'s", "x1", "12", "\n", "\n\n", " ", "  ", "!!", "\t", "Ωmega", "漢字", "don't", "<|endoftext|>"]), max_size=14).map("".join))
    def check(t):
        assert own.ids(t) == whole.encode(t, add_special_tokens=False).ids, t

    check()


def test_a_full_table_begins_anew():
    own = pieces.Chunks(pieces.MODEL, entries=3)
    assert own.ids("a b c d e f g a b") == own.library.encode("a b c d e f g a b")


def test_digests(spark, piece):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    want = []
    for i, t in rows:
        ids = [*piece.encode(t or ""), piece.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(piece.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.digests(df).collect()), key=str) == sorted(want, key=str)
    out = pieces.encode(df)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids"] and out.count() == len(rows)
    assert pieces.digests(df.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    rows = [(i * 7 % 23, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (90, None), (91, "tail of it"), (91, "tail of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as data").repartition(5)
    path = f"file://{tmp_path}/files"
    dictionary = token_files.write(df, path, shard_bytes=200)
    got = token_files.read(spark, path).orderBy("start").collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i if i is not None else -1, [*whole.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got) == want
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in want]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    digest = token_files.read(spark, path, with_ids=False).orderBy("start").collect()
    assert [tuple(r) for r in digest] == [tuple(r)[:4] for r in got]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Shard(spark.read.parquet(f"{path}/shards").head().data, dictionary + b"x")


def test_no_documents(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_files.read(spark, path).count() == 0
