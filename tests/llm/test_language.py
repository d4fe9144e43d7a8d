import zlib

import numpy as np

from weft.llm import language
from weft.llm.words import Words

WORDS = {
    "aa": "tok tak tokka rokat tarok katta".split(),
    "bb": "lumi milu lumma nimul lumin mulli".split(),
    "cc": "éso ñedo desoñ séda dñe osédo".split(),
}


def rows(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang], rng.integers(1, 60))), lang))
    return out


def test_subwords_are_those_of_each_word_alone():
    words = ["Tok", "12", "é1ñ", "a", "--", "can't", "x²"]
    flat, sizes = language.subwords(words)
    at = 0
    for word, n in zip(words, sizes, strict=True):
        alone, (m,) = language.subwords([word])
        assert m == n and sorted(flat[at : at + n]) == sorted(alone)
        at += n
    assert sizes[1] == sizes[4] == 0 and (language.subwords(["x"])[0] == language.subwords(["x²"])[0]).all()
    # 1-grams without the marks, 2- to 4-grams with them, and the whole
    assert sizes[0] == 3 + 4 + 3 + 2 + 1


def test_whole_text_counts_once_each_word():
    model = language.train([r[1] for r in rows(60, 1)], [r[2] for r in rows(60, 1)])
    text = "tok " * 50 + "lumi lumin lumma " * 400
    name, score = model.predict([text], Words(model.describe))
    assert name == ["bb"] and 0 <= score[0] <= 1
    direct, _ = language.subwords(text.split())
    logits = model.buckets[direct].mean(axis=0) + model.bias
    assert np.isclose(score[0], language._softmax(logits[None] / model.temperature).max())


def test_query(spark, tmp_path):
    data = [(i, t, lang, "s") for i, t, lang in rows(300, 2)]
    data += [(900, None, "aa", "s"), (901, "", "aa", None), (902, "12 -- ²", "bb", "s"), (903, "tok", None, "s"), (None, "lumi lumi", "bb", "s"), (0, data[0][1], "aa", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as h", "2 as place")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = language.op3_language(spark, str(tmp_path)).collect()
    assert len(out) == len(data)
    labels = {i: lang for i, _, lang, _ in data}
    got = {r.doc_id: r for r in out}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang_pred == labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out) and got[None].lang_pred == "bb"


def test_nothing_labelled(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.identify(df, language.fit(df)).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0), language.fit(df)).count() == 0
