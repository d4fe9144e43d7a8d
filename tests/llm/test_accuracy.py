"""Results against exhaustive search, other generators, and the labels of the given tables."""

import base64
import random
import uuid
import zlib

import numpy as np

from weft.llm import decontaminate, language, secrets, toxicity

SF = "/root/testdata/sf0.01"


def test_edited_copies_of_items_as_exhaustive_alignment_finds_them(spark):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{k}" for k in range(400)])
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(15, 60)))) for i in range(12)]
    docs = []
    for k in range(150):
        words = list(rng.choice(vocabulary, rng.integers(20, 120)))
        if k % 3:
            copy = items[k % 12][1].split()
            for at in np.flatnonzero(rng.random(len(copy)) < 0.1 * (k % 4)):
                copy[at] = [str(rng.choice(vocabulary)), f"{copy[at]} more", ""][rng.integers(0, 3)]
            words[5:5] = " ".join(copy).split()
        docs.append((k, " ".join(words)))
    got = {(r.doc_id, m.item_id): m.score for r in decontaminate.annotate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() for m in r.matches}
    hashes = {t: decontaminate.word_hashes(t.split()) for _, t in [*items, *docs]}
    pairs = [(d, i, hashes[i_text], hashes[d_text]) for d, d_text in docs for i, i_text in items]
    scores, _ = decontaminate.align([p[2] for p in pairs], [p[3] for p in pairs])
    want = {(d, i): s / (2 * len(a)) for (d, i, a, _), s in zip(pairs, scores.tolist(), strict=True) if s / (2 * len(a)) >= 0.5 or s >= 26}
    assert len(want) > 80 and set(got) <= set(want)
    assert len(set(want) - set(got)) <= 0.01 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_model_spans_on_strings_from_elsewhere(spark):
    source = random.Random(3)
    odd = [base64.b64encode(source.randbytes(30)).decode() for _ in range(200)]
    odd += [base64.urlsafe_b64encode(source.randbytes(24)).decode() for _ in range(200)]
    odd += [uuid.UUID(int=source.getrandbits(128)).hex.upper() for _ in range(200)]
    plain = ["get_customer_account_balance", "MaximumNumberOfRetries", "documentation/getting-started", "internationalization", "default_connection_timeout", "UnsupportedOperationException"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secrets.fit(docs)
    assert np.mean(model.scores(odd) > model.threshold) > 0.95
    assert np.mean(model.scores(plain) > model.threshold) < 0.2
    df = spark.createDataFrame([(k, f"the key {w} stands here") for k, w in enumerate(odd)], "doc_id long, text string")
    found = secrets.scan(df, model).collect()
    assert np.mean([any(s.kind == "model" and s.start == 8 and s.end >= 8 + len(odd[r.doc_id].rstrip("=")) for s in r.spans) for r in found]) > 0.9


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").collect()}
    held = [r for r in language.op3_language(spark, SF).collect() if r.held_out and r.doc_id in truth and r.lang_pred != "und"]
    assert len(held) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9


def test_toxicity_of_held_out_documents(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in toxicity.op1_toxicity(spark, SF).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in truth]
    bad = [r.predicted for r in held if truth[r.doc_id]]
    clean = [r.predicted for r in held if not truth[r.doc_id]]
    assert len(bad) >= 5 and np.mean(bad) > 0.8 and np.mean(clean) < 0.05
