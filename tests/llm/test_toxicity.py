import zlib
from itertools import product

import numpy as np

from weft.llm import toxicity
from weft.llm.words import Words

PLAIN = [f"{a}{b}" for a in "mo ta ri su ne lo".split() for b in "ken dal fis por gun mit".split()]
BAD = ["vilezzo", "vilezza", "vilezzissimo", "grumhead", "grumpets"]


def texts(n, seed, bad=0.3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = list(rng.choice(PLAIN, rng.integers(5, 80)))
        toxic = int(rng.random() < bad)
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(BAD)))
        for k in range(9, len(words), 10):
            words[k] += "."
        out.append((i, " ".join(words), toxic))
    return out


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 3, 5])
    begins = np.cumsum(np.r_[0, lengths[:-1]])
    scores, moves = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, 3)
    p, steps = toxicity.marginals(scores, begins, lengths, moves, pairs=True)
    want, counts = np.zeros(len(scores)), np.zeros(3)
    for b, n in zip(begins, lengths, strict=True):
        total, own, moved = 0.0, np.zeros(n), np.zeros(3)
        for path in product((0, 1), repeat=int(n)):
            s, last, m = 0.0, 0, np.zeros(3)
            for k, y in enumerate(path):
                s += y * scores[b + k]
                if (last, y) != (0, 0):
                    m[{(0, 1): 0, (1, 0): 1, (1, 1): 2}[last, y]] += 1
                last = y
            w = np.exp(s + m @ moves)
            total, own, moved = total + w, own + w * np.array(path), moved + w * m
        want[b : b + n], counts = own / total, counts + moved / total
    assert np.allclose(p, want) and np.allclose(steps, counts)
    assert np.allclose(toxicity.marginals(scores, begins, lengths, moves), want)


def test_chains_cover_all_words():
    sizes = np.array([0, 3, 200, 0, 1])
    ends = np.zeros(204, bool)
    ends[[1, 80]] = True
    begins, lengths = toxicity.chains(sizes, ends)
    assert np.array_equal(np.concatenate([np.arange(b, b + n) for b, n in zip(begins, lengths, strict=True)]), np.arange(204))
    assert lengths.max() <= toxicity.CHAIN and {0, 2, 3, 81, 203} <= set(begins.tolist())


def test_held_out_documents_and_offsets():
    train, test = texts(400, 1), texts(200, 2)
    model = toxicity.train([t for _, t, _ in train], [y for _, _, y in train])
    words = Words(model.describe)
    p, sizes = model.tag([t for _, t, _ in test], words)
    got = model.scores(p, sizes) >= 0.5
    assert np.mean(got == [y for _, _, y in test]) > 0.98
    flat = [w for _, t, _ in test for w in t.split()]
    marked = {w.rstrip(".") for w, q in zip(flat, p, strict=True) if q > 0.5}
    assert marked and marked <= set(BAD)


def test_query(spark, tmp_path):
    data = texts(300, 3)
    rows = [(i, t) for i, t, _ in data] + [(900, None), (901, ""), (902, " \n"), (None, data[0][1]), (0, data[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label_id", "2 as id", "3 as toxic").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, y) for i, _, y in data] + [(None, 1), (5, None), (7000, 1), (1, 0), (1, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 as quality").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    truth = {i: y for i, _, y in data}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(not r.spans and not r.predicted for r in out if r.doc_id in (900, 901, 902))
    by = dict(rows)
    assert all(by[r.doc_id][s.start : s.end].rstrip(".").split()[0].rstrip(".") in BAD for r in held for s in r.spans)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = toxicity.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in out)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert out[0].predicted == 0 and toxicity.score(docs.limit(0), toxicity.Model()).count() == 0
