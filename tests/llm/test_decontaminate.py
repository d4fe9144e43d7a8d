import numpy as np

from weft.llm import decontaminate as dc


def smith_waterman(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if x == y else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(0)
    items = [rng.integers(1, 8, rng.integers(1, 30)).astype(np.uint64) for _ in range(120)]
    windows = [rng.integers(1, 8, rng.integers(1, 60)).astype(np.uint64) for _ in range(120)]
    got, ends = dc.align(items, windows)
    assert got.tolist() == [smith_waterman(a.tolist(), b.tolist()) for a, b in zip(items, windows, strict=True)]
    for a, b, s, e in zip(items, windows, got, ends, strict=True):
        assert smith_waterman(a.tolist(), b[: e + 1].tolist()) == s


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of"] * 40
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(12, 40)))) for i in range(12)] + [(50, "The"), (51, ""), (52, None), (None, "q1 q2 q3 q4 q5"), (53, "zz yy")]
    docs, truth = [], {}
    for d in range(150):
        words = [str(w) for w in rng.choice(vocabulary[:300], rng.integers(30, 200))]
        truth[d] = set()
        if d % 3 == 0:
            i = int(rng.integers(0, 12))
            copy = items[i][1].upper().split()
            for _ in range(len(copy) // 8 if d % 2 else 0):  # an edited copy
                copy[int(rng.integers(0, len(copy)))] = "edit"
            at = int(rng.integers(0, len(words)))
            words[at:at] = [f"{w}," for w in copy]
            truth[d] = {i}
        docs.append((d, " ".join(words)))
    return items, docs, truth


def test_finds_planted_copies_and_leaves_the_rest(spark):
    items, docs, truth = corpus()
    rows = docs + [(900, None), (901, ""), (902, "-- ..."), (903, "say zz, YY! now"), (904, "q1 q2 -- q3 q4 q5"), (None, docs[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as matches", "2 as item_id", "3 as place")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 as n")
    out = dc.annotate(df, bench)
    assert out.columns == ["doc_id", "text", "item_id", "place", "matches"]
    got = {r.doc_id: r for r in out.collect()}
    text = dict(rows)
    for d, want in truth.items():
        assert {m.item_id for m in got[d].matches} - {50} == want, d
    for m in got[0].matches:
        span = [w.strip(",").lower() for w in text[0][m.start : m.end].split()]
        item = dict(items)[m.item_id].lower().split()
        assert len(set(span) & set(item)) >= 0.5 * len(set(item))
    assert not got[900].matches and not got[901].matches and not got[902].matches
    assert [m.item_id for m in got[903].matches] == [53] and [m.item_id for m in got[904].matches] == [None]
    assert got[None].matches == got[0].matches


def test_blocks_and_empty_tables(spark, monkeypatch):
    items, docs, truth = corpus(2)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((r.doc_id, [m.item_id for m in r.matches]) for r in dc.annotate(df, bench).collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 400)
    assert sorted((r.doc_id, [m.item_id for m in r.matches]) for r in dc.annotate(df, bench).collect()) == whole
    assert all(not r.matches for r in dc.annotate(df, bench.limit(0)).collect())
    assert dc.annotate(df.limit(0), bench).count() == 0


def test_query_and_stage(spark, tmp_path):
    items, docs, truth = corpus(3)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items[:12], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dc.op10_decontaminate(spark, str(tmp_path)).collect()
    assert {r.doc_id: set(r.item_ids) for r in out} == truth
    kept = dc.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {d for d, t in truth.items() if not t}


def test_edited_copies_however_many_there_are(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(40))) for i in range(6)]
    docs, truth = [], {}

    def put(item, step, times):  # each word at a multiple of the step is another one: 20 to 25 % for steps of 5 and 4
        copy = [f"e{k}" if step and k % step == 1 else w for k, w in enumerate(items[item][1].split())]
        for _ in range(times):
            around = [str(w) for w in rng.choice(500, 60)]
            truth[len(docs)] = {item}
            docs.append((len(docs), " ".join(around[:30] + copy + around[30:])))

    put(0, 4, 1)  # alone
    put(1, 4, 1), put(1, 0, 1)  # beside a whole copy
    put(2, 4, 50), put(2, 0, 1)  # a group of equal edited copies
    put(3, 5, 1), put(3, 0, 40)
    put(4, 4, 30)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: {m.item_id for m in r.matches} for r in dc.annotate(df, bench).collect()} == truth


def test_equals_alignment_with_every_item_at_a_fifth_to_three_tenths_edited(monkeypatch):
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"w{k}" for k in rng.integers(0, 200, rng.integers(20, 50)))) for i in range(20)]
    index = dc.Index(items)
    texts = []
    for k in range(120):
        copy = index.words[k % 20].copy()
        edit = rng.random(len(copy)) < (0.2, 0.25, 0.3)[k % 3]
        copy[edit] = dc.word_hashes([f"w{j}" for j in rng.integers(0, 2000, edit.sum())])
        around = dc.word_hashes([f"w{j}" for j in rng.integers(0, 2000, 60)])
        texts.append(np.r_[around[:30], copy, around[30:]])
    want = set()
    for i, item in enumerate(index.words):
        score, _ = dc.align([item] * len(texts), texts)
        want |= {(t, i) for t in np.flatnonzero(score >= dc.THRESHOLD * dc.MATCH * len(item)).tolist()}
    sizes = np.array([len(t) for t in texts])
    found = dc.find(index, np.concatenate(texts), sizes)
    assert {(t, i) for t, i, *_ in found} == want and len(want) > 90
    monkeypatch.setattr(dc, "HITS", 50)
    assert sorted(dc.find(index, np.concatenate(texts), sizes)) == sorted(found)


def test_excerpts_of_long_items(spark):
    item = [f"w{k}" for k in range(59)]
    around = [f"a{k}" for k in range(40)]
    excerpts = [item[:13], item[20:40], item[-27:], item[:12], item[:8] + ["x"] * 9 + item[8:16]]
    docs = [(k, " ".join(around[:20] + e + around[20:])) for k, e in enumerate(excerpts)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: [(m.item_id, round(m.score, 3)) for m in r.matches] for r in dc.annotate(df, bench).collect()}
    assert got == {0: [(7, round(13 / 59, 3))], 1: [(7, round(20 / 59, 3))], 2: [(7, round(27 / 59, 3))], 3: [], 4: []}
    assert all(not r.matches for r in dc.annotate(df, bench, excerpt=None).collect())
