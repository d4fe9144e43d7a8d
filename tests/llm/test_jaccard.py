import numpy as np
import pytest

from weft.llm import jaccard, simhash


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least id of each document's group, pair by pair."""
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    comp = {i: i for i, _ in sets}
    near = [(i, j) for i, a in sets for j, b in sets if i > j and (a == b or 5 * len(a & b) >= 4 * len(a | b))]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return comp


def corpus():
    rng = np.random.default_rng(3)
    notice = "this very common notice stands in all of the many texts of this corpus"
    rows = []
    for _ in range(40):
        rows.append((len(rows), " ".join(str(w) for w in rng.integers(0, 3000, rng.integers(20, 150))) + " " + notice))
    for k in range(80):  # copies with one to four words replaced, about the bound, and chains of them
        words = rows[int(rng.integers(0, len(rows)))][1].split()
        for _ in range(1 + k % 4):
            words[int(rng.integers(0, len(words)))] = f"edit{rng.integers(0, 99)}"
        rows.append((len(rows), " ".join(words)))
    base = rows[0][1].split()
    for k in range(50):  # one large group
        rows.append((len(rows), " ".join([*base[:5], f"own{k}", *base[6:]])))
    return rows + [(400, None), (401, ""), (402, " \n"), (403, "one"), (404, "ONE"), (405, "a b c d e f"), (406, rows[3][1].upper()), (407, rows[3][1]), (None, rows[3][1])]


@pytest.mark.parametrize("common", [2, 32])
def test_groups_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in jaccard.groups(df).collect()} == brute(rows)


def test_stage_removes_copies_beyond_the_radius_of_op7(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(20):
        words = [str(w) for w in rng.integers(0, 5000, 150)]
        copy = [*words[:30], "x", *words[31:90], "y", *words[91:]]
        rows += [(k, " ".join(words)), (100 + k, " ".join(copy))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.stage(spark, df, "").collect()} == set(range(20))


def test_stage_finds_copies_by_simhash_and_verifies_them(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(20):  # a copy with one word of 400 replaced, and an equal one
        words = [str(w) for w in rng.integers(0, 10**6, 400)]
        rows += [(k, " ".join(words)), (100 + k, " ".join([*words[:200], "x", *words[201:]])), (200 + k, " ".join(words).upper())]
    phrase = "again and again the very same words " * 60  # repeats weigh in a fingerprint, not in a set
    rows += [(300 + k, phrase + " ".join(str(w) for w in rng.integers(0, 10**6, 12))) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [simhash.fingerprint(t) for _, t in rows]
    apart = [((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() for a, b in [*((3 * k, 3 * k + 1) for k in range(20)), (60, 61)]]
    assert max(apart) <= simhash.CANDIDATES

    def nothing_left(*args):
        left = {r.mark for r in args[0].collect()}
        own = {r.mark for r in jaccard.shingle_sets(df.toDF("id", "text").where("id >= 300"), 5, (4, 5), np.zeros(0, np.int64), ["mark"]).collect()}
        assert left <= own
        return pivots(*args)

    pivots = jaccard._pivots
    monkeypatch.setattr(jaccard, "_pivots", nothing_left)
    assert {r.doc_id for r in simhash.stage(spark, df, "").collect()} == {*range(20), 300, 301, 302}


@pytest.mark.parametrize("classes", ["one of all", "by chance", "none"])
def test_groups_do_not_depend_on_the_classes(spark, tmp_path, classes):
    rows = [*corpus(), (5, corpus()[9][1])]
    ids = sorted({i for i, _ in rows if i is not None})
    rng = np.random.default_rng(6)
    near = [(i, {"one of all": 0, "by chance": int(rng.choice(ids[: ids.index(i) + 1])), "none": i}[classes]) for i in ids]
    spark.createDataFrame([*near, (None, None)], "doc_id long, component_id long").write.parquet(f"{tmp_path}/near")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    alone = {(r.id, r.component) for r in jaccard.groups(df).collect()}
    assert {(r.id, r.component) for r in jaccard.groups(df, near=spark.read.parquet(f"{tmp_path}/near")).collect()} == alone


def test_rows_of_one_id_and_empty_tables(spark):
    rows = [(5, "x y z"), (5, "other words stand here"), (9, "other words stand here"), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.component) for r in jaccard.groups(df).collect()} == {(5, 5), (9, 5)}
    assert jaccard.groups(df.limit(0)).count() == 0
