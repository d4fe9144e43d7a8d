import time

import numpy as np

from weft.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, fuzzy=lines.FUZZY_CHARS):
    """Places that go, line by line against all earlier ones."""
    every = sorted((d, p, line) for d, text in rows if d is not None for p, line in enumerate((text or "").split("\n")) if line.strip(" \t\r\x0b\x0c"))
    gone = set()
    for k, (d, p, line) in enumerate(every):
        for d2, p2, other in every[:k]:
            if (d2, p2) < (d, p) and (line == other or (min(len(line), len(other)) >= fuzzy and abs(len(line) - len(other)) <= 1 and distance(line, other) <= 1)):
                gone.add((d, p))
                break
    return gone


def corpus(seed=0, n=60):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abé d漢"), rng.integers(15, 40))) for _ in range(12)] + ["aab" * 8, "aab" * 8 + "a", "x" * 30]
    rows = []
    for d in range(n):
        own = []
        for _ in range(rng.integers(0, 5)):
            line = str(rng.choice(base))
            for _ in range(rng.integers(0, 3)):
                k = int(rng.integers(0, len(line) + 1))
                line = [line[:k] + "z" + line[k:], line[:k] + line[k + 1 :], line[:k] + "y" + line[k + 1 :], line][rng.integers(0, 4)]
            own.append(line)
        rows.append((d, "\n".join(own)))
    return rows


def test_against_brute_force(spark):
    for seed in (0, 1):
        rows = corpus(seed)
        rows += [(900, None), (901, ""), (902, "\n \n\t\n"), (903, "short\nshort\nshorts"), (904, "short\n\nend"), (None, rows[3][1])]
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as t", "3 as gone", "7 as n_chars")
        got = {(r.id, r.pos) for r in lines.dropped_lines(df).collect()}
        want = brute(rows)
        assert got == want
        out = {(r.doc_id, r.text, r.n_chars) for r in lines.dedup_lines(df).collect()}
        for d, text in rows:
            kept = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if d is None or (d, p) not in want)
            assert (d, kept, 7 if kept == text else len(kept)) in out
        assert lines.dedup_lines(df).columns == df.columns


def test_long_lines(spark):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdef gé"), 1_000_000))
    edits = [long, long[:700_001] + "z" + long[700_001:], long[:3] + "zz" + long[3:], long[:999_000] + long[999_001:], long[1:], long[:500_000] + "Z" + long[500_001:]]
    df = spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string").repartition(3)
    began = time.time()
    assert {r.id for r in lines.dropped_lines(df).collect()} == {1, 3, 4, 5}
    assert time.time() - began < 60


def test_rests_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(lines, "REST_CHARS", 3)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.pos) for r in lines.dropped_lines(df).collect()} == brute(rows)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "the same line of it", 2, 3, 4), (2, "the same line of it", 5, 6, 7)], ["doc_id", "text", "text.x", "a`b", "gone"])
    out = lines.dedup_lines(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "the same line of it", 2, 3, 4), (2, "", 5, 6, 7)]


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "the same line of it"), (1, "the same line of it"), (1, "other\nthe same line of it"), (0, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup_lines(df).collect()) == ["", "other", "the same line of it", "the same line of it"]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = corpus(3, 80)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in lines.op2_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "dropped").collect()}
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(db.execute(lines.SQL).fetchall())


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(corpus(4, 5), "doc_id long, text string")
    plan = lines.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
