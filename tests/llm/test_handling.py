"""Columns of any name, very long texts, and many rows of one id, through every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import common, decontaminate, language, lines, pieces, secrets, simhash, token_counts, token_files, toxicity

BENCH = "which of the seven bridges was crossed only once by the walker of the old story"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names"))
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def odd(spark):
    rows = [(1, "a text of some words that stands here", 2, 3, 4, 5, 6, 7), (2, f"before it {BENCH} and after it", 2, 3, 4, 5, 6, 7), (3, None, 2, 3, 4, 5, 6, 7), (None, "", 2, 3, 4, 5, 6, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, `text.x` int, `a``b` int, matches int, _matches int, gone_id int, c0 int")


def test_stages_keep_columns_of_any_name(spark, tables):
    df = odd(spark)
    for stage in (toxicity.stage, lines.stage, simhash.stage, decontaminate.stage):
        out = stage(spark, df, tables)
        assert out.columns == df.columns
        got = {r[0]: tuple(r) for r in out.collect()}
        assert set(got) == {1, 3, None} | ({2} if stage is not decontaminate.stage else set())
        assert all(t[2:] == (2, 3, 4, 5, 6, 7) for t in got.values())
    out = pieces.stage(spark, df, tables)
    assert out.columns == [c for c in df.columns if c != "text"] + ["ids", "n_tokens"] and out.count() == 4


def test_operators_on_columns_of_any_name(spark):
    df = odd(spark).withColumnRenamed("text", "the.text").withColumnRenamed("doc_id", "its`id")
    names = {"id_column": "its`id", "text_column": "the.text"}
    model = language.fit(df.withColumn("la.ng", F.lit("x")), lang_column="la.ng", **names)
    assert language.identify(df, model, **names).count() == 4
    assert secrets.scan(df, secrets.fit(df, **names), **names).count() == 4
    assert token_counts.section_tokens(df, **names).count() == 4
    assert pieces.digests(df, **names).count() == 4 and simhash.near_duplicates(df, **names).count() == 4
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, labels, **names), **names).count() == 4
    items = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    assert decontaminate.annotate(df, items, text_column="the.text", name="in.it").where("size(`in.it`) > 0").count() == 1
    assert pieces.encode(df, text_column="the.text", name="the.text").columns[-1] == "the.text"


def test_very_long_texts(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = np.array(["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(5000)])
    long = " ".join(rng.choice(words, 400_000))  # 2.3 MB without a line end
    df = spark.createDataFrame([(1, long), (2, long + " "), (3, f"{long} {BENCH}")], "doc_id long, text string").withColumn("lang", F.lit("x"))
    items = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.annotate(df, items).where("size(matches) > 0").collect()} == {3}
    assert {r.lang_pred for r in language.identify(df, language.fit(df)).collect()} == {"x"}
    assert all(not r.spans for r in toxicity.score(df, toxicity.Model()).collect())
    assert all(not r.spans for r in secrets.scan(df, secrets.fit(df)).collect())
    assert token_counts.section_tokens(df).count() == 3 and pieces.digests(df).count() == 3
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {1}
    token_files.write(df, f"file://{tmp_path}/long")
    assert token_files.read(spark, f"file://{tmp_path}/long", with_ids=False).count() == 3


def test_samples_of_many_rows_of_one_id(spark):
    rows = [(None, f"text {k}") for k in range(300)] + [(7, f"text {k}") for k in range(300)] + [(k, f"own {k}") for k in range(20)]
    df = spark.createDataFrame(rows, "id long, text string")
    taken = [sorted(r.text for r in token_files._sample(df.repartition(n), 15, 1 << 20).collect()) for n in (1, 5)]
    assert taken[0] == taken[1] and len(taken[0]) == 15
    # bytes bound the sample too, after the first
    assert token_files._sample(df, 15, 12).count() < 15 and token_files._sample(df, 15, 0).count() == 1
    keys = df.selectExpr("1 as g", "xxhash64(id) as h", "10 as n")
    bound = common.least(keys, 100, 1 << 20)[1]  # 22 distinct hashes: all
    assert keys.where(F.col("h") > bound).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Other:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Other)
