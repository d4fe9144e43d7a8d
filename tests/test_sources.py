import pytest

from weft import Count, Db, It, QueryError, Sum, source


def test_files_of_each_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None), (3, None, 4.0)], "k long, s string, x double").coalesce(1)
    for kind in ("parquet", "json", "orc"):
        df.write.format(kind).save(f"{tmp_path}/t.{kind}")
        db = Db.read(spark, str(tmp_path), ["t"], kind, {"t": ["k"]})
        assert db[It.t.s].get() == ["a", "b"] and db[Sum(It.t.x)].get() == 6.5
    df.write.option("header", True).csv(f"{tmp_path}/t.csv")
    db = Db(spark, t=source(spark, "csv", f"{tmp_path}/t.csv", schema="k long, s string, x double"))
    assert db[Count(It.t)].get() == 3 and db[It.t.x].get() == [2.5, 4.0]
    assert Db.read(spark, str(tmp_path), ["t"], "csv")[Sum(It.t.k)].get() == 6
    with pytest.raises(QueryError, match="no reader"):
        Db.read(spark, str(tmp_path), ["t"], "tape")


def test_results_are_tables_again(spark):
    import pandas as pd

    db = Db(spark, t=pd.DataFrame({"k": [1, 2, 3], "g": ["x", "y", "x"]}))
    groups = db.q("t.group(g){g, n => count(t), ks => t.k}")
    again = Db(spark, groups=groups)
    assert again.q("groups.filter(n > 1).g").get() == ["x"]
    assert Db(spark, groups=groups.df).q("sum(groups.ks)").get() == 6
    assert list(groups.toPandas().columns) == ["g", "n", "ks"]


def test_plans_push_down_and_prune(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as g", "id * 2.5 as v", "uuid() as wide").write.parquet(f"{tmp_path}/t.parquet")
    db = Db.read(spark, str(tmp_path), ["t"], order_by={"t": ["id"]})

    def plan(text):
        return db.q(text).df._jdf.queryExecution().executedPlan().toString()

    filtered = plan("t.filter(id > 50).v")
    assert "GreaterThan(id,50)" in filtered and "wide" not in filtered.split("ReadSchema")[1] and "Exchange" not in filtered
    assert plan("t.group(g){g, n => count(t), s => sum(t.v), m => max(t.id)}").count("Exchange hashpartitioning") == 1
    window = plan("t.group(g).keep(m => mean(t.v)).t.filter(v > m).id")
    assert "Window" in window and "Join" not in window and "collect_list" not in window
