import pytest

from weft import QueryError
from weft.streaming import open_stream, start


def read(spark, path):
    return spark.readStream.schema("id long, kind string, v array<long>, at timestamp").parquet(path)


def test_rows_and_groups_of_a_stream(spark, tmp_path):
    rows = [(k, "ab"[k % 2], [k, k + 1], f"2024-01-01 00:0{k}:00") for k in range(8)]
    spark.createDataFrame(rows, "id long, kind string, v array<long>, at string").selectExpr("id", "kind", "v", "cast(at as timestamp) at").write.parquet(f"{tmp_path}/in")
    db = open_stream(spark, "events", read(spark, f"{tmp_path}/in"), ["id"], ("at", "1 minute"))
    query = start(db.q("events.filter(id > 3){id, n => count(v), s => sum(v)}"), "memory", f"{tmp_path}/c1", name="rows")
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("rows").collect())) == [(k, 2, 2 * k + 1) for k in range(4, 8)]
    query = start(db.q("events.group(kind){kind, n => count(events), top => max(events.id)}"), "memory", f"{tmp_path}/c2", "complete", name="groups")
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("groups").collect())) == [("a", 4, 6), ("b", 4, 7)]


def test_not_a_stream(spark):
    with pytest.raises(QueryError, match="not a stream"):
        open_stream(spark, "t", spark.range(3), ["id"])
