"""The small nested data set that the documented results are about."""

from weft import Db

SCHEMA = "name string not null, employee array<struct<name:string not null, position:string not null, salary:bigint, rate:double>> not null"
ROWS = [
    ("POLICE", [("JEFFERY A", "SERGEANT", 101442, None), ("NANCY A", "POLICE OFFICER", 80016, None), ("ANTHONY A", "POLICE OFFICER", 72510, None), ("ALBA M", "POLICE CADET", None, 9.46)]),
    ("FIRE", [("JAMES A", "FIRE ENGINEER-EMT", 103350, None), ("DANIEL A", "FIREFIGHTER-EMT", 95484, None), ("ROBERT K", "FIREFIGHTER-EMT", 103272, None)]),
    ("OEMC", [("LAKENYA A", "CROSSING GUARD", None, 17.68), ("DORIS A", "CROSSING GUARD", None, 19.38), ("BRENDA B", "TRAFFIC CONTROL AIDE", 64392, None)]),
]


def city(spark):
    return Db(spark, department=spark.createDataFrame(ROWS, SCHEMA).coalesce(1))


EMPLOYEE = [(e[0], d, e[1], e[2], e[3]) for d, es in ROWS for e in es]
OVERTIME = [("JAMES A", f"2018-0{m}", 100 * m) for m in range(1, 7)] + [("NANCY A", f"2018-0{m}", 50 * m) for m in range(1, 6)] + [("DANIEL A", "2018-01", 10), ("JEFFERY A", "2018-02", 20), ("ROBERT K", "2018-03", 30)]


def flat(spark):
    return Db(
        spark,
        employee=spark.createDataFrame(EMPLOYEE, "name string not null, department string not null, position string not null, salary bigint, rate double").coalesce(1),
        overtime=spark.createDataFrame(OVERTIME, "employee string not null, month string not null, amount bigint not null").coalesce(1),
    )
