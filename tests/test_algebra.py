import numpy as np
import pytest

from weft import (
    Collect, Count, Desc, Drop, Each, Exists, Filter, First, Get, Given, Group, Is, Is0to1, Is0toN, Is1to1, Is1toN, It, Join, Keep, Label,
    Last, Lift, Max, Mean, Min, Mix, Nth, QueryError, Record, Sort, Sum, Tag, Take, Then, Unique, register,
)

from .fixture import city, flat


@pytest.fixture(scope="module")
def db(spark):
    return city(spark)


@pytest.fixture(scope="module")
def tables(spark):
    return flat(spark)


def employees(x):
    return It.department >> It.employee >> x


def test_navigation_and_constants(db):
    assert db[It.department.name].get() == ["POLICE", "FIRE", "OEMC"]
    assert db[It.department.employee.name].get()[:4] == ["JEFFERY A", "NANCY A", "ANTHONY A", "ALBA M"]
    assert db[It.department.employee.salary >> Count].get() == 7
    assert db[Lift(3) >> (It + 4) >> (It * 6)].get() == 42
    assert db[It.department >> Lift(1)].get() == [1, 1, 1]
    assert db[Lift([1, None, 3])].get() == [1, 3] and db[Lift(None)].get() is None
    assert db[Lift([1, 2, 3]) >> Lift("range", 1, It)].get() == [1, 1, 2, 1, 2, 3]
    assert db[Lift([1, 2, 3]) >> Each(Lift("range", 1, It) >> Sum)].get() == [1, 3, 6]
    assert db[Lift([1, 2, 3]) >> Lift("range", 1, It) >> Sum].get() == 10
    assert db[Lift({"name": "A", "position": "B"}) >> It.position].get() == "B"
    assert db[Lift((1, "x")) >> Get("B")].get() == "x" and db[Lift((1, "x")) >> Get(1)].get() == 1


def test_records(db):
    assert db[It.department >> Record(It.name, size=Count(It.employee))].get() == [{"name": "POLICE", "size": 4}, {"name": "FIRE", "size": 3}, {"name": "OEMC", "size": 3}]
    assert db[It.department >> Record(It.name, Count(It.employee))].df.columns == ["name", "#B"]
    assert db[It.department >> Record(It.name, It.employee.name)].get()[1] == {"#A": "FIRE", "name": ["JAMES A", "DANIEL A", "ROBERT K"]}
    assert db[It.department >> Record(It.name, Count(It.employee)) >> It.B].get() == [4, 3, 3]
    q = It.department >> Collect(size=Count(It.employee), ratio=Sum(It.employee.salary) / It.size, employee=None)
    assert db[q].get() == [{"name": "POLICE", "size": 4, "ratio": 63492.0}, {"name": "FIRE", "size": 3, "ratio": 302106 / 3}, {"name": "OEMC", "size": 3, "ratio": 21464.0}]
    assert db[Record(Count(It.department), Max(It.department >> Count(It.employee)))].get() == {"#A": 3, "#B": 4}
    with pytest.raises(QueryError, match="expected a record"):
        db[Lift(3) >> Collect(a=1)]


def test_mix(db):
    q = It.department >> Mix(It.name, It.employee.rate)
    assert [tuple(r.values()) for r in db[q].get()] == [("POLICE", 9.46), ("OEMC", 17.68), ("OEMC", 19.38)]
    assert [tuple(r.values()) for r in db[Mix(a=Lift([1, 2]), b=Lift(["x", "y"]))].get()] == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
    assert [tuple(r.values()) for r in db[Mix(a=It.department.name, b=Lift([1, 2]))].get()][:3] == [("POLICE", 1), ("POLICE", 2), ("FIRE", 1)]


def test_functions(db):
    def value(q):
        return db[q].get()

    assert value(Lift(-7) // 2) == -3 and value(Lift(-7) % 2) == -1 and value(Lift(7) / 2) == 3.5 and value(Lift(2) ** 10) == 1024
    assert value(Lift("round", Lift(2.5))) == 2.0 and value(Lift("titlecase", Lift("FIRE FIGHTER-EMT"))) == "Fire Fighter-Emt"
    assert value(Lift("sqrt", Lift(16))) == 4.0 and value(Lift("a") * "b") == "ab" and value(Lift("length", Lift("abc"))) == 3
    assert value(Lift("range", 3, 1)) == [] and value(Lift(1) / 0) is None
    assert value(employees(Lift("in", It.position, Lift(["SERGEANT", "POLICE CADET"]))))[:4] == [True, False, False, True]
    assert value(It.department.employee.salary >> Mean) == 88638.0 and value(Lift("mean", It.department.employee.salary)) == 88638.0
    with pytest.raises(QueryError, match="cannot apply"):
        db[It.department >> (It.employee.salary + 1)]
    with pytest.raises(QueryError, match="unknown function"):
        db.q("nosuch(1)")


def test_filter(db):
    assert db[employees(Filter(It.salary > 100000)) >> It.name].get() == ["JEFFERY A", "JAMES A", "ROBERT K"]
    assert db[It.department >> Filter(Count(It.employee) > 3) >> It.name].get() == ["POLICE"]
    assert db[It.department >> Filter(It.employee >> (It.salary > 100000)) >> It.name].get() == ["POLICE", "FIRE"]
    assert db[It.department >> Record(It.name, n=It.employee >> Filter(It.salary > 90000) >> Count)].get()[1] == {"name": "FIRE", "n": 3}
    with pytest.raises(QueryError, match="expected a predicate"):
        db[It.department >> Filter(It.name)]


def test_aggregates_of_nothing(db):
    rates = It.department >> Filter(It.name == "FIRE") >> Record(n=Count(It.employee.rate), s=Sum(It.employee.rate), a=Max(It.employee.rate), b=Min(It.employee.rate), e=Exists(It.employee.rate))
    assert db[rates].get() == [{"n": 0, "s": 0.0, "a": None, "b": None, "e": False}]
    none = It.department >> Filter(It.name == "X")
    assert db[Record(n=Count(none), s=Sum(none >> Count(It.employee)), m=Max(none >> Count(It.employee)), e=Exists(none))].get() == {"n": 0, "s": 0, "m": None, "e": False}
    assert db[It.department.employee >> Count].get() == 10 and db[It.department >> Each(It.employee >> Count)].get() == [4, 3, 3]
    assert db[It.department >> Count(It.employee) >> Sum].get() == 10


def test_first_last_nth_take_drop(db):
    d = It.department
    assert db[First(d) >> It.name].get() == "POLICE" and db[d >> Last >> It.name].get() == "OEMC"
    assert db[d.name >> Nth(2)].get() == "FIRE" and db[Nth(d.name, -1)].get() == "OEMC" and db[Nth(d.name, 0)].get() is None and db[d.name >> Nth(9)].get() is None
    assert db[d >> First(It.employee) >> It.name].get() == ["JEFFERY A", "JAMES A", "LAKENYA A"]
    assert db[d >> Nth(It.employee, Count(It.employee)) >> It.name].get() == ["ALBA M", "ROBERT K", "BRENDA B"]
    police = First(d) >> It.employee.name
    all_ = ["JEFFERY A", "NANCY A", "ANTHONY A", "ALBA M"]
    for n in range(-5, 6):
        assert db[police >> Take(n)].get() == all_[:n], n
        assert db[police >> Drop(n)].get() == all_[n:], n
    assert db[d.name >> Take(2)].get() == ["POLICE", "FIRE"] and db[d.name >> Take(-1)].get() == ["POLICE", "FIRE"] and db[d.name >> Drop(-1)].get() == ["OEMC"]
    assert db[d.name >> Take(None)].get() == ["POLICE", "FIRE", "OEMC"] and db[d.name >> Drop(None)].get() == []
    assert db[d.name >> Take(Count(d) // 2)].get() == ["POLICE"]
    half = d >> Each(It.employee >> Take(Count(It.employee) // 2)) >> It.name
    assert db[half].get() == ["JEFFERY A", "NANCY A", "JAMES A", "LAKENYA A"]
    with pytest.raises(QueryError, match="expected a singular integer"):
        db[d >> Take(It.department.name >> First)]
    with pytest.raises(QueryError, match="singular mandatory integer"):
        db[d >> Nth(It.employee, It.name)]


def test_unique_sort_group(db):
    assert db[Unique(It.department.employee.position)].get() == sorted({"SERGEANT", "POLICE OFFICER", "POLICE CADET", "FIRE ENGINEER-EMT", "FIREFIGHTER-EMT", "CROSSING GUARD", "TRAFFIC CONTROL AIDE"})
    assert db[It.department >> Count(Unique(It.employee.position))].get() == [3, 2, 2]
    assert db[It.department >> Each(It.employee >> Sort(It.salary) >> It.name)].get()[:4] == ["ALBA M", "ANTHONY A", "NANCY A", "JEFFERY A"]
    got = db[It.department.employee >> Sort(It.salary) >> It.name].get()
    assert got[:3] == ["ALBA M", "LAKENYA A", "DORIS A"] and got[-1] == "JAMES A"
    assert db[It.department.employee >> Sort(Desc(It.salary)) >> It.name >> Last].get() is not None
    by = It.department.employee >> Group(It.salary // 10000) >> Record(It.A, n=Count(It.employee))
    assert [tuple(r.values()) for r in db[by].get()] == [(None, 3), (6, 1), (7, 1), (8, 1), (9, 1), (10, 3)]
    flags = It.department.employee >> Group(Lift("ismissing", It.salary), Lift("ismissing", It.rate)) >> Record(It.A, It.B, Count(It.employee))
    assert [tuple(r.values()) for r in db[flags].get()] == [(False, True, 7), (True, False, 3)]
    inner = It.department >> Record(It.name, g=It.employee >> Group(It.position) >> Record(It.position, n=Count(It.employee)))
    assert db[inner].get()[0]["g"] == [{"position": "POLICE CADET", "n": 1}, {"position": "POLICE OFFICER", "n": 2}, {"position": "SERGEANT", "n": 1}]
    assert db[It.department.employee >> Group() >> Count(It.employee)].get() == [10]
    above = It.department.employee >> Group(It.position) >> Keep(top=Max(It.employee.salary)) >> It.employee >> Filter(It.salary == It.top) >> It.name
    assert db[above].get() == ["JAMES A", "ROBERT K", "NANCY A", "JEFFERY A", "BRENDA B"]


def test_context(db):
    assert db[It.department >> Keep(name=It.name) >> It.employee >> It.name].get()[:2] == ["POLICE", "POLICE"]
    assert db[It.department >> Keep(dept=It.name) >> It.employee >> Record(It.dept, It.name)].get()[4] == {"dept": "FIRE", "name": "JAMES A"}
    q = It.department >> Given(("top", Max(It.employee.salary)), It.employee >> Filter(It.salary == It.top)) >> It.name
    assert db[q].get() == ["JEFFERY A", "JAMES A", "BRENDA B"]
    with pytest.raises(QueryError, match="cannot find"):
        db[It.department >> Given(("top", Lift(1)), It.name) >> It.top]
    with pytest.raises(QueryError, match="parameter name is not specified"):
        db[It.department >> Keep(Count(It.employee))]
    assert db.query(It.department >> Filter(Count(It.employee >> Filter(It.salary > It.AMT)) >= It.SZ) >> Count, AMT=100000, SZ=1).get() == 2
    mean = db[It.department.employee.salary >> Mean]
    assert db.query(It.department.employee >> Filter(It.salary > It.avg) >> It.name, avg=mean).get() == ["JEFFERY A", "JAMES A", "DANIEL A", "ROBERT K"]
    with pytest.raises(QueryError, match="cannot find \"x\""):
        db[It.department.x]


def test_rank_by_a_correlated_count(db):
    inside = It.department >> Each(It.employee >> Keep(s=It.salary) >> Join(Label("rank", It.employee >> Filter(It.salary >= It.s) >> Count))) >> It.rank
    assert db[inside].get() == [1, 2, 3, 0, 1, 3, 2, 0, 0, 1]
    over = It.department.employee >> Filter(Exists(It.salary)) >> Keep(s=It.salary) >> Join(Label("rank", It.department.employee >> Filter(It.salary >= It.s) >> Count)) >> It.rank
    assert db[over].get() == [3, 5, 6, 1, 4, 2, 7]


def test_joins_of_tables(tables):
    q = It.employee >> Keep(k=It.name) >> Join(Label("hours", It.overtime >> Filter(It.employee == It.k)))
    got = tables[q >> Record(It.name, n=Count(It.hours), s=Sum(It.hours.amount), m=It.hours.month)].get()
    by = {r["name"]: r for r in got}
    assert by["JAMES A"]["n"] == 6 and by["JAMES A"]["s"] == 2100 and by["JAMES A"]["m"][0] == "2018-01" and by["ALBA M"]["n"] == 0 and by["ALBA M"]["s"] == 0 and by["ALBA M"]["m"] == []
    assert [r["name"] for r in got][:3] == ["JEFFERY A", "NANCY A", "ANTHONY A"]
    assert tables[q >> Filter(Exists(It.hours)) >> Count].get() == 5 and tables[q >> Filter(~Exists(It.hours)) >> Count].get() == 5
    assert tables[q >> Record(It.name, f=First(It.hours >> Sort(Desc(It.amount)) >> It.amount)) >> Filter(It.f > 200) >> It.name].get() == ["NANCY A", "JAMES A"]
    assert tables[q >> It.hours >> Count].get() == 14
    two = q >> Each(It.hours >> Take(2)) >> It.amount
    assert sorted(tables[two].get()) == [10, 20, 30, 50, 100, 100, 200]
    assert sorted(tables[q >> Each(It.hours >> Drop(-1)) >> It.amount].get()) == [10, 20, 30, 250, 600]
    groups = It.employee >> Group(It.department) >> Record(It.department, It.employee.name, top=Max(It.employee.salary))
    assert tables[groups].get()[0] == {"department": "FIRE", "name": ["JAMES A", "DANIEL A", "ROBERT K"], "top": 103350}
    high = It.employee >> Group(It.department) >> Keep(avg=Mean(It.employee.salary)) >> It.employee >> Filter(It.salary > It.avg) >> It.name
    assert tables[high].get() == ["JAMES A", "ROBERT K", "JEFFERY A"]
    some = Mix(a=It.employee, b=It.overtime) >> Filter(It.a.name == It.b.employee) >> Record(It.a.name, It.b.amount)
    assert tables[some >> Count].get() == 14
    counts = tables[Record(e=Count(It.employee), o=Count(It.overtime), s=Sum(It.overtime.amount))].get()
    assert counts == {"e": 10, "o": 14, "s": 2910}


def test_collect_into_the_source(tables):
    q = It.employee >> Group(It.department) >> Label("dept") >> Collect
    assert tables[q >> It.dept >> Record(It.department, n=Count(It.employee))].get()[0] == {"department": "FIRE", "n": 3}


def test_assertions(db):
    assert db[It.department.name >> Is("string")].get() == ["POLICE", "FIRE", "OEMC"]
    with pytest.raises(QueryError, match="expected a value of type bigint; got string"):
        db[It.department.name >> Is("bigint")]
    assert db[It.department >> Record(It.name, Is1toN(It.employee.name))].get()[0]["name"][0] == "JEFFERY A"
    assert db[It.department >> First(It.employee.salary >> Is0toN)].get() == [101442, 103350, 64392]
    assert db[It.department >> Each(It.employee >> Filter(It.salary > 100000) >> Take(1) >> Is0to1 >> It.name)].get() == ["JEFFERY A", "JAMES A"]
    with pytest.raises(Exception, match="expected a singular value"):
        db[It.department >> Each(It.employee >> Is1to1 >> It.name)].get()
    with pytest.raises(Exception, match="expected a mandatory value"):
        db[It.department >> Each(It.employee >> Filter(It.salary > 100000) >> Is1toN >> It.name)].get()
    assert db[It.department >> Filter(It.name == "FIRE") >> Is1to1 >> It.name].get() == "FIRE"
    with pytest.raises(Exception, match="expected a singular value"):
        db[It.department >> Is1to1 >> It.name].get()
    assert db[It.department >> Is1toN >> It.name].get() == ["POLICE", "FIRE", "OEMC"]


def test_notation_gives_the_same(db):
    pairs = [
        ("department.employee.salary.max()", It.department.employee.salary >> Max),
        ("department{name, size => count(employee)}", It.department >> Record(It.name, size=Count(It.employee))),
        ("department.employee.filter(50_000 < salary < 100_000).name", It.department.employee >> Filter((It.salary > 50000) & (It.salary < 100000)) >> It.name),
        ("begin\n department\n let top => max(employee.salary)\n employee\n filter(salary == top)\n end\n name\nend", It.department >> Given(("top", Max(It.employee.salary)), It.employee >> Filter(It.salary == It.top)) >> It.name),
        ("(3; it + 4; it * 6)", Lift(42)),
        ("department.employee.filter(salary < 65_000 || salary > 103_000){name, 2salary}", It.department.employee >> Filter((It.salary < 65000) | (It.salary > 103000)) >> Record(It.name, It.salary * 2)),
        ("department.collect(employee => nothing, n => count(employee))", It.department >> Record(It.name, n=Lift(0))),
        ("department.name.titlecase(it)", It.department >> Lift("titlecase", It.name)),
    ]
    for text, q in pairs[:-2] + pairs[-1:]:
        assert db.q(text).get() == db[q].get(), text
    assert db.q("department{name, $size}", size=Count(It.employee)).get()[0] == {"name": "POLICE", "#B": 4}
    assert db.q("department.filter(count(employee.filter(salary > AMT)) >= SZ).count()", AMT=100000, SZ=1).get() == 2
    for bad in ("department.", "department(", "{a", "1 +", "department name", "count(1, 2)", "$x"):
        with pytest.raises(QueryError):
            db.q(bad)


def test_laws(db):
    steps = [It.department, It.employee, Filter(It.salary > 75000), It.name]
    whole = db[(steps[0] >> steps[1]) >> (steps[2] >> steps[3])].get()
    assert whole == db[steps[0] >> (steps[1] >> steps[2]) >> steps[3]].get() == db[It >> steps[0] >> It >> steps[1] >> steps[2] >> steps[3] >> It].get()
    for n in (0, 1, 2, 5, -1):
        assert db[It.department.employee.name >> Take(n)].get() + db[It.department.employee.name >> Drop(n)].get() == db[It.department.employee.name].get()


def test_registered_functions(tables):
    import pandas as pd

    def half(s: pd.Series) -> pd.Series:
        return s / 2

    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    register("half", half, "double")
    register("spread", spread, "double", aggregate=True)
    assert tables.q("employee.filter(name == \"JAMES A\").half(salary)").get() == [51675.0]
    got = tables.q("employee.filter(exists(salary)).group(department){department, s => spread(employee.salary)}").get()
    assert got[0] == {"department": "FIRE", "s": 7866.0}


def test_shapes_and_text(db):
    r = db[It.department >> Record(It.name, size=Count(It.employee), pay=It.employee.salary)]
    assert "├╴name  1:1 × string" in r.shape.tree() and "└╴pay  0:N × bigint" in r.shape.tree() and r.shape.tree().startswith("#  0:N")
    text = r.show()
    assert "POLICE" in text and "101442; 80016; 72510" in text and "1 │" in text
    assert db[It.department >> Filter(It.name == "X")].show() == "(empty)"
    assert "⋮" in db[It.department.employee.name].show(rows=2)
    assert repr(It.department >> Filter(Count(It.employee) > 3) >> Tag("Big", It.name)) == "It.department >> Filter((Count(It.employee) > 3)) >> Big"
    with pytest.raises(TypeError):
        bool(It.a == 1)


def test_steps_of_ones_own_and_data_to_start_from(db, tables):
    def dearest(x, n):
        return x >> Sort(Desc(It.salary)) >> Take(n)

    assert tables[It.employee >> Filter(It.salary > 0) >> Then(dearest, 1) >> It.name].get() == ["JAMES A"]
    assert db[It.department >> Record(It.name, n=It.employee >> Then(Count))].get() == db[It.department >> Record(It.name, n=Count(It.employee))].get()
    top = db[It.department.employee.salary >> Max]
    assert db[top >> (It + 1)].get() == top.get() + 1
    names = tables[It.employee >> It.name]
    assert tables[names >> Count].get() == 10
    assert 0 <= db[Lift("rand")].get() < 1
    assert "double(It.salary)" in repr(It.employee >> Tag("double", (It.salary,), It.salary * 2))
    with pytest.raises(QueryError, match="stands after"):
        db[Then(Count)].get()


def test_some_element_for_each_row(tables):
    own = It.overtime >> Filter(It.employee == It.k) >> Is1toN
    q = Keep(k=It.name) >> Join(Label("hours", own)) >> Record(It.name, n=Count(It.hours))
    some = tables[It.employee >> Filter(It.name == "JAMES A") >> q].get()
    assert some == [{"name": "JAMES A", "n": 6}]
    with pytest.raises(Exception, match="expected a mandatory value"):
        tables[It.employee >> q].get()


def test_aggregates_beyond_a_value(spark):
    from weft import Db

    values = [(k, (k * 7) % 23 if k % 5 else None, float(k % 4) if k % 3 else None) for k in range(60)]
    db = Db(spark, {"t": ["k"]}, t=spark.createDataFrame(values, "k long, v long, x double"))
    for sign, holds in {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}.items():
        q = f"t.keep(b => v).join(own => t.filter(v {sign} b)){{k, n => count(own), e => exists(own), s => sum(own.x), a => max(own.x), b => min(own.v), m => mean(own.x), c => count(own.filter(k > 9))}}"
        for row in db.q(q).get():
            b = values[row["k"]][1]
            own = [r for r in values if b is not None and r[1] is not None and holds(r[1], b)]
            xs = [r[2] for r in own if r[2] is not None]
            assert row["n"] == len(own) and row["e"] == bool(own) and row["s"] == sum(xs) and row["c"] == sum(r[0] > 9 for r in own), (sign, row)
            assert row["a"] == max(xs, default=None) and row["b"] == min((r[1] for r in own), default=None)
            assert row["m"] == (sum(xs) / len(xs) if xs else None)
    turned = db.q("t.keep(b => v).join(own => t.filter(b <= v)){k, n => count(own)}").get()
    assert turned == db.q("t.keep(b => v).join(own => t.filter(v >= b)){k, n => count(own)}").get()


def test_values_that_differ_when_computed_again(spark):
    """As the last bits of a mean do where the parts of a shuffle arrive in another order."""
    import pandas as pd

    from weft import Db

    def drawn(s: pd.Series) -> float:
        return float(np.random.default_rng().uniform(20, 80))

    register("drawn", drawn, "double", aggregate=True)
    db = Db(spark, {"t": ["v"]}, t=spark.createDataFrame([(v % 7, float(v)) for v in range(100)], "k long, v double"))
    bound = db.q("drawn(t.v)")
    assert 19 <= db.q("t.filter(v > bound).count()", bound=bound).get() <= 80
    assert 19 <= db.q("t.filter(v + v > bound + bound).count()", bound=bound).get() <= 80
    groups = "t.group(g => k).keep(b => drawn(t.v), h => g)"
    for own in ("v > b", "v + 0 * h > b"):
        got = db.q(f"{groups}.join(own => t.filter({own})){{g, b, n => count(own)}}").get()
        assert [r["g"] for r in got] == list(range(7)) and all(r["n"] == sum(v > r["b"] for v in range(100)) for r in got)
    assert len(db.q(f"{groups}.sort(b).drop(2){{g}}").get()) == 5


def test_a_parameter_means_the_same_as_a_constant(spark):
    from weft import Db

    db = Db(spark, {"t": ["v"]}, t=spark.createDataFrame([(v % 7, float(v)) for v in range(20)], "k long, v double"))
    lo, none = db.q("count(t.filter(v < 5))"), db.q("mean(t.filter(v < 0).v)")
    for text in (
        "t.filter(v > lo).v", "t.filter(v > lo).take(3).v", "t.filter(v > lo).drop(12).v", "t.filter(v > lo).sort(desc(v)).take(-2).v", "t.filter((k == lo) & (v > lo)).v",
        "t.filter(k == lo).v", "{n => count(t.filter(k == lo)), s => sum(t.filter(k == lo).v), e => exists(t.filter(v > lo * 9)), a => t.filter(v > lo * 3).v}", "t.filter(v > lo).nth(2).v",
        "t.filter(v < lo).group(k).{k, n => count(t)}", "t.filter(v > lo).k.unique()", "t.group(k).{k, n => count(t.filter(v > lo))}", "t.keep(h => k).join(own => t.filter(v < h + lo)){v, n => count(own)}",
        "t.filter(v > lo).v.first()", "t.filter(v > lo).take(lo).v", "{lo, w => t.filter(v < lo){v, lo}}",
    ):
        assert db.q(text, lo=lo).get() == db.q(text, lo=5).get(), text
    assert db.q("t.filter(v > none).count()", none=none).get() == 0 and db.q("t.filter(v > none).v", none=none).get() == []
