"""The queries by name: in the string notation or built from combinators, with the SQL that means the same.

Each entry is (query, SQL); `params` are the query's parameters. Tables are read with the order of their keys.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions.scalars import register
from .operators.query import Count, It, Label, Lift, Mean, Query, Record, Sum, Tag
from .sources.db import Db, Result

ORDER = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "events": ["event_id"], "embeddings": ["vec_id"], "conversations": ["conv_id", "turn"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"],
}


def database(spark: SparkSession, sf_dir: str) -> Db:
    return Db(spark, ORDER, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ORDER})


#: name -> (query, SQL). Columns of both have the same names; sums are rounded, counts are bigint.
QUERIES: dict[str, tuple[str | Query, str]] = {
    # navigation, constants, records
    "get_path": ("orders.o_orderkey", "select o_orderkey from orders"),
    "compose_constants": ("(3; it + 4; it * 6; {answer => it})", "select 42::bigint as answer"),
    "record_labels": ("part{p_partkey, double => p_size * 2, p_size ÷ 7}", 'select p_partkey, p_size::bigint * 2 as double, (p_size // 7)::bigint as "#C" from part'),
    "record_dup_label": ("orders{o_orderkey, o_orderkey}", 'select o_orderkey as "#A", o_orderkey from orders'),
    "label_ordinal_get": ("part{p_partkey, p_size + 1}.B", "select p_size::bigint + 1 as value from part"),
    "collect_add": ("nation.collect(k => n_nationkey + 1)", "select *, n_nationkey::bigint + 1 as k from nation"),
    "collect_replace": ("nation.collect(n_name => lowercase(n_name))", "select n_nationkey, lower(n_name) as n_name, n_regionkey from nation"),
    "collect_remove": ("nation.collect(n_regionkey => nothing)", "select n_nationkey, n_name from nation"),
    "tag": (It.nation >> Record(Label("loud", Tag("shout", (It.n_name,), Lift("uppercase", It.n_name))), Label("k", Tag("key", It.n_nationkey))), "select upper(n_name) as loud, n_nationkey as k from nation"),
    "lift_const_vector": (It.region >> Record(It.r_name, Label("v", Lift([3, 1, 2])), Label("n", Count(Lift([3, 1, 2]))), Label("s", Lift([3, 1, 2]) >> (It * 2) >> Sum)), "select r_name, [3, 1, 2]::bigint[] as v, 3::bigint as n, 12::bigint as s from region"),
    "lift_vector_card": (It.region >> Record(It.r_name, Label("one", Lift([7], card="x1to1")), Label("some", Lift([7, 8], card="x1toN"))), "select r_name, 7::bigint as one, [7, 8]::bigint[] as some from region"),
    "lift_range": ("region.keep(r => r_name).range(1, r_regionkey){r, i => it}", "select r_name as r, i::bigint as i from region, range(1, r_regionkey::bigint + 1) t(i)"),
    "lift_str": ("part{p_partkey, a => titlecase(p_name), b => length(p_type), c => p_brand * \"-\" * string(p_size)}", "select p_partkey, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') as a, length(p_type)::bigint as b, p_brand || '-' || p_size::varchar as c from part"),
    "lift_round": ("part{p_partkey, r => round(p_retailprice / 2), t => trunc(p_retailprice), m => p_size % 7, o => isodd(p_size)}", "select p_partkey, round_even(p_retailprice / 2, 0) as r, trunc(p_retailprice)::bigint as t, (p_size % 7)::int as m, p_size % 2 <> 0 as o from part"),
    "lift_power": ("part{p_partkey, a => p_size ^ 2, b => round(√p_retailprice, 6), c => 2p_size}", "select p_partkey, (p_size ** 2)::bigint as a, round_even(sqrt(p_retailprice), 6) as b, 2 * p_size::bigint as c from part"),
    "lift_text": ("part{p_partkey, w => split(p_name, \" \"), n => count(split(p_name, \" \")), c => char(65 + p_size % 26)}", "select p_partkey, string_split(p_name, ' ') as w, len(string_split(p_name, ' '))::bigint as n, chr((65 + p_size % 26)::int) as c from part"),
    "lift_in": ("embeddings{vec_id, a => in(embedding.(it).nth(2), embedding.drop(1)), b => in(0.5, embedding), n => length(embedding)}", "select vec_id, list_contains(embedding[2:], embedding[2]) as a, list_contains(embedding, 0.5::float) as b, len(embedding)::bigint as n from embeddings"),
    "lift_missing": ("events{event_id, gone => ismissing(value), user => coalesce(user_id, 0)}", "select event_id, value is null as gone, coalesce(user_id, 0)::bigint as user from events"),
    # filters
    "filter_cmp": ("orders.filter(o_totalprice > 100000){o_orderkey, o_totalprice}", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000"),
    "filter_chain_and_or": ("lineitem.filter(5 < l_quantity <= 10 && (l_discount > 0.05 || l_tax == 0.0)){l_orderkey, l_linenumber, l_quantity}", "select l_orderkey, l_linenumber, l_quantity from lineitem where 5 < l_quantity and l_quantity <= 10 and (l_discount > 0.05 or l_tax = 0)"),
    "filter_plural_any": ("customer.keep(k => c_custkey).join(own => orders.filter(o_custkey == k)).filter(own.(o_totalprice > 300000)).c_custkey", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)"),
    "semi": ("customer.keep(k => c_custkey).join(own => orders.filter(o_custkey == k && o_orderpriority == \"1-URGENT\")).filter(exists(own)).c_custkey", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')"),
    "anti": ("orders.keep(k => o_orderkey).join(lines => lineitem.filter(l_orderkey == k)).filter(!exists(lines)).o_orderkey", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)"),
    # aggregates
    "count_root": ("{n => count(orders), m => count(lineitem.filter(l_quantity > 30))}", "select (select count(*) from orders)::bigint as n, (select count(*) from lineitem where l_quantity > 30)::bigint as m"),
    "exists_root": ("{e => exists(orders.filter(o_totalprice < 0)), f => exists(orders)}", "select exists (select 1 from orders where o_totalprice < 0) as e, exists (select 1 from orders) as f"),
    "sum_max_min_mean": ("{s => round(sum(lineitem.l_quantity)), a => max(lineitem.l_quantity), b => min(lineitem.l_quantity), m => round(mean(lineitem.l_quantity), 4)}", "select round_even(sum(l_quantity), 0) as s, max(l_quantity) as a, min(l_quantity) as b, round_even(avg(l_quantity), 4) as m from lineitem"),
    "agg_empty": ("{a => max(orders.filter(o_totalprice < 0).o_totalprice), b => min(orders.filter(o_totalprice < 0).o_orderkey), m => mean(orders.filter(o_totalprice < 0).o_totalprice), f => first(orders.filter(o_totalprice < 0).o_orderkey), n => count(orders.filter(o_totalprice < 0).o_orderkey)}", "select max(o_totalprice) as a, min(o_orderkey) as b, avg(o_totalprice) as m, first(o_orderkey) as f, count(*)::bigint as n from orders where o_totalprice < 0"),
    "agg_of_nothing": ("{n => count(orders.filter(o_totalprice < 0)), s => sum(orders.filter(o_totalprice < 0).o_totalprice), e => exists(orders.filter(o_totalprice < 0))}", "select 0::bigint as n, 0.0::double as s, false as e"),
    "each_barrier": ("region.keep(k => r_regionkey).join(own => nation.filter(n_regionkey == k)).each(own.count()).{n => it}", "select (select count(*) from nation where n_regionkey = r_regionkey)::bigint as n from region"),
    # groups
    "group_count": ("orders.group(o_orderpriority){o_orderpriority, n => count(orders)}", "select o_orderpriority, count(*)::bigint as n from orders group by 1"),
    "group_multi": ("lineitem.group(l_returnflag, l_linestatus){l_returnflag, l_linestatus, n => count(lineitem), qty => round(sum(lineitem.l_quantity)), price => round(sum(lineitem.(l_extendedprice * (1 - l_discount))), 2), disc => round(mean(lineitem.l_discount), 6)}", "select l_returnflag, l_linestatus, count(*)::bigint as n, round_even(sum(l_quantity), 0) as qty, round_even(sum(l_extendedprice * (1 - l_discount)), 2) as price, round_even(avg(l_discount), 6) as disc from lineitem group by 1, 2"),
    "group_filtered_members": ("lineitem.group(l_shipdate => date(l_shipdate)){l_shipdate, big => count(lineitem.filter(l_quantity > 40)), all => count(lineitem)}.filter(big > 0)", "select l_shipdate::date as l_shipdate, count(*) filter (where l_quantity > 40)::bigint as big, count(*)::bigint as all from lineitem group by 1 having big > 0"),
    "group_no_key": ("orders.group(){n => count(orders), top => max(orders.o_totalprice)}", "select count(*)::bigint as n, max(o_totalprice) as top from orders"),
    "group_first_last": ("orders.group(o_custkey){o_custkey, a => first(orders.o_orderkey), b => last(orders.sort(o_totalprice, o_orderkey).o_orderkey)}", "select o_custkey, min(o_orderkey) as a, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) as b from orders group by 1"),
    "group_members_nested": ("orders.group(o_orderstatus){o_orderstatus, cheap => orders.sort(o_totalprice, o_orderkey).take(3).o_orderkey}", "select o_orderstatus, list(o_orderkey order by o_totalprice, o_orderkey)[1:3] as cheap from orders group by 1"),
    "group_keep_window": ("orders.group(o_custkey).keep(avg => mean(orders.o_totalprice)).orders.filter(o_totalprice > avg){o_orderkey, o_custkey}", "select o_orderkey, o_custkey from orders qualify o_totalprice > avg(o_totalprice) over (partition by o_custkey)"),
    "group_of_groups": ("customer.group(c_nationkey){c_nationkey, n => count(customer)}.label(groups).group(big => n > 5){big, nations => count(groups), people => sum(groups.n)}", "select n > 5 as big, count(*)::bigint as nations, sum(n)::bigint as people from (select count(*) as n from customer group by c_nationkey) group by 1"),
    # distinct, order, paging
    "unique_scalar": ("orders.o_orderstatus.unique(){s => it}", "select distinct o_orderstatus as s from orders"),
    "unique_record": ("part{p_brand, p_size}.unique()", "select distinct p_brand, p_size from part"),
    "count_unique": ("{n => count(unique(lineitem.l_partkey)), m => count(part.p_brand.unique())}", "select (select count(distinct l_partkey) from lineitem)::bigint as n, (select count(distinct p_brand) from part)::bigint as m"),
    "sort_take": ("orders.sort(o_totalprice, o_orderkey).take(10){o_orderkey, o_totalprice}", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 10"),
    "sort_desc_take": ("orders.sort(desc(o_totalprice), o_orderkey).take(10).o_orderkey", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10"),
    "sort_desc_text": ("part.sort(desc(p_name), p_partkey).take(20){p_partkey, p_name}", "select p_partkey, p_name from part order by p_name desc, p_partkey limit 20"),
    "take_neg": ("nation.take(-20).n_name", "select n_name from nation order by n_nationkey limit 5"),
    "drop": ("nation.drop(20).n_name", "select n_name from nation order by n_nationkey offset 20"),
    "drop_neg": ("nation.drop(-3).n_name", "select n_name from nation order by n_nationkey offset 22"),
    "take_query": ("nation.take(count(region) ÷ 2).n_name", "select n_name from nation order by n_nationkey limit 2"),
    "drop_missing": ("{n => count(nation.drop(missing)), m => count(nation.take(missing))}", "select 0::bigint as n, count(*)::bigint as m from nation"),
    "first_last_nth": ("{a => first(nation).n_name, b => last(nation.n_name), c => nth(nation.n_name, 3), d => nation.n_name.nth(-2)}", "select (select n_name from nation order by n_nationkey limit 1) as a, (select n_name from nation order by n_nationkey desc limit 1) as b, (select n_name from nation order by n_nationkey limit 1 offset 2) as c, (select n_name from nation order by n_nationkey desc limit 1 offset 1) as d"),
    "nth_per_parent": ("customer.keep(k => c_custkey).join(own => orders.filter(o_custkey == k)){c_custkey, a => first(own.o_orderkey), b => nth(own.o_orderkey, 2), c => own.o_orderkey.nth(-1), z => nth(own.o_orderkey, 0)}", "select c_custkey, l[1] as a, l[2] as b, l[-1] as c, null::bigint as z from (select c_custkey, list(o_orderkey order by o_orderkey) as l from customer left join orders on o_custkey = c_custkey group by 1)"),
    "take_per_parent": ("customer.keep(k => c_custkey).join(own => orders.filter(o_custkey == k)).each(own.sort(o_totalprice, o_orderkey).take(2)){o_custkey, o_orderkey}", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) <= 2"),
    # joins and context
    "join_nest_count": ("customer.keep(k => c_custkey).join(orders => orders.filter(o_custkey == k)){c_custkey, n => count(orders), total => round(sum(orders.o_totalprice), 2)}", "select c_custkey, count(o_orderkey)::bigint as n, coalesce(round_even(sum(o_totalprice), 2), 0) as total from customer left join orders on o_custkey = c_custkey group by 1"),
    "join_empty": ("orders.keep(k => o_orderkey).join(lines => lineitem.filter(l_orderkey == k)){o_orderkey, n => count(lines)}.filter(n == 0)", "select o_orderkey, 0::bigint as n from orders where o_orderkey not in (select l_orderkey from lineitem)"),
    "join_theta_rank": ("supplier.keep(b => s_acctbal).join(rank => count(supplier.filter(s_acctbal >= b))){s_suppkey, rank}", "select s_suppkey, (select count(*) from supplier x where x.s_acctbal >= s.s_acctbal)::bigint as rank from supplier s"),
    "join_two_level": ("region.keep(r => r_regionkey).join(nations => nation.filter(n_regionkey == r).keep(k => n_nationkey).join(people => customer.filter(c_nationkey == k)){n_name, n => count(people)}){r_name, n => count(nations), m => sum(nations.n)}", "select r_name, count(distinct n_nationkey)::bigint as n, count(c_custkey)::bigint as m from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1"),
    "join_nested_output": ("region.keep(r => r_regionkey).join(nations => nation.filter(n_regionkey == r).n_name){r_name, nations}", "select r_name, list(n_name order by n_nationkey) as nations from region join nation on n_regionkey = r_regionkey group by 1"),
    "mix_cross": ("mix(r => region.r_name, n => nation.n_name)", "select r_name as r, n_name as n from region, nation"),
    "mix_filter": ("mix(r => region, n => nation).filter(r.r_regionkey == n.n_regionkey){r.r_name, n.n_name}", "select r_name, n_name from region join nation on r_regionkey = n_regionkey"),
    "keep_parent": ("region.keep(r => r_regionkey, region => r_name).join(own => nation.filter(n_regionkey == r)).own{region, n_name}", "select r_name as region, n_name from region join nation on r_regionkey = n_regionkey"),
    "keep_override": ("nation.keep(a => n_nationkey, a => a + 1){a, n_name}", "select n_nationkey::bigint + 1 as a, n_name from nation"),
    "keep_shadow": ("nation.keep(n_name => lowercase(n_name)).n_name", "select lower(n_name) as n_name from nation"),
    "given_scope": ("region.keep(r => r_regionkey).join(own => nation.filter(n_regionkey == r)).given(c => count(own), c * 2){n => it}", "select 2 * count(n_nationkey)::bigint as n from region left join nation on n_regionkey = r_regionkey group by r_regionkey"),
    "param_scalar": ("orders.filter(o_totalprice > AMT).count(){n => it}", "select count(*)::bigint as n from orders where o_totalprice > 200000"),
    "param_knot": ("orders.filter(o_totalprice > avg).count(){n => it}", "select count(*)::bigint as n from orders where o_totalprice > (select avg(o_totalprice) from orders)"),
    "nth_query_per_parent": ("region.keep(r => r_regionkey).join(own => nation.filter(n_regionkey == r)){r_name, x => own.nth(coalesce(r, 0) + 1).n_name}", "select r_name, l[r_regionkey + 1] as x from (select r_name, r_regionkey, list(n_name order by n_nationkey) as l from region left join nation on n_regionkey = r_regionkey group by all)"),
    "take_query_per_parent": ("region.keep(r => r_regionkey).join(own => nation.filter(n_regionkey == r)){r_name, n => count(own.take(r))}", "select r_name, least(count(n_nationkey), r_regionkey)::bigint as n from region left join nation on n_regionkey = r_regionkey group by r_name, r_regionkey"),
    "drop_per_parent": ("customer.keep(k => c_custkey).join(own => orders.filter(o_custkey == k)).each(own.drop(2)){o_custkey, o_orderkey}", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) > 2"),
    "sort_absent": ("events.sort(user_id, event_id).take(50){event_id, user_id}", "select event_id, user_id from events order by user_id nulls first, event_id limit 50"),
    "group_absent": ("part{p_partkey, k => p_size.filter(it > 25)}.group(k){k, n => count(part)}", "select case when p_size > 25 then p_size end as k, count(*)::bigint as n from part group by 1"),
    "let": ("let top => max(orders.o_totalprice) orders.filter(o_totalprice == top).o_orderkey end", "select o_orderkey from orders where o_totalprice = (select max(o_totalprice) from orders)"),
    "query_function": ("orders.filter($above(o_totalprice, 200000)).count(){n => it}", "select count(*)::bigint as n from orders where o_totalprice > 200000"),
    "param_in_place": ("orders.filter(o_totalprice > $avg).count(){n => it}", "select count(*)::bigint as n from orders where o_totalprice > (select avg(o_totalprice) from orders)"),
    # nested data
    "array_flow": ("embeddings{vec_id, n => count(embedding), a => max(embedding), b => min(embedding), s => round(sum(embedding.float(it)), 6)}", "select vec_id, len(embedding)::bigint as n, list_max(embedding) as a, list_min(embedding) as b, round_even(list_sum(embedding::double[]), 6) as s from embeddings"),
    "array_steps": ("embeddings{vec_id, n => count(embedding.filter(it > 0.0)), t => embedding.sort(it).take(2), l => embedding.drop(-1)}", "select vec_id, len(list_filter(embedding, lambda x: x > 0))::bigint as n, list_sort(embedding)[1:2] as t, embedding[-1:] as l from embeddings"),
    "array_explode": ("embeddings.filter(label == 3).keep(id => vec_id).embedding.filter(it > 0.2){id, x => it}", "select id, x from (select vec_id as id, unnest(embedding) as x from embeddings where label = 3) where x > 0.2::float"),
    "array_group": ("embeddings{vec_id, g => count(embedding.group(it > 0.0))}", "select vec_id, len(list_distinct(list_transform(embedding, lambda x: x > 0)))::bigint as g from embeddings"),
    "dict_get": ("events{event_id, k => parse_map(props).k, z => ismissing(parse_map(props).nosuch)}", "select event_id, json_extract(props, '$.k')::bigint as k, true as z from events"),
    "nested_conv": ("conversations.group(conv_id){conv_id, opens => first(conversations.role), n => count(conversations), own => count(conversations.filter(role == \"user\"))}", "select conv_id, arg_min(role, turn) as opens, count(*)::bigint as n, count(*) filter (where role = 'user')::bigint as own from conversations group by 1"),
    # assertions and functions of the user's own
    "is_type": ("nation.n_name.is(string)", "select n_name from nation"),
    "is_1to1": ("{top => nation.filter(n_nationkey == 0).is1to1().n_name}", "select n_name as top from nation where n_nationkey = 0"),
    "is_widen": ("region.keep(r => r_regionkey).join(own => nation.filter(n_regionkey == r).is0toN()){r_name, n => count(own), key => count(r_regionkey.is0toN())}", "select r_name, count(n_nationkey)::bigint as n, 1::bigint as key from region left join nation on n_regionkey = r_regionkey group by 1"),
    "is_0to1": ("customer.keep(k => c_custkey).join(last => orders.filter(o_custkey == k).take(1).is0to1().o_orderkey){c_custkey, last}", "select c_custkey, min(o_orderkey) as last from customer left join orders on o_custkey = c_custkey group by 1"),
    "is_1toN": ("region.keep(r => r_regionkey).join(own => nation.filter(n_regionkey == r).is1toN()){r_name, n => count(own)}", "select r_name, count(*)::bigint as n from region join nation on n_regionkey = r_regionkey group by 1"),
    "as_collect_aggregate": ("customer.group(c_mktsegment).label(segment).collect().segment{c_mktsegment, n => count(customer)}", "select c_mktsegment, count(*)::bigint as n from customer group by 1"),
    "udf_scalar": ("part{p_partkey, h => half(p_retailprice)}", "select p_partkey, p_retailprice / 2 as h from part"),
    "udf_agg": ("orders.group(o_orderstatus){o_orderstatus, s => round(spread(orders.o_totalprice), 4)}", "select o_orderstatus, round_even(max(o_totalprice) - min(o_totalprice), 4) as s from orders group by 1"),
}


def _half(x):
    return x / 2


def _spread(x) -> float:
    return float(x.max() - x.min())


def _params(name: str, db: Db) -> dict[str, Any]:
    if name == "param_scalar":
        return {"AMT": 200000}
    if name in ("param_knot", "param_in_place"):
        return {"avg": db[It.orders.o_totalprice >> Mean]}
    if name == "query_function":
        return {"above": lambda x, bound: x > bound}
    return {}


def run(name: str, spark: SparkSession, sf_dir: str) -> Result:
    """The result of a query of this catalogue over the tables of a folder."""
    import pandas as pd

    _half.__annotations__ = {"x": pd.Series, "return": pd.Series}
    _spread.__annotations__ = {"x": pd.Series, "return": float}
    register("half", _half, "double")
    register("spread", _spread, "double", aggregate=True)
    db = database(spark, sf_dir)
    query = QUERIES[name][0]
    return db.query(query) if isinstance(query, Query) else db.q(query, **_params(name, db))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, sf_dir, n=n: run(n, spark, sf_dir).df) for n in QUERIES}


def oracle() -> dict[str, str]:
    return {n: sql for n, (_, sql) in QUERIES.items()}
