"""Readings of orders, embeddings, nations and conversations as things to diff and compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provspark.catalog import Tables, query
from provspark.operators import compare, diff

#: name: (table, key, fields, SQL of the new snapshot's columns)
SNAPSHOTS = {
    "orders": ("orders", "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"], {"o_orderstatus": "case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end"}),
    "customer": ("customer", "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"], {"c_nationkey": "case when c_custkey % 13 = 0 then null else c_nationkey end"}),
    "nation": ("nation", "n_nationkey", ["n_name", "n_regionkey"], {"n_name": "case when n_nationkey % 4 = 0 then upper(n_name) || '!' else n_name end"}),
    "part": ("part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size"], {"p_size": "case when p_partkey % 9 = 0 then p_size + 1 else p_size end"}),
    "supplier": ("supplier", "s_suppkey", ["s_name", "s_nationkey"], {"s_name": "case when s_suppkey % 3 = 0 then s_name || 'x' else s_name end"}),
}


def _snapshots(t: Tables, name: str) -> tuple[DataFrame, DataFrame]:
    """Old: without every seventh item from 3. New: without every seventh from 5, some fields changed."""
    table, key, fields, changed = SNAPSHOTS[name]
    df = getattr(t, table).select(key, *fields)
    new = df.where(F.col(key) % 7 != 5).select(key, *[F.expr(changed.get(f, f)).alias(f) for f in fields])
    return df.where(F.col(key) % 7 != 3), new


def _diff_sql(name: str, select: str = "select grp, change, id, ord, field, old, new from d") -> str:
    table, key, fields, changed = SNAPSHOTS[name]
    cols = ", ".join(f"cast({f} as varchar) as {f}" for f in fields)
    news = ", ".join(f"cast({changed.get(f, f)} as varchar) as {f}" for f in fields)
    cells = " union all ".join(f"select '{name}' as grp, 'changed' as change, id, {i} as ord, '{f}' as field, o_{i} as old, n_{i} as new from j where ok and nk and o_{i} is distinct from n_{i}" for i, f in enumerate(fields))
    pairs = ", ".join(f"o.{f} as o_{i}, n.{f} as n_{i}" for i, f in enumerate(fields))
    return f"""
with o as (select cast({key} as varchar) as k, {cols} from {table} where {key} % 7 <> 3),
n as (select cast({key} as varchar) as k, {news} from {table} where {key} % 7 <> 5),
j as (select coalesce(o.k, n.k) as id, o.k is not null as ok, n.k is not null as nk, {pairs} from o full outer join n on o.k = n.k),
d as ({cells} union all select '{name}', case when ok then 'removed' else 'added' end, id, -1, null, null, null from j where not (ok and nk))
{select}
"""


def _register(name: str) -> None:
    _, key, fields, _ = SNAPSHOTS[name]

    @query(_diff_sql(name), f"diff_{name}")
    def run(t: Tables) -> DataFrame:
        return diff.ordered(diff.changes(*_snapshots(t, name), name, key, fields))


for _name in SNAPSHOTS:
    _register(_name)


@query(_diff_sql("nation", "select case when count(*) filter (where change <> 'changed' or field = 'n_regionkey') > 0 then 'differences' when count(*) = 0 then 'none' else 'none_detected' end as conclusion from d"))
def diff_conclusion(t: Tables) -> DataFrame:
    _, key, fields, _ = SNAPSHOTS["nation"]
    found = diff.changes(*_snapshots(t, "nation"), "nation", key, fields)
    return diff.conclusion(found, (F.col("change") != "changed") | (F.col("field") == "n_regionkey"), F.lit(False))


@query("select 'region' as grp, cast(r_regionkey as varchar) as id, 0 as ord, 'r_name' as field, r_name as value from region")
def summary_cells(t: Tables) -> DataFrame:
    return diff.tall(t.region, "region", "r_regionkey", ["r_name"])


#: How the second vector differs: scaled a little, one value NaN, one zeroed.
_CAND = """case when vec_id % 5 = 0 then e when vec_id % 5 = 1 then e * 1.0000001 when vec_id % 5 = 2 and p = 3 then 'NaN'::double when vec_id % 5 = 3 and p = 7 then 0.0 when vec_id % 5 = 4 then e + 0.5 else e end"""
_PAIRS = f"""
with x as (select vec_id, unnest(range(len(embedding))) as p, unnest(embedding)::double as e from embeddings),
y as (select vec_id, p, case when vec_id % 5 = 3 and p = 7 then 0.0 when vec_id % 10 = 2 and p = 3 then 'NaN'::double else e end as r, {_CAND} as c from x),
m as (select vec_id, (r is distinct from c) as off, abs(c - r) as a, case when r <> 0 then abs(c - r) / abs(r) end as q, {{atol}} + {{rtol}} * abs(r) as lim from y),
z as (select vec_id, count(*) as n, count(*) filter (where off) as mismatches, count(*) filter (where off and not coalesce(isfinite(a) and a <= lim, false)) as out_of_tolerance,
 count(*) filter (where off and not coalesce(isfinite(a), false)) as undefined_abs, count(*) filter (where off and not coalesce(isfinite(q), false)) as undefined_rel,
 max(a) filter (where off and isfinite(a)) as ma, max(q) filter (where off and isfinite(q)) as mq from m group by vec_id)
select vec_id, n, mismatches, out_of_tolerance, undefined_abs, undefined_rel, case when undefined_abs > 0 then null else coalesce(ma, 0.0) end as max_abs, case when undefined_rel > 0 then null else coalesce(mq, 0.0) end as max_rel from z
"""


def _pairs(t: Tables) -> DataFrame:
    x = t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "e")).withColumn("e", F.col("e").cast("double"))
    m = F.col("vec_id") % 5
    nan = F.lit(float("nan"))
    zero = (m == 3) & (F.col("p") == 7)
    cand = F.when(m == 0, F.col("e")).when(m == 1, F.col("e") * F.lit(1.0000001)).when((m == 2) & (F.col("p") == 3), nan).when(zero, 0.0).when(m == 4, F.col("e") + 0.5).otherwise(F.col("e"))
    ref = F.when(zero, 0.0).when((F.col("vec_id") % 10 == 2) & (F.col("p") == 3), nan).otherwise(F.col("e"))
    return x.select("vec_id", "p", ref.alias("ref"), cand.alias("cand"))


@query(_PAIRS.format(atol=0.0, rtol=0.0))
def compare_exact(t: Tables) -> DataFrame:
    return compare.differences(_pairs(t), ["vec_id"])


@query(_PAIRS.format(atol=0.0001, rtol=0.001))
def compare_tolerance(t: Tables) -> DataFrame:
    return compare.differences(_pairs(t), ["vec_id"], atol=0.0001, rtol=0.001)


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each vector as one row; the candidate is shorter for every sixth, of another dtype for every seventh, off by 1e-9 for every fourth."""
    e = F.col("embedding").cast("array<double>")
    base = t.embeddings.select("vec_id", F.lit(0).alias("ord"), F.lit("y").alias("row"), F.lit("float64").alias("dtype"), e.alias("values"))
    moved = F.when(F.col("vec_id") % 4 == 0, F.transform("values", lambda v: v + 1e-9)).otherwise(F.col("values"))
    cand = base.withColumn("values", F.when(F.col("vec_id") % 6 == 1, F.slice(moved, 1, 63)).otherwise(moved))
    return base, cand.withColumn("dtype", F.when(F.col("vec_id") % 7 == 2, "float32").otherwise(F.col("dtype")))


_SHAPES = """
with x as (select vec_id, len(embedding) as n, vec_id % 6 <> 1 as shape_match, vec_id % 7 <> 2 as dtype_match, vec_id % 4 = 0 as moved, list_transform(embedding, lambda v: v::double) as e from embeddings),
y as (select *, list_transform(e, lambda v: abs((v + 1e-9) - v)) as errs, list_filter(e, lambda v: (v + 1e-9) <> v) as offs from x)
select vec_id, shape_match, dtype_match, case when not shape_match then n when moved then len(offs) else 0 end as mismatches,
case when not shape_match then 'different' when not dtype_match then 'different' when not moved or len(offs) = 0 then 'exact' else 'within_tolerance' end as verdict from y
"""


@query(_SHAPES)
def compare_shape_mismatch(t: Tables) -> DataFrame:
    ref, cand = _vectors(t)
    return compare.compared_rows(ref, cand, ["vec_id"], F.lit("tolerance"), atol=1e-6).select("vec_id", "shape_match", "dtype_match", "mismatches", "verdict")


@query("""
select label, case max(s) when 4 then 'different' when 3 then 'not_verified' when 2 then 'within_tolerance' else 'exact' end as verdict, min(vec_id) filter (where s <> 3) as first_compared from
(select label, vec_id, case when vec_id % 97 = 5 then 4 when vec_id % 31 = 7 then 3 when vec_id % 3 = 0 then 2 else 1 end as s from embeddings) group by label
""")
def report_verdict(t: Tables) -> DataFrame:
    v = F.when(F.col("vec_id") % 97 == 5, "different").when(F.col("vec_id") % 31 == 7, "not_verified").when(F.col("vec_id") % 3 == 0, "within_tolerance").otherwise("exact")
    rows = t.embeddings.select("label", F.col("vec_id").alias("position"), v.alias("verdict"))
    return compare.overall(rows, ["label"], compared=F.col("verdict") != "not_verified")


@query("""
select o_orderkey, case when o_orderstatus = 'O' or o_custkey % 4 <> 0 or (o_custkey % 3 = 0 and o_orderkey % 2 = 0) then 'exact' when o_orderkey % 5 = 0 then null else 'tolerance' end as rule from orders
""")
def comparison_rule(t: Tables) -> DataFrame:
    rule = F.when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise("tolerance")
    env = F.when(F.col("o_custkey") % 3 == 0, "same").otherwise("unknown")
    same = F.when(F.col("o_orderkey") % 2 == 0, "exact").otherwise("tolerance")
    atol = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(0.1)
    return t.orders.select("o_orderkey", compare.applied_rule(rule, F.col("o_custkey") % 4 == 0, env, same, atol, F.lit(0.0)).alias("rule"))


def _attributes(t: Tables, region: int) -> DataFrame:
    rows = t.nation.where(F.col("n_regionkey") == region)
    cells = F.array(F.struct(F.lit("name").alias("f"), F.col("n_name").alias("v")), F.struct(F.lit("key").alias("f"), F.col("n_nationkey").cast("string").alias("v")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    return rows.select(F.lit("env").alias("env"), F.explode(cells).alias("c"), "k").select("env", F.concat(F.lit("nation"), F.col("k").cast("string"), F.lit("."), F.col("c.f")).alias("item"), F.col("c.v").alias("value"))


@query("""
with a as (select n_regionkey as r, 'nation' || row_number() over (partition by n_regionkey order by n_nationkey) as i, n_name, cast(n_nationkey as varchar) as k from nation),
c as (select r, i || '.name' as item, n_name as value from a union all select r, i || '.key', k from a)
select 'env' as env, coalesce(x.item, y.item) as item, x.value as recorded, y.value as current from (select * from c where r = 0) x full outer join (select * from c where r = 1) y on x.item = y.item where x.value is distinct from y.value
""")
def env_compare(t: Tables) -> DataFrame:
    return compare.environment_differences(_attributes(t, 0), _attributes(t, 1), ["env"])


@query("""
with a as (select conv_id, turn, role, text from conversations where conv_id % 2 = 0), b as (select conv_id - 1 as conv_id, turn, role, text from conversations where conv_id % 2 = 1)
select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) as turn, a.role is not distinct from b.role as same_role, a.text is not distinct from b.text as same_text from a full outer join b on a.conv_id = b.conv_id and a.turn = b.turn
""")
def cross_edition(t: Tables) -> DataFrame:
    side = lambda odd: t.conversations.where(F.col("conv_id") % 2 == odd).select((F.col("conv_id") - odd).alias("conv_id"), "turn", F.col("role").alias(f"role{odd}"), F.col("text").alias(f"text{odd}"))
    joined = side(0).join(side(1), ["conv_id", "turn"], "full_outer")
    return joined.select("conv_id", "turn", F.col("role0").eqNullSafe(F.col("role1")).alias("same_role"), F.col("text0").eqNullSafe(F.col("text1")).alias("same_text"))
