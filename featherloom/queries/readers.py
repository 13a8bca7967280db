"""Readers: rows per key around cut-offs, joins, and windows after joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregators import ByKey, most, total
from ..operators.events import DAY_MS, Conditional, CutOff, EventFeature
from ..operators.joins import JoinedFeature, cogroup_lists, join_keyed, window_after_join
from ..sources import readers
from .base import event_ms, query, r6, table

CUT = 1_705_363_200_000


@query("""select cast(c_custkey as varchar) as key, c_mktsegment segment, round(c_acctbal / 2, 6) half from customer""")
def reader_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = readers.parquet(f"{sf_dir}/customer.parquet", F.col("c_custkey"))
    return reader.generate(spark, [EventFeature("segment", F.col("c_mktsegment"), "PickList"), EventFeature("half", r6(F.col("c_acctbal") / 2), "Real")])


@query(f"""select cast(user_id as varchar) as key, round(sum(value) filter (where (epoch_us(ts) // 1000) >= {CUT} - 604800000 and (epoch_us(ts) // 1000) < {CUT}), 6) as week,
  round(sum(value) filter (where (epoch_us(ts) // 1000) >= {CUT} - 86400000 and (epoch_us(ts) // 1000) < {CUT}), 6) as day,
  count(*) filter (where (epoch_us(ts) // 1000) >= {CUT} and (epoch_us(ts) // 1000) <= {CUT} + 172800000) as after_events from events group by user_id""")
def reader_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global cut-off; a feature's own window overrides the reader's. Every user has a row."""
    reader = readers.parquet(f"{sf_dir}/events.parquet", F.col("user_id")).aggregate(event_ms(), CutOff.unix_epoch(CUT), F.col("event_id"), 7 * DAY_MS, 2 * DAY_MS)
    v = F.col("value")
    out = reader.generate(spark, [EventFeature("week", v), EventFeature("day", v, window_ms=DAY_MS), EventFeature("after_events", F.lit(1), "Integral", lambda x, t, i: F.count(x), response=True)])
    return out.select("key", r6(F.col("week")).alias("week"), r6(F.col("day")).alias("day"), "after_events")


def _conditional_sql(pick: str, keep_all: bool = False) -> str:
    cut = f"coalesce({pick}, {CUT})" if keep_all else pick
    return f"""with c as (select user_id, {cut} cut from events group by 1), e as (select *, (epoch_us(ts) // 1000) t from events)
  select cast(e.user_id as varchar) as key, round(sum(value) filter (where t >= cut - 604800000 and t < cut), 6) spent, count(*) filter (where t >= cut - 604800000 and t < cut) n_before,
  count(case when event_type = 'error' then 1 end) filter (where t >= cut and t <= cut + 86400000) errors from e join c on c.user_id = e.user_id where cut is not null group by e.user_id"""


def _conditional(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    keep = Conditional(F.col("event_type") == "purchase", response_window_ms=DAY_MS, **how)
    reader = readers.parquet(f"{sf_dir}/events.parquet", F.col("user_id")).condition(event_ms(), keep, F.col("event_id"))
    out = reader.generate(spark, [
        EventFeature("spent", F.col("value")), EventFeature("n_before", F.lit(1), "Integral", lambda v, t, i: F.count(v)),
        EventFeature("errors", F.when(F.col("event_type") == "error", 1), "Integral", lambda v, t, i: F.count(v), response=True),
    ])
    return out.select("key", r6(F.col("spent")).alias("spent"), "n_before", "errors")


@query(_conditional_sql("min((epoch_us(ts) // 1000)) filter (where event_type = 'purchase')"))
def reader_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: what users did in the week before their first purchase, and the errors of the day after it."""
    return _conditional(spark, sf_dir)


@query(_conditional_sql("max((epoch_us(ts) // 1000)) filter (where event_type = 'purchase' and value > 150)", keep_all=True))
def reader_conditional_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last large purchase; users without one are cut off at a given time."""
    keep = Conditional((F.col("event_type") == "purchase") & (F.col("value") > 150), keep="max", drop_unmet=False, now_ms=CUT, response_window_ms=DAY_MS)
    reader = readers.parquet(f"{sf_dir}/events.parquet", F.col("user_id")).condition(event_ms(), keep, F.col("event_id"))
    count = lambda v, t, i: F.count(v)
    out = reader.generate(spark, [EventFeature("spent", F.col("value")), EventFeature("n_before", F.lit(1), "Integral", count), EventFeature("errors", F.when(F.col("event_type") == "error", 1), "Integral", count, response=True)])
    return out.select("key", r6(F.col("spent")).alias("spent"), "n_before", "errors")


@query()
def reader_conditional_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible random one of a user's purchases as the cut-off."""
    return _conditional(spark, sf_dir, keep="random", seed=7)


def _join_sql(how: str, keyed: str) -> str:
    return f"""with a as (select case when c_custkey % 3 = 0 then -c_custkey else c_custkey end k, c_acctbal v from customer), b as (select o_custkey k, round(sum(o_totalprice), 4) s from orders group by 1)
  select cast({keyed} as varchar) as key, v, s from a {how} join b on a.k = b.k"""


def _joined(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    # the keys of some customers are changed, so that both sides have rows that match nothing
    k = F.col("c_custkey")
    left = readers.frame(table(spark, sf_dir, "customer"), F.when(k % 3 == 0, -k).otherwise(k), name="customer")
    right = readers.frame(table(spark, sf_dir, "orders"), F.col("o_custkey"), name="orders").aggregate(event_ms("o_orderdate"), tie=F.col("o_orderkey"))
    out = left.join(right, how).generate(spark, [EventFeature("v", F.col("c_acctbal"))], [EventFeature("s", F.col("o_totalprice"))])
    return out.select("key", "v", F.round("s", 4).alias("s"))


@query(_join_sql("full outer", "coalesce(a.k, b.k)"))
def join_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, "outer")


@query(_join_sql("left", "a.k"))
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, "left_outer")


@query(_join_sql("inner", "a.k"))
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, "inner")


@query("""select o.o_orderkey as order_key, o.o_orderpriority priority, c.c_mktsegment segment from orders o left join customer c on case when c.c_custkey % 5 = 0 then -c.c_custkey else c.c_custkey end = o.o_custkey""")
def join_child_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    k = F.col("c_custkey")
    parent = table(spark, sf_dir, "customer").select(F.when(k % 5 == 0, -k).otherwise(k).alias("key"), F.col("c_mktsegment").alias("segment"))
    return join_keyed(child, parent, "left_outer", left_key="o_custkey", result="child_parent").select("order_key", "priority", "segment")


@query("""select n.n_name as name, count(s.s_suppkey) n, round(sum(s.s_acctbal), 4) balance from nation n left join supplier s on case when s.s_nationkey % 4 = 1 then -1 else s.s_nationkey end = n.n_nationkey group by 1""")
def join_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    nation = F.col("s_nationkey")
    child = table(spark, sf_dir, "supplier").withColumn("s_nationkey", F.when(nation % 4 == 1, -1).otherwise(nation))
    both = join_keyed(parent, child, "left_outer", right_key="s_nationkey", result="parent_child")
    return both.groupBy("name").agg(F.count("s_suppkey").alias("n"), F.round(F.sum("s_acctbal"), 4).alias("balance"))


@query("""with j as (select o_orderkey k, (epoch_us(o_orderdate) // 1000) cut, o_totalprice p, (epoch_us(l_shipdate) // 1000) t, l_quantity q from orders left join lineitem on l_orderkey = o_orderkey)
  select k as key, max(p) price, sum(q) filter (where coalesce(t, 0) < cut and coalesce(t, 0) > cut - 31536000000) before_qty, max(q) filter (where coalesce(t, 0) >= cut and coalesce(t, 0) < cut + 31536000000) after_qty from j group by k""")
def join_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items shipped within a year of their order, before and after it; both far edges are outside."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_order"), "l_linenumber", event_ms("l_shipdate").alias("t"), F.col("l_quantity").alias("q"))
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), event_ms("o_orderdate").alias("cut"), F.col("o_totalprice").alias("p"))
    both = join_keyed(parents, lines, "left_outer", right_key="line_order", result="parent_child")
    features = [JoinedFeature("price", F.col("p")), JoinedFeature("before_qty", F.col("q"), total), JoinedFeature("after_qty", F.col("q"), most, response=True)]
    return window_after_join(both, "key", F.col("cut"), F.col("t"), features, 365 * DAY_MS, F.col("l_linenumber"))


@query("""with j as (select o_orderpriority k, l_returnflag f, l_quantity q from orders join lineitem on l_orderkey = o_orderkey)
  select k as key, f as flag, sum(q) qty from j group by all""")
def join_window_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-wise aggregation of maps after a join."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.create_map("l_returnflag", "l_quantity").alias("m"))
    both = join_keyed(orders, lines, "inner", right_key="l_orderkey", result="parent_child")
    feature = JoinedFeature("m", F.col("m"), ByKey(total), window_ms=DAY_MS, response=True)
    out = window_after_join(both.drop("key"), "o_orderpriority", F.lit(0), F.lit(0), [feature], DAY_MS)
    return out.select(F.col("o_orderpriority").alias("key"), F.explode("m").alias("flag", "qty"))


@query("""with a as (select c_nationkey k, list(c_custkey order by c_custkey) l from customer group by 1), b as (select case when s_nationkey % 3 = 0 then s_nationkey + 100 else s_nationkey end k, list(s_suppkey order by s_suppkey) r from supplier group by 1)
  select coalesce(a.k, b.k) as nation, array_to_string(coalesce(l, []), ',') left_values, array_to_string(coalesce(r, []), ',') right_values from a full join b on a.k = b.k""")
def join_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("l"))
    nation = F.col("s_nationkey")
    b = table(spark, sf_dir, "supplier").select(F.when(nation % 3 == 0, nation + 100).otherwise(nation).alias("nation"), F.col("s_suppkey").alias("r"))
    out = cogroup_lists(a, b, "nation", "l", "r")
    return out.select("nation", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("left_values", "right_values")])


@query("""select r_name as region, n_name as nation, s_name as supplier from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey""")
def join_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"), "n_regionkey")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("region"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("supplier"), "s_nationkey")
    placed = join_keyed(nations, regions, "inner", left_key="n_regionkey", result="child_parent")
    return join_keyed(placed, suppliers, "inner", left_key="n_nationkey", right_key="s_nationkey", result="parent_child").select("region", "nation", "supplier")
