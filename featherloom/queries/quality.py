"""Statistics of categories and slots, the sanity check, and drift between training and scoring data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectorizers as V
from ..plans import drift, quality
from .base import query, r6, table

_FLAGS = "select l_returnflag v, l_linestatus || case when l_quantity > 40 then '+' else '' end y from lineitem"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.concat("l_linestatus", F.when(F.col("l_quantity") > 40, "+").otherwise(""))
    return quality.contingency(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("v"), y.alias("y")), "v", "y")


@query(f"""with t as (select v, y, count(*) n from ({_FLAGS}) group by all), m as (select *, sum(n) over (partition by v) r, sum(n) over (partition by y) c, sum(n) over () t from t)
  select cast(any_value(t) as bigint) n, round(any_value(t) * (sum(n * n / (r * c)) - 1), 4) chi_squared, round(sqrt((sum(n * n / (r * c)) - 1) / (least(count(distinct v), count(distinct y)) - 1)), 6) cramers_v from m""")
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cramers_v(_flags(spark, sf_dir)).select("n", F.round("chi_squared", 4).alias("chi_squared"), r6(F.col("cramers_v")).alias("cramers_v"))


@query(f"""with t as (select v, y, count(*) n from ({_FLAGS}) group by all), m as (select *, sum(n) over (partition by v) r, sum(n) over (partition by y) c, sum(n) over () t from t)
  select v as value, y as label, n, round(log2(n * t / (r * c)), 6) pmi from m""")
def pointwise_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.pointwise_information(_flags(spark, sf_dir)).select("value", "label", "n", r6(F.col("pmi")).alias("pmi"))


@query(f"""with t as (select v, y, count(*) n from ({_FLAGS}) group by all) select v as value, round(max(n) / sum(n), 6) confidence, round(sum(n) / (select sum(n) from t), 6) support from t group by v""")
def rule_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rule_confidence(_flags(spark, sf_dir)).select("value", r6(F.col("confidence")).alias("confidence"), r6(F.col("support")).alias("support"))


@query("""with u as (select user_id, list(distinct event_type) filter (where value > 150) s, cast(user_id % 3 as int) y from events group by 1), v as (select distinct event_type v from events where value > 150),
  c as (select v, y, count(*) filter (where list_contains(s, v)) n, count(*) cn from v, u group by all), m as (select *, sum(n) over (partition by v) r, sum(cn) over (partition by v) t from c)
  select v as value, round(sqrt(greatest(sum(n * n / (r * cn) + (cn - n) * (cn - n) / ((t - r) * cn)) - 1, 0)), 6) cramers_v from m where r > 0 and r < t group by v""")
def set_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cramer's V of each value of a set column, the rows with it against those without."""
    kinds = F.array_distinct(F.collect_list(F.when(F.col("value") > 150, F.col("event_type"))))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("s")).withColumn("y", (F.col("user_id") % 3).cast("int"))
    return quality.set_association(users, "s", "y").where("cramers_v is not null").select("value", r6(F.col("cramers_v")).alias("cramers_v"))


@query("""select 'l_discount' feature, round(corr(l_discount, l_extendedprice), 6) correlation from lineitem union all select 'l_quantity', round(corr(l_quantity, l_extendedprice), 6) from lineitem union all select 'nothing', null::double""")
def label_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("nothing", F.lit(1.0))
    return quality.correlations(df, ["l_discount", "l_quantity", "nothing"], "l_extendedprice").select("feature", r6(F.col("correlation")).alias("correlation"))


_CHECK = """select case when l_quantity > 25 then 1.0 else 0.0 end::double y, l_quantity q, l_discount d, case when l_quantity > 25 then 'big' when l_tax > 0.04 then 'taxed' else 'plain' end k from lineitem"""


@query(f"""with t as ({_CHECK}) select 'q' slot, round(avg(q), 4) mean, round(var_samp(q), 4) variance, round(corr(q, y), 6) correlation, false leaks from t
  union all select 'd', round(avg(d), 4), round(var_samp(d), 4), round(corr(d, y), 6), false from t
  union all select 'k_k_Big', round(avg(cast(k = 'big' as double)), 4), round(var_samp(cast(k = 'big' as double)), 4), round(corr(cast(k = 'big' as double), y), 6), true from t
  union all select 'k_k_Plain', round(avg(cast(k = 'plain' as double)), 4), round(var_samp(cast(k = 'plain' as double)), 4), round(corr(cast(k = 'plain' as double), y), 6), true from t
  union all select 'k_k_Taxed', round(avg(cast(k = 'taxed' as double)), 4), round(var_samp(cast(k = 'taxed' as double)), 4), round(corr(cast(k = 'taxed' as double), y), 6), true from t""")
def sanity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and correlations of the slots; a category that gives the label away is found."""
    q = F.col("l_quantity")
    kind = F.when(q > 25, "big").when(F.col("l_tax") > 0.04, "taxed").otherwise("plain")
    df = table(spark, sf_dir, "lineitem").select(F.when(q > 25, 1.0).otherwise(0.0).alias("y"), q.alias("q"), F.col("l_discount").alias("d"), kind.alias("k"))
    encoders = [V.fit(df, "numeric", ["q", "d"], "Real", track_nulls=False), V.fit(df, "pivot", ["k"], "PickList", track_nulls=False)]
    found, _ = quality.sanity_check(V.encode(df, encoders), "features", "y")
    rows = [(s.name, s.mean, s.variance, s.correlation, any("association" in r for r in s.reasons)) for s in found if s.indicator != V.OTHER]
    out = spark.createDataFrame(rows, "slot string, mean double, variance double, correlation double, leaks boolean")
    # rounded half up, as in SQL; Python's round goes by the binary value
    return out.select("slot", F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"), r6(F.col("correlation")).alias("correlation"), "leaks")


@query("""with l as (select label, unnest(embedding)::double v, unnest(range(len(embedding))) i from embeddings), s as (select i, var_samp(v) v from l group by 1) select cast(i as integer) slot from s where v > 0.0155""")
def min_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return spark.createDataFrame([(i,) for i in quality.vary_enough(df, "v", 0.0155)], "slot int")


_DRIFT = """with o as (select case when o_orderkey % 2 = 0 then 'a' else 'b' end part, case when o_orderkey % 2 = 0 or o_orderkey % 3 = 0 then o_totalprice + case when o_orderkey % 2 = 1 then 50000 else 0 end end x, o_custkey::double c from orders),
  u as (select part, 'x' f, x v from o union all select part, 'c', c from o), e as (select f, min(v) lo, max(v) hi from u where part = 'a' group by 1),
  h as (select u.f, part, case when v < lo or v > lo + (hi - lo) / 8 * 9 then 9 else least(8, floor((v - lo) / ((hi - lo) / 8))) end b, count(*) n from u join e on e.f = u.f where v is not null group by all),
  p as (select *, n / sum(n) over (partition by f, part) p from h), j as (select coalesce(a.f, b.f) f, coalesce(a.p, 0) p, coalesce(b.p, 0) q from (select * from p where part = 'a') a full join (select * from p where part = 'b') b on a.f = b.f and a.b = b.b),
  js as (select f, sum(0.5 * case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + 0.5 * case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) js from j group by 1),
  r as (select f, part, count(v) / count(*) fill from u group by all)"""


@query(f"""{_DRIFT} select a.f as feature, round(a.fill, 6) train_fill, round(b.fill, 6) score_fill, round(js, 6) js_divergence, round(abs(a.fill - b.fill), 6) fill_difference,
  round(greatest(a.fill, b.fill) / least(a.fill, b.fill), 6) fill_ratio, js > 0.05 or abs(a.fill - b.fill) > 0.5 as excluded from r a join r b on a.f = b.f and a.part = 'a' and b.part = 'b' join js on js.f = a.f""")
def raw_feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill rates and divergence of training and scoring halves; the shifted, half-empty column is left out."""
    k = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(
        k, F.when((k % 2 == 0) | (k % 3 == 0), F.col("o_totalprice") + F.when(k % 2 == 1, 50000).otherwise(0)).alias("x"), F.col("o_custkey").cast("double").alias("c")
    )
    params = drift.FilterParams(bins=10, max_js_divergence=0.05, max_fill_difference=0.5)
    _, _, _, verdicts = drift.filter_raw(df.where(k % 2 == 0), ["x", "c"], score=df.where(k % 2 == 1), params=params)
    rows = [(v.feature, round(v.train_fill, 6), round(v.score_fill, 6), round(v.js_divergence, 6), round(v.fill_difference, 6), round(v.fill_ratio, 6), v.excluded) for v in verdicts]
    return spark.createDataFrame(rows, "feature string, train_fill double, score_fill double, js_divergence double, fill_difference double, fill_ratio double, excluded boolean")


@query("""with t as (select value > 30 y, case when value > 30 then null else value end leak, case when event_id % 4 <> 0 then value end fine from events)
  select 'leak' feature, round(abs(corr(cast(leak is null as double), cast(y as double))), 6) null_correlation, true excluded from t union all select 'fine', round(abs(corr(cast(fine is null as double), cast(y as double))), 6), false from t""")
def null_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature whose nulls give the label away."""
    v = F.col("value")
    df = table(spark, sf_dir, "events").select((v > 30).cast("double").alias("y"), F.when(v <= 30, v).alias("leak"), F.when(F.col("event_id") % 4 != 0, v).alias("fine"))
    verdicts = drift.filter_raw(df, ["leak", "fine"], ["y"])[3]
    return spark.createDataFrame([(v.feature, round(v.null_correlation, 6), v.excluded) for v in verdicts], "feature string, null_correlation double, excluded boolean")
