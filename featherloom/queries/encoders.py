"""Fitted scalers, indexers and feature vectors, vectors in long form: (slot, sum over all rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import scalers
from ..operators import vectorizers as V
from .base import event_ms, query, r6, table

_CUSTOMER = "select c_custkey, case when c_custkey % 7 <> 0 then c_acctbal end b, case when c_custkey % 5 <> 0 then c_nationkey end n, case when c_custkey % 3 <> 0 then c_acctbal > 2000 end rich, c_mktsegment s from customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("b"), F.when(k % 5 != 0, F.col("c_nationkey")).alias("n"),
        F.when(k % 3 != 0, F.col("c_acctbal") > 2000).alias("rich"), F.col("c_mktsegment").alias("s"),
    )


def _slot_sums(df: DataFrame, encoders: list[V.Encoder]) -> DataFrame:
    """(slot, total): the sums of all slots, by one aggregation."""
    out = V.encode(df, encoders)
    names = [s["name"] for s in out.schema["features"].metadata["slots"]]
    sums = out.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("i"))
    return sums.select(label.alias("slot"), F.round("v", 4).alias("total"))


@query(f"""with t as ({_CUSTOMER}) select c_custkey, round(coalesce(b, avg(b) over ()), 6) filled, round((coalesce(b, 0) - avg(coalesce(b, 0)) over ()) / stddev_samp(coalesce(b, 0)) over (), 6) scaled from t""")
def fill_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _customers(spark, sf_dir)
    b, zero = F.col("b"), F.coalesce("b", F.lit(0.0))
    return df.select("c_custkey", r6(scalers.fill(b, scalers.fit_mean(df, b))).alias("filled"), r6(scalers.standardise(zero, scalers.fit_standard(df, zero))).alias("scaled"))


@query(f"""with t as ({_CUSTOMER}), q as (select [quantile_disc(b, 0.25), quantile_disc(b, 0.5), quantile_disc(b, 0.75)] e from t)
  select c_custkey, cast(case when b is null then null else cast(b >= e[1] as int) + cast(b >= e[2] as int) + cast(b >= e[3] as int) end as double) bucket from t, q""")
def percentile_calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _customers(spark, sf_dir)
    edges = scalers.fit_percentiles(df, F.col("b"), 4)
    return df.select("c_custkey", F.when(F.col("b").isNotNull(), scalers.percentile(F.col("b"), edges, 4)).alias("bucket"))


@query("""with d as (select doc_id, least(floor(n_chars / 400), 40) s, quality::double y from labels join documents using (doc_id)), g as (select s, sum(y) y, count(*)::double n from d where s is not null and y is not null group by 1),
  m as (select a.s a, b.s b, sum(g.y) / sum(g.n) mean from g a, g b, g where a.s <= g.s and g.s <= b.s group by 1, 2), l as (select g.s, m.a, min(mean) low from g join m on m.a <= g.s and g.s <= m.b group by 1, 2), v as (select s, max(low) v from l group by 1)
  select doc_id, round(v, 6) calibrated from d left join v on v.s = d.s""")
def isotonic_calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated scores never fall as scores rise: the greatest over all starts of the least mean from there on."""
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.least(F.floor(F.col("n_chars") / 400), F.lit(40)).cast("double").alias("s"), "quality")
    fitted = scalers.fit_isotonic(df, F.col("s"), F.col("quality"))
    return df.select("doc_id", r6(scalers.calibrate(F.col("s"), fitted)).alias("calibrated"))


_RANKED = "with t as (select p_partkey, case when p_partkey % 6 <> 0 then p_type end v from part), r as (select coalesce(v, 'null') v, row_number() over (order by count(*) desc, coalesce(v, 'null')) - 1 i from t group by 1)"


@query(f"""{_RANKED} select p_partkey, cast(i as double) as idx, t.v as back, case when r.v = 'null' then 5 else i end::double strict_idx from t join r on r.v = coalesce(t.v, 'null') where r.v <> 'none'""")
def label_indexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to indices, a null being a label of its own, and back."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 != 0, F.col("p_type")).alias("v"))
    labels = scalers.fit_labels(df, F.col("v"))
    idx = scalers.index_labels(F.col("v"), labels)
    back = F.nullif(scalers.label_at(idx, labels), F.lit(scalers.NULL_LABEL))
    strict = F.when(F.col("v").isNull(), 5.0).otherwise(scalers.index_labels(F.col("v"), labels, "error"))
    return df.select("p_partkey", idx.alias("idx"), back.alias("back"), strict.alias("strict_idx"))


@query(f"""with t as ({_CUSTOMER}), m as (select avg(b) mb, mode(n order by n) mn from t)
  select 'b' slot, round(sum(coalesce(b, mb)), 4) total from t, m union all select 'b_b_NullIndicatorValue', sum(case when b is null then 1.0 else 0.0 end::double) from t
  union all select 'n', sum(coalesce(n, mn))::double from t, m union all select 'n_n_NullIndicatorValue', sum(case when n is null then 1.0 else 0.0 end::double) from t
  union all select 'rich', sum(case when rich then 1.0 else 0.0 end::double) from t union all select 'rich_rich_NullIndicatorValue', sum(case when rich is null then 1.0 else 0.0 end::double) from t""")
def vectorize_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, modes and constants in place of nulls, with null flags."""
    df = _customers(spark, sf_dir)
    return _slot_sums(df, [V.fit(df, "numeric", ["b"], "Real"), V.fit(df, "numeric", ["n"], "Integral", fill="mode"), V.fit(df, "binary", ["rich"], "Binary")])


@query("""with t as (select case when p_partkey % 8 <> 0 then p_brand end b, case when p_partkey % 8 <> 0 then replace(p_brand, '#', '') end c from part), n as (select c, count(*) k, row_number() over (order by count(*) desc, c) i from t where c is not null group by c having count(*) >= 5)
  select 'b_b_' || c slot, k::double total from n where i <= 6 union all select 'b_b_OTHER', (select count(c) from t) - (select sum(k) from n where i <= 6)::double
  union all select 'b_b_NullIndicatorValue', (select count(*) from t where c is null)::double""")
def vectorize_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot of the most frequent values, then OTHER and null."""
    df = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 8 != 0, F.col("p_brand")).alias("b"))
    return _slot_sums(df, [V.fit(df, "pivot", ["b"], "PickList", top_k=6, min_support=5)])


@query("""with t as (select o_custkey, list(distinct o_orderpriority) s from orders group by 1), e as (select o_custkey, unnest(s) v from t), n as (select v, count(*) k, row_number() over (order by count(*) desc, v) i from e group by v having count(*) >= 10)
  select 's_s_' || v slot, k::double total from n where i <= 3 union all select 's_s_OTHER', (select count(*) from e where v not in (select v from n where i <= 3))::double union all select 's_s_NullIndicatorValue', 0.0::double""")
def vectorize_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivot of sets: OTHER counts the values that have no slot."""
    df = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s")).select("s")
    return _slot_sums(df, [V.fit(df, "pivot", ["s"], "MultiPickList", top_k=3, clean=False)])


@query("""with t as (select 'name' f, p_name v from part union all select 'brand', p_brand from part union all select 'key', cast(p_partkey as varchar) from part), n as (select f, v, count(*) k from t group by all),
  s as (select f, count(*) d, sum(k) n from n group by f) select f as feature, case when d <= 30 then 'pivot' else 'hash' end as method from s""")
def smart_text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are pivoted, hashed or ignored."""
    df = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("key"))
    encoder = V.fit(df, "smart_text", ["name", "brand", "key"], "Text", top_k=10)
    return spark.createDataFrame(sorted(encoder.state["method"].items()), "feature string, method string")


@query(f"""with t as (select item_id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: x not in ({", ".join(f"'{w}'" for w in text.STOP_WORDS)})) k from benchmark)
  select item_id, cast(len(k) as double) tokens, 0.0::double as is_null, 65 as slots from t""")
def vectorize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed token counts: the buckets of a row add up to its tokens."""
    df = table(spark, sf_dir, "benchmark")
    out = V.encode(df, [V.fit(df, "hash", ["text"], "Text", hashes=64)])
    total = F.aggregate(F.slice("features", 1, 64), F.lit(0.0), lambda a, x: a + x)
    return out.select("item_id", total.alias("tokens"), F.get("features", F.lit(64)).alias("is_null"), F.size("features").alias("slots"))


_USERS = "select user_id, case when user_id % 4 = 0 and event_type = 'error' then 'view' else event_type end k, sum(value) v, mode(cast(floor(value) as bigint) % 3 order by cast(floor(value) as bigint) % 3) o from events group by all"


@query(f"""with e as ({_USERS}), u as (select count(distinct user_id) n from e), a as (select k, count(*) c, sum(v) s, avg(v) m from e group by k)
  select 'm_' || k slot, round(s + (n - c) * m, 4) total from a, u union all select 'm_' || k || '_NullIndicatorValue', (n - c)::double from a, u
  union all select 'o_' || k || '_' || x.o, count(*)::double from (select k, cast(o as varchar) o from e) x group by k, x.o
  union all select 'o_' || k || '_OTHER', 0.0::double from a union all select 'o_' || k || '_NullIndicatorValue', (n - c)::double from a, u""")
def vectorize_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each learned key of a number map, and a pivot of each key of a text map."""
    third = F.floor("value").cast("long") % 3
    kind = F.col("event_type")  # the errors of some users are views, so that these users lack a key
    events = table(spark, sf_dir, "events").withColumn("event_type", F.when((F.col("user_id") % 4 == 0) & (kind == "error"), "view").otherwise(kind))
    rows = events.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"), F.mode(third, True).cast("string").alias("o"))
    df = rows.groupBy("user_id").agg(*[F.map_from_entries(F.collect_list(F.struct("event_type", v))).alias(m) for m, v in (("m", "v"), ("o", "o"))])
    return _slot_sums(df, [V.fit(df, "map_values", ["m"], "RealMap", fill="mean"), V.fit(df, "map_pivot", ["o"], "PickListMap", min_support=1)])


@query("""with t as (select (epoch_us(o_orderdate) // 1000) ms, o_orderdate d from orders)
  select 'd_DayOfWeek_x_DayOfWeek' slot, round(sum(cos(2 * pi() * (isodow(d) - 1) / 7)), 4) total from t union all select 'd_DayOfWeek_y_DayOfWeek', round(sum(sin(2 * pi() * (isodow(d) - 1) / 7)), 4) from t
  union all select 'd_days_since', sum(trunc((1577836800000 - ms) / 86400000.0)) from t union all select 'd_d_NullIndicatorValue', 0.0::double""")
def vectorize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the unit circle of a period, and whole days to a reference date."""
    df = table(spark, sf_dir, "orders").select(event_ms("o_orderdate").alias("d"))
    return _slot_sums(df, [V.fit(df, "circle", ["d"], "Date", periods=["DayOfWeek"]), V.fit(df, "days", ["d"], "Date", reference_ms=1_577_836_800_000)])


@query("""with t as (select s_suppkey k, case when s_suppkey % 5 <> 0 then (s_suppkey % 17 - 8) * 2.5 + 40 end la from supplier)
  select 'nulls' as slot, count(*) filter (where la is null)::double total from t union all select 'lat_known', round(sum(la), 4) from t""")
def vectorize_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls become the midpoint: the sum of the known latitudes is what the sum of all lacks of the nulls' share."""
    k = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select(F.when(k % 5 != 0, F.array((k % 17 - 8) * 2.5 + 40, k % 23 + 0.0, F.lit(1.0))).alias("g"))
    encoder = V.fit(df, "location", ["g"], "Geolocation")
    sums = {r.slot: r.total for r in _slot_sums(df, [encoder]).collect()}
    nulls = sums["g_g_NullIndicatorValue"]
    known = round(sums["g_g_lat"] - nulls * encoder.state["fill"][0][0], 4)
    return spark.createDataFrame([("nulls", nulls), ("lat_known", known)], "slot string, total double")


@query()
def vectorize_tree_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets between the splits of a one-feature tree."""
    df = table(spark, sf_dir, "lineitem").select((F.col("l_shipdate").cast("timestamp").cast("long") / 86400).alias("day"), F.when(F.col("l_quantity") > 30, 1.0).otherwise(0.0).alias("label"), F.col("l_quantity").alias("q"))
    return _slot_sums(df, [V.fit(df, "tree", ["q", "day"], "Real", label="label")])


@query("""with s as (select least(5, count(*)) k from (select c_mktsegment from customer group by 1 having count(*) >= 10)), n as (select least(5, count(*)) k from (select c_nationkey from customer group by 1 having count(*) >= 10))
  select count(*) as n, cast(8 + any_value(s.k) + any_value(n.k) as integer) as slots, round(sum(c_acctbal), 2) balance, any_value(s.k) segments from customer, s, n""")
def auto_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default encoders of all columns by type, then a choice of slots by provenance."""
    df = table(spark, sf_dir, "customer").select("c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"), (F.col("c_acctbal") > 0).alias("paid"))
    out = V.encode(df, V.auto_encode(df, top_k=5))
    balance = V.drop_slots(out, lambda s: s["name"] != "c_acctbal")
    kinds = V.drop_slots(out, lambda s: s["parent"] != "c_mktsegment" or s["indicator"] in (V.OTHER, V.NULL))
    n = len(out.schema["features"].metadata["slots"])
    row = balance.agg(F.count("*").alias("n"), F.lit(n).alias("slots"), F.round(F.sum(F.get("features", F.lit(0))), 2).alias("balance"))
    return row.select("n", "slots", "balance", F.lit(len(kinds.schema["features"].metadata["slots"])).cast("long").alias("segments"))
