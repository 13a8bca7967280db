"""Event aggregators: from the events of a key to one value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregators import ByKey, custom
from ..operators.events import CutOff, EventFeature, aggregate_events
from .base import event_ms, query, r6, table

#: 2024-01-16, in the middle of the events.
CUT = 1_705_363_200_000
_BEFORE = f"filter (where (epoch_us(ts) // 1000) < {CUT})"


def _by_user(spark: SparkSession, sf_dir: str, features: list[EventFeature], cut: int | None = CUT) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return aggregate_events(events, F.col("user_id"), event_ms(), features, CutOff(cut), F.col("event_id"))


def _v(kind: str | None = None):
    return F.when(F.col("event_type") == kind, F.col("value")) if kind else F.col("value")


_SIGN = "case when event_type = 'signup' then value end"


@query(f"""select cast(user_id as varchar) as key, round(sum(value) {_BEFORE}, 6) sum_real, round(coalesce(sum({_SIGN}) {_BEFORE}, 0), 6) sum_nn, round(min(value) {_BEFORE}, 6) least, round(max({_SIGN}) {_BEFORE}, 6) most,
  round(avg(value) {_BEFORE}, 6) mean, round(coalesce(avg({_SIGN}) {_BEFORE}, 0), 6) mean_nn, round(avg(least(greatest(value / 100, 0), 1)) {_BEFORE}, 6) mean_percent, max((epoch_us(ts) // 1000)) {_BEFORE} as last_ts,
  cast(sum(cast(event_id as bigint)) {_BEFORE} as bigint) sum_id, round(max(value) filter (where (epoch_us(ts) // 1000) >= {CUT}), 6) response from events group by user_id""")
def agg_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _by_user(spark, sf_dir, [
        EventFeature("sum_real", _v(), "Real"), EventFeature("sum_nn", _v("signup"), "RealNN"), EventFeature("least", _v(), "Real", "MinReal"),
        EventFeature("most", _v("signup"), "Currency", "MaxCurrency"), EventFeature("mean", _v(), "Real", "MeanReal"), EventFeature("mean_nn", _v("signup"), "RealNN", "MeanRealNN"),
        EventFeature("mean_percent", _v() / 100, "Percent"), EventFeature("last_ts", event_ms(), "DateTime"), EventFeature("sum_id", F.col("event_id"), "Integral"),
        EventFeature("response", _v(), "Real", "MaxReal", response=True),
    ])
    return out.select("key", *[c if c in ("last_ts", "sum_id") else r6(F.col(c)).alias(c) for c in out.columns if c != "key"])


@query(f"""with e as (select *, value > 20 b from events)
  select cast(user_id as varchar) as key, bool_or(b) {_BEFORE} any_true, bool_and(b) {_BEFORE} all_true, sum(cast(b as int)) {_BEFORE} % 2 = 1 odd_true from e group by user_id""")
def agg_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("value") > 20
    names = {"any_true": "LogicalOr", "all_true": "LogicalAnd", "odd_true": "LogicalXor"}
    return _by_user(spark, sf_dir, [EventFeature(n, big, "Binary", a) for n, a in names.items()])


@query(f"""with e as (select *, case when event_type <> 'view' then event_type else '' end s from events)
  select cast(user_id as varchar) as key, string_agg(nullif(s, ''), ' ' order by ts, event_id) {_BEFORE} texts, string_agg(nullif(s, ''), ',' order by ts, event_id) {_BEFORE} areas,
  mode(event_type order by event_type) {_BEFORE} mode, array_to_string(list_sort(list(distinct event_type) {_BEFORE}), '|') as kinds,
  array_to_string(flatten(list([event_type, cast(event_id as varchar)] order by ts, event_id) {_BEFORE}), '|') as listed from e group by user_id""")
def agg_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    s = F.when(kind != "view", kind).otherwise("")
    out = aggregate_events(events, F.col("user_id"), event_ms(), [
        EventFeature("texts", s, "Text"), EventFeature("areas", s, "Country"), EventFeature("mode", kind, "PickList"),
        EventFeature("kinds", F.array(kind), "MultiPickList"), EventFeature("listed", F.array(kind, F.col("event_id").cast("string")), "TextList"),
    ], CutOff(CUT), F.col("event_id"))
    return out.select("key", "texts", "areas", "mode", F.array_join("kinds", "|").alias("kinds"), F.array_join("listed", "|").alias("listed"))


@query(f"""select cast(user_id as varchar) as key, arg_max(value, ts) {_BEFORE} last_value, arg_min(event_type, ts) {_BEFORE} first_kind, min((epoch_us(ts) // 1000)) {_BEFORE} first_date, max((epoch_us(ts) // 1000)) {_BEFORE} last_date from events group by user_id""")
def agg_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = F.array(event_ms())
    out = _by_user(spark, sf_dir, [
        EventFeature("last_value", F.col("value"), "Real", "LastReal"), EventFeature("first_kind", F.col("event_type"), "PickList", "FirstPickList"),
        EventFeature("first_date", dates, "DateList", "MinDateList"), EventFeature("last_date", dates, "DateList", "MaxDateList"),
    ])
    return out.select("key", "last_value", "first_kind", *[F.get(c, F.lit(0)).alias(c) for c in ("first_date", "last_date")])


_MAP = {"sum": "UnionRealMap", "mean": "UnionMeanRealMap", "least": "UnionMinRealMap", "most": "UnionMaxRealMap", "percent": "UnionMeanPercentMap"}


@query(f"""with e as (select * from events where (epoch_us(ts) // 1000) < {CUT})
  select cast(user_id as varchar) as key, event_type map_key, round(sum(value), 6) sum, round(avg(value), 6) mean, min(value) least, max(value) most, round(avg(least(greatest(value / 100, 0), 1)), 6) percent,
  bool_or(value > 100) as some, string_agg(cast(event_id as varchar), ',' order by ts, event_id) texts, array_to_string(list_sort(list_distinct(list(cast(event_id % 3 as varchar)))), '|') sets from e group by user_id, event_type""")
def agg_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(v):
        return F.create_map("event_type", v)

    features = [EventFeature(n, of(F.col("value") / 100 if n == "percent" else F.col("value")), "RealMap", a) for n, a in _MAP.items()]
    features += [
        EventFeature("some", of(F.col("value") > 100), "BinaryMap"),
        EventFeature("texts", of(F.col("event_id").cast("string")), "EmailMap"),
        EventFeature("sets", of(F.array((F.col("event_id") % 3).cast("string"))), "MultiPickListMap"),
    ]
    out = _by_user(spark, sf_dir, features)
    rows = out.select("*", F.explode(F.map_keys("sum")).alias("map_key"))
    got = lambda n: F.element_at(F.col(n), F.col("map_key"))
    return rows.select("key", "map_key", *[r6(got(n)).alias(n) for n in _MAP], got("some").alias("some"), got("texts").alias("texts"), F.array_join(got("sets"), "|").alias("sets"))


@query("""with l as (select label, unnest(embedding)::double v, unnest(range(len(embedding))) i from embeddings), s as (select label, i, sum(v) v from l group by all)
  select cast(label as varchar) as key, cast(i as integer) as slot, round(v, 4) total from s""")
def agg_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    feature = EventFeature("total", F.col("embedding").cast("array<double>"), "OPVector", "SumVector")
    out = aggregate_events(vectors, F.col("label"), F.lit(0).cast("long"), [feature], tie=F.col("vec_id"))
    return out.select("key", F.posexplode("total").alias("slot", "v")).select("key", "slot", F.round("v", 4).alias("total"))


_LAT, _LON = "(s_suppkey % 17 - 8) * 2.5 + 40", "(s_suppkey % 23 - 11) * 1.5 + 10"
_FAR = "1 / sqrt((cos(la) * cos(lo) * cos(la) * cos(lo) + cos(la) * sin(lo) * cos(la) * sin(lo)) / pow(1.0011188539924791, 2) + sin(la) * sin(la) / pow(0.9977622539852008, 2))"


@query(f"""with g as (select s_nationkey k, radians({_LAT}) la, radians({_LON}) lo from supplier), p as (select k, cos(la) * cos(lo) * ({_FAR}) x, cos(la) * sin(lo) * ({_FAR}) y, sin(la) * ({_FAR}) z from g),
  a as (select k, avg(x) x, avg(y) y, avg(z) z, greatest(max(x) - min(x) + 1.2 / 3959, max(y) - min(y) + 1.2 / 3959, max(z) - min(z)) w from p group by k)
  select cast(k as varchar) as key, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) lat, round(degrees(atan2(y, x)), 6) lon,
  case when w * 3959 * 0.99 <= 3 then 7.0 when w * 3959 * 0.99 <= 12 then 8.0 when w * 3959 * 0.99 <= 40 then 9.0 when w * 3959 * 0.99 <= 150 then 10.0 else 0.0 end::double accuracy from a where w * 3959 * 0.99 > 1.2
  union all select cast(k as varchar), round(degrees(atan2(z, sqrt(x * x + y * y))), 6), round(degrees(atan2(y, x)), 6), 6.0::double from a where w * 3959 * 0.99 <= 1.2""")
def agg_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    where = F.array((k % 17 - 8) * 2.5 + 40, (k % 23 - 11) * 1.5 + 10, F.lit(6.0))
    out = aggregate_events(table(spark, sf_dir, "supplier"), F.col("s_nationkey"), F.lit(0).cast("long"), [EventFeature("g", where, "Geolocation")], tie=k)
    return out.select("key", *[(r6(F.get("g", F.lit(i))) if i < 2 else F.get("g", F.lit(i))).alias(n) for i, n in enumerate(("lat", "lon", "accuracy"))])


@query(f"""select cast(user_id as varchar) as key, cast(coalesce(bit_xor(event_id) {_BEFORE}, 0) as bigint) folded, round(max(value) {_BEFORE} - min(value) {_BEFORE}, 6) as width from events group by user_id""")
def agg_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monoid of one's own, and one made of built-in aggregates."""
    xor = custom(F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    out = _by_user(spark, sf_dir, [EventFeature("folded", F.col("event_id"), "Integral", xor), EventFeature("width", F.col("value"), "Real", lambda v, t, i: F.max(v) - F.min(v))])
    return out.select("key", "folded", r6(F.col("width")).alias("width"))


@query("""with e as (select * from events), n as (select event_type k, cast(floor(value / 10) as bigint) v, count(*) c from e group by all), r as (select *, row_number() over (partition by k order by c desc, v) i from n)
  select r.k as map_key, cast(r.v as bigint) as mode, round(m.mean, 6) mean, m.n n from r join (select event_type k, avg(value) mean, count(*) n from e group by 1) m on m.k = r.k where i = 1""")
def agg_fit_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit-time aggregates of a map column by map key: mode, mean and count."""
    from ..operators.aggregators import fold, mean, mode

    rows = table(spark, sf_dir, "events").select(F.lit("all").alias("key"), F.create_map("event_type", "value").alias("m"), event_ms().alias("t"), F.col("event_id").alias("i"))
    tens = F.transform_values("m", lambda k, v: F.floor(v / 10).cast("long"))
    items = [("mode", ByKey(mode), tens), ("mean", ByKey(mean), F.col("m")), ("n", ByKey(lambda v, t, i: F.count(v)), F.col("m"))]
    out = fold(rows, "key", items, F.col("t"), F.col("i")).select("*", F.explode(F.map_keys("mode")).alias("map_key"))
    got = lambda n: F.element_at(F.col(n), F.col("map_key"))
    return out.select("map_key", got("mode").alias("mode"), r6(got("mean")).alias("mean"), got("n").alias("n"))
