"""Workflows, models, insights and streaming. Fits are iterative: where SQL has no answer, tests hold the results against
other ways to the same figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import features as G
from ..plans import insights, models
from ..streaming import scoring
from .base import event_ms, query, r6, shared_folder, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    urgent = (F.col("o_totalprice") > 250_000) | (F.col("o_orderpriority") == "1-URGENT")
    return df.select(F.col("o_orderkey").cast("string").alias("key"), urgent.cast("double").alias("label"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


def _graph() -> tuple[G.Feature, G.Feature, G.Feature]:
    label, price = G.raw("label", "RealNN", response=True), G.raw("price", "Real")
    vector = G.auto_encode([price / 1000.0, G.raw("priority", "PickList"), G.raw("status", "PickList")], min_support=1)
    return label, vector, G.sanity_check(label, vector)


def _selector() -> models.Selector:
    return models.binary_selector(["LogisticRegression", "DecisionTreeClassifier"], {"LogisticRegression": {"regParam": [0.001, 0.1], "maxIter": [20]}, "DecisionTreeClassifier": {"maxDepth": [2, 4]}}, folds=2)


@query("""select cast(o_orderkey as varchar) as key, round(o_totalprice / 1000, 6) price, case when o_orderpriority = '1-URGENT' then 1.0 else 0.0 end::double urgent, (select cast(2 + count(distinct o_orderpriority) + 2 + count(distinct o_orderstatus) + 2 as integer) from orders) slots from orders""")
def workflow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of features, fitted and applied layer by layer."""
    df = _orders(spark, sf_dir)
    out = G.Workflow([_graph()[2]]).train(df).transform(df)
    names = [s["name"] for s in out.schema["checked"].metadata["slots"]]
    at = lambda part: F.get("checked", F.lit(next(i for i, n in enumerate(names) if part in n)))
    return out.select("key", r6(at("divided_by_scalar")).alias("price"), at("1Urgent").alias("urgent"), F.size("checked").alias("slots"))


@query("""with t as (select cast(l_orderkey as varchar) as key, l_quantity q, l_extendedprice * (1 - l_discount) * (1 + l_tax) gross, l_shipdate d, l_returnflag f, l_linenumber n from lineitem)
  select key, n as line, round(sqrt(gross / q), 6) unit, round(log10(gross), 6) magnitude, cast(floor(gross + 0.5) as bigint) rounded, cast(isodow(d) as bigint) as weekday, case when f = 'R' then 1.0 else 0.0 end::double returned,
  round((q - avg(q) over ()) / stddev_samp(q) over (), 6) quantity from t""")
def score_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten fields of a record and a dozen operators on them, scored by a fitted graph."""
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("key"), "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_returnflag"), "l_linestatus", "l_suppkey", event_ms("l_shipdate").alias("shipped")
    )
    quantity, price, discount, tax = (G.raw(f"l_{n}", "Real") for n in ("quantity", "extendedprice", "discount", "tax"))
    line, flag, shipped = G.raw("l_linenumber", "Integral").apply("alias", name="line"), G.raw("l_returnflag", "PickList"), G.raw("shipped", "Date")
    gross = price * (discount * -1.0 + 1.0) * (tax + 1.0)
    out = {
        "line": line, "unit": (gross / quantity).sqrt(), "magnitude": gross.log(base=10.0), "rounded": gross.round(), "weekday": shipped.time_period(period="DayOfWeek"),
        "returned": flag.replace_with(old="R", new="").replace_with(old="A", new="x").replace_with(old="N", new="x").occurs(kind="text") * -1.0 + 1.0, "quantity": quantity.z_normalize(),
    }
    named = [f if f.name == n else f.apply("alias", name=n) for n, f in out.items()]
    scored = G.Workflow(named).train(df).score(df)
    return scored.select("key", "line", r6(F.col("unit")).alias("unit"), r6(F.col("magnitude")).alias("magnitude"), "rounded", "weekday", "returned", r6(F.col("quantity")).alias("quantity"))


@query("""select cast(o_orderkey as varchar) as key, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1.0 else 0.0 end::double prediction, true as sure from orders""")
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models and grids compared by folds, the best one refitted, and all rows scored: what two categories decide is found."""
    label, _, checked = _graph()
    df = _orders(spark, sf_dir).withColumn("label", F.col("priority").isin("1-URGENT", "2-HIGH").cast("double"))
    model = G.Workflow([G.select_model(label, checked, _selector())]).train(df)
    p = F.col("prediction")
    of = lambda n: F.element_at(p, F.lit(n))
    return model.score(df).select("key", of("prediction").alias("prediction"), (F.greatest(of("probability_0"), of("probability_1")) > 0.6).alias("sure"))


def _linear(spark: SparkSession, sf_dir: str):
    # lines of an order may have one number: they are told apart by their order, which a task that runs again finds again
    twin = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_quantity", "l_discount"))
    df = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", twin).alias("key"), "l_quantity", "l_discount", (F.col("l_quantity") * 2 - F.col("l_discount") * 100 + 5).alias("y")
    )
    from ..operators import vectorizers as V

    vectors = V.encode(df, [V.fit(df, "numeric", ["l_quantity", "l_discount"], "Real", track_nulls=False)])
    return vectors, models.fit("LinearRegression", {"regParam": 0.0}, models.ready(vectors, "features", "y"))


@query("""with t as (select l_quantity::double q, l_discount::double d, l_extendedprice::double y from lineitem),
  m as (select covar_pop(q, q) qq, covar_pop(d, d) dd, covar_pop(q, d) qd, covar_pop(q, y) qy, covar_pop(d, y) dy, avg(q) q, avg(d) d, avg(y) y from t),
  b as (select (qy * dd - dy * qd) / (qq * dd - qd * qd) bq, (dy * qq - qy * qd) / (qq * dd - qd * qd) bd, q, d, y from m)
  select round(any_value(bq), 3) quantity, round(any_value(bd), 2) discount, round(any_value(b.y - bq * b.q - bd * b.d), 2) intercept, round(avg(abs(t.y - (b.y + bq * (t.q - b.q) + bd * (t.d - b.d)))), 2) mean_error, count(*) n from t, b""")
def linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of a price that quantity and discount explain in part: SQL solves the normal equations."""
    from ..operators import vectorizers as V

    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", F.col("l_extendedprice").alias("y"))
    vectors = V.encode(df, [V.fit(df, "numeric", ["l_quantity", "l_discount"], "Real", track_nulls=False)])
    model = models.fit("LinearRegression", {"regParam": 0.0}, models.ready(vectors, "features", "y"))
    q, d = (round(float(c), k) for c, k in zip(model.coefficients, (3, 2), strict=True))
    off = F.abs(F.element_at("prediction", F.lit("prediction")) - F.col("y"))
    out = models.predict(model, vectors, "features").agg(F.round(F.avg(off), 2).alias("mean_error"), F.count("*").alias("n"))
    return out.select(F.lit(q).alias("quantity"), F.lit(d).alias("discount"), F.lit(round(float(model.intercept), 2)).alias("intercept"), "mean_error", "n")


@query("""with t as (select l_quantity * 2 q, -l_discount * 100 d from lineitem) select case when abs(q) >= abs(d) or d = 0 then 'l_quantity' else 'l_discount' end slot, count(*) n, round(sum(case when abs(q) >= abs(d) then q else d end), 0) moved from t group by 1""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot whose absence moves the score most, record by record."""
    df, model = _linear(spark, sf_dir)
    top = insights.leave_one_out(model, df, "features", "key", top_k=1)
    return top.select(F.inline("insights")).groupBy("slot").agg(F.count("*").alias("n"), F.round(F.sum("difference"), 0).alias("moved"))


@query("""with t as (select l_quantity q, l_discount d, l_quantity * 2 - l_discount * 100 + 5 y from lineitem), m as (select avg(q) mq, stddev_samp(q) sq, avg(d) md, stddev_samp(d) sd, corr(q, y) cq, corr(d, y) cd from t)
  select round(sum(abs((q - mq) / sq * cq)), 2) quantity, round(sum(abs((d - md) / sd * cd)), 2) discount from t, m""")
def correlation_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = _linear(spark, sf_dir)
    each = insights.correlation_insights(df, "features", "y", "key").select(F.inline("insights"))
    of = lambda n: F.round(F.sum(F.when(F.col("slot") == n, F.abs("difference"))), 2)
    return each.agg(of("l_quantity").alias("quantity"), of("l_discount").alias("discount"))


@query("""select cast(event_id as varchar) as key, round(value * 2 + 1, 6) scaled, coalesce(event_type, '') <> '' typed from events""")
def streaming_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted graph applied to a stream of files: the same rows as in a batch."""
    value = G.raw("value", "Real")
    scaled = (value * 2.0 + 1.0).apply("alias", name="scaled")
    typed = G.raw("event_type", "PickList").apply("occurs", kind="text", name="occurs")
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), "value", "event_type")
    model = G.Workflow([scaled, typed]).train(events)
    base = shared_folder(spark, "stream")
    source = table(spark, sf_dir, "events")
    source.write.parquet(f"{base}/in")
    stream = scoring.file_stream(spark, f"{base}/in", source.schema).select(F.col("event_id").cast("string").alias("key"), "value", "event_type")
    scoring.score_stream(model, stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("key", r6(F.col("scaled")).alias("scaled"), (F.col("occurs") > 0).alias("typed"))


@query("""select user_id, (epoch_us(time_bucket(interval '1 day', ts)) // 1000) as start, count(*) n, round(sum(value), 6) v from events group by all""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of a user's events."""
    events = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = scoring.windowed(events, "t", ["user_id"], [F.count("*").alias("n"), F.sum("value").alias("v")], "1 day")
    return out.select("user_id", event_ms("start").alias("start"), "n", r6(F.col("v")).alias("v"))


@query("""with g as (select *, case when ts < lag(ts) over w + interval '6 hours' then 0 else 1 end b from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(b) over (partition by user_id order by ts, event_id) i from g)
  select user_id, (epoch_us(min(ts)) // 1000) as start, count(*) n from s group by user_id, i""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events less than six hours apart."""
    events = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    out = scoring.sessions(events, "t", ["user_id"], [F.count("*").alias("n")], "6 hours")
    return out.select("user_id", event_ms("start").alias("start"), "n")
